"""Deep-shallow sorting of suffixes: multikey quicksort on the first bytes, then blind tries for groups that agree there.

Many groups are worked on side by side in numpy, one step of all of them at a time.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the quicksort looks at, eight at a time; deeper, the tries take over.
SHALLOW = 16
WORD = 8


def words_at(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Eight bytes from each start on as one number that sorts like the bytes; the buffer must reach that far."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(WORD):
        out = (out << np.uint64(8)) | buf[starts + j]
    return out


def _shallow(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the first ``SHALLOW`` bytes and the number of the group of equal ones, in order.

    Multikey quicksort over an alphabet of eight-byte letters: sort by one letter, then each group of equal ones by the next.
    """
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    for depth in range(0, SHALLOW, WORD):
        key = words_at(buf, starts[order] + depth)
        inner = np.lexsort((key, group))
        order, group, key = order[inner], group[inner], key[inner]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new) - 1
    return order, group


def _mismatch(buf: np.ndarray, a: np.ndarray, b: np.ndarray, depth: np.ndarray, limit: int) -> np.ndarray:
    """Length up to ``limit`` on which the suffixes at ``a`` and ``b`` agree, from ``depth`` on which they are known to."""
    same = depth.copy()
    open_ = np.flatnonzero(same < limit)
    while len(open_):
        x, y = words_at(buf, a[open_] + same[open_]), words_at(buf, b[open_] + same[open_])
        differ = x ^ y
        equal = differ == 0
        bits = np.zeros(len(open_), np.int64)
        some = ~equal
        # Position of the highest differing bit, found exactly: halves of the number are exact as doubles.
        high = (differ[some] >> np.uint64(32)).astype(np.float64)
        low = (differ[some] & np.uint64(0xFFFFFFFF)).astype(np.float64)
        top = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
        bits[some] = (64 - top) // 8
        same[open_] += np.where(equal, WORD, bits)
        open_ = open_[equal & (same[open_] < limit)]
    return np.minimum(same, limit)


def sort_suffixes(buf: np.ndarray, starts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``limit`` bytes, and for each in that order the number of its
    group of suffixes equal on all of them. The buffer must go on for ``limit`` + 8 bytes after each start.

    A group that agrees on the shallow bytes becomes a blind trie: it is threaded by the suffix that leads it, each
    other branches off where it first differs, and those that branch at one place with one byte form a group of their own,
    led by their first, one branch deeper. Suffixes that never branch off are equal.
    """
    order, group = _shallow(buf, starts)
    n = len(order)
    if not n:
        return order, group
    # A suffix's place in its trie: at each branch (depth, byte) it took, below or above the leader's.
    at = starts[order]
    depth = np.full(n, SHALLOW, np.int64)
    final = group.copy()
    active = np.flatnonzero(np.bincount(group)[group] > 1)
    while len(active):
        g = final[active]
        head = np.ones(len(active), bool)
        head[1:] = g[1:] != g[:-1]
        leader = active[head][np.cumsum(head) - 1]
        same = _mismatch(buf, at[active], at[leader], depth[active], limit)
        branched = same < limit
        mine = np.where(branched, buf[at[active] + np.minimum(same, limit - 1)].astype(np.int64), 0)
        theirs = np.where(branched, buf[at[leader] + np.minimum(same, limit - 1)].astype(np.int64), 0)
        # In order: smaller branches, shallow ones first; the leader and its equals; larger branches, deep ones first.
        side = np.where(branched, np.where(mine < theirs, 0, 2), 1)
        level = np.where(side == 0, same, -same)
        inner = np.lexsort((mine, level, side, g))
        spots = active  # positions that these suffixes fill, group by group
        moved = active[inner]
        order[spots], at[spots], depth[spots] = order[moved], at[moved], np.where(branched, same + 1, limit)[inner]
        g, side, level, mine = g[inner], side[inner], level[inner], mine[inner]
        new = np.ones(len(active), bool)
        new[1:] = (g[1:] != g[:-1]) | (side[1:] != side[:-1]) | (level[1:] != level[:-1]) | (mine[1:] != mine[:-1])
        branch = np.cumsum(new) - 1
        final[spots] = spots[np.flatnonzero(new)[branch]] + n  # a name for each branch that grows along the order
        size = np.bincount(branch)[branch]
        active = spots[(size > 1) & (side != 1)]
    new = np.ones(n, bool)
    new[1:] = final[1:] != final[:-1]
    return order, np.cumsum(new) - 1
