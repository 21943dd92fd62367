"""Benchmark decontamination with a suffix automaton over all test items.

Texts are lower-cased words. The automaton holds every run of words of every item; streaming a document through it gives,
at each word, the longest run ending there that some item holds. Where that reaches the window length, the words of
the window are hit. An item shorter than a window is hit where the whole of it occurs.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmetrics.llm.batches import byte_table, documents_of, joined, keep_rows, map_texts, word_spans

#: Every byte that belongs to no word: ASCII but for digits and letters.
SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TABLE = byte_table(SEPARATORS)
WINDOW = 10
#: Words of items in one automaton, about 300 bytes each in every Python worker. More items make more automata.
WORDS_PER_AUTOMATON = 200_000


class SuffixAutomaton:
    """All runs of words of the added items; states know which items hold their window and which end in them."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        self.holders: dict[int, set[str]] = {}  # by the state whose lengths include the window
        self.whole: dict[int, dict[int, set[str]]] = {}  # by state and length: shorter items
        self.shortest = window

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        state = self._new({}, self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
        else:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return state

    def _new(self, arcs: dict[int, int], length: int) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A state of its own for the shorter runs of ``q``."""
        copy = self._new(dict(self.next[q]), self.length[p] + 1)
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, items: Iterable[tuple[str, list[bytes]]]) -> None:
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if ws]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for item, words in coded:  # only now are the states final
            if len(words) < self.window:
                state = self.reach(words)
                self.whole.setdefault(state, {}).setdefault(len(words), set()).add(item)
                self.shortest = min(self.shortest, len(words))
            else:
                for end, (state, length) in enumerate(self.walk(words)):
                    if end + 1 >= self.window:
                        self.holders.setdefault(self.window_state(state), set()).add(item)

    def reach(self, words: list[int]) -> int:
        state = 0
        for w in words:
            state = self.next[state][w]
        return state

    def walk(self, words: Iterable[int]):
        """State and matching length after each word."""
        state = length = 0
        arcs, link, lengths = self.next, self.link, self.length
        for w in words:
            to = arcs[state].get(w)
            while to is None and state:
                state = link[state]
                length = lengths[state]
                to = arcs[state].get(w)
            state, length = (to, length + 1) if to is not None else (0, 0)
            yield state, length

    def window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a run of at least so many."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (end exclusive, in order of their ends) and the items that hit them; -1 is no item's word."""
        spans, items = [], set()
        known = np.zeros(len(words) + 2, np.int8)
        known[1:-1] = words >= 0
        step = np.diff(known)
        for low, high in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if high - low < self.shortest:
                continue
            for end, (state, length) in enumerate(self.walk(words[low:high].tolist()), low + 1):
                if length >= self.window:
                    spans.append((end - self.window, end))
                    items |= self.holders.get(self.window_state(state), set())
                if self.whole and length >= self.shortest:
                    while state:
                        for n, found in self.whole.get(state, {}).items():
                            if n <= length:
                                spans.append((end - n, end))
                                items |= found
                        state = self.link[state]
                        length = self.length[state]
        return spans, items


@dataclass(frozen=True)
class Limits:
    """A run of hit words is removed if it has ``words`` words or more; a document goes whole if more than ``coverage`` of its words are hit."""

    words: int = 1
    coverage: float = 0.8


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def automata(items: DataFrame, id_col: str, text_col: str, window: int, per_automaton: int) -> list[SuffixAutomaton]:
    """The items in automata of bounded size each. A benchmark is a list of tests, its size is that of the test suite, not of the corpus."""
    rows = items.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).where(f"`{text_col}` is not null")
    out, pending, size = [], [], 0

    def flush():
        nonlocal pending, size
        if pending:
            out.append(SuffixAutomaton(window))
            out[-1].add(pending)
            pending, size = [], 0

    for item, text in rows.orderBy(*rows.columns).toLocalIterator():
        words = split_words(text.encode())
        pending.append((item, words))
        size += len(words)
        if size >= per_automaton:
            flush()
    flush()
    return out


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    limits: Limits = Limits(),
    per_automaton: int = WORDS_PER_AUTOMATON,
) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as sorted strings), spans of hit words in bytes, clean_text, removed.

    ``clean_text`` is the text without the spans that exceed ``limits.words``; it is null where the document exceeds
    ``limits.coverage`` (``removed``). One row out for each row in. A null text, or one without words, has 0 words and
    no hits; items without words hit nothing, those without an id hit but are not named; the same id given to several items counts once. Empty
    tables and other columns are no matter. The automata hold ``per_automaton`` words each; documents pass once through
    each of them.
    """
    built = automata(items, item_id, item_text, window, per_automaton)
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(a) for a in built]  # each bounded by per_automaton

    def rows(ids: list, texts: list):
        buf, offsets = joined(texts, TABLE)
        starts, ends = word_spans(buf)
        data = buf.tobytes()
        words = data.split()
        codes = [np.fromiter(map(b.value.vocabulary.get, words, repeat(-1)), np.int64, len(words)) for b in shared]
        first = np.searchsorted(starts, offsets)
        for k, (doc_id, text) in enumerate(zip(ids, texts)):
            low, high = int(first[k]), int(first[k + 1])
            hit, items_found = np.zeros(high - low, bool), set()
            for b, code in zip(shared, codes):
                spans, found = b.value.hits(code[low:high])
                items_found |= found
                for s, e in spans:
                    hit[s:e] = True
            runs = []
            if hit.any():
                step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                base = int(offsets[k])
                for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
                    runs.append((int(e - s), int(starts[low + s]) - base, int(ends[low + e - 1]) - base))
            removed = bool(hit.size) and float(hit.mean()) > limits.coverage
            clean = None if text is None or removed else _without(text, [(s, e) for n, s, e in runs if n >= limits.words])
            yield doc_id, high - low, int(hit.sum()), sorted(items_found - {None}), [[s, e] for _, s, e in runs], clean, removed

    return map_texts(
        documents_of(docs, id_col, text_col),
        rows,
        "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<int>>, clean_text string, removed boolean",
    )


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    per_automaton: int = WORDS_PER_AUTOMATON,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of any item occurs."""
    shared = [docs.sparkSession.sparkContext.broadcast(a) for a in automata(items, item_id, item_text, window, per_automaton)]

    def clean(texts: list) -> np.ndarray:
        buf, offsets = joined(texts, TABLE)
        words = buf.tobytes().split()
        first = np.searchsorted(word_spans(buf)[0], offsets)
        out = np.ones(len(texts), bool)
        for b in shared:
            code = np.fromiter(map(b.value.vocabulary.get, words, repeat(-1)), np.int64, len(words))
            for k in np.flatnonzero(out):
                out[k] = not b.value.hits(code[first[k] : first[k + 1]])[0]
        return out

    return keep_rows(docs, text_col, clean)


def _without(text: bytes, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return b"".join(out).decode()
