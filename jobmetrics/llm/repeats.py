"""Removal of byte strings that also occur in an earlier document, by suffix sorting.

Every window of ``LENGTH`` bytes has an owner: the ``GRAM``-byte string in it with the least hash, the leftmost of equals.
Equal windows have equal owners, so windows are compared only where owners are equal. One row per owner (about one in
eighteen bytes) goes through the shuffle, with a hash of all the bytes its windows cover:

* where those bytes are the same in an earlier document, all windows of the owner are repeats (inner parts of copies);
* otherwise its windows can still be repeats if another document has the same owner with the same seventeen bytes on one side
  (edges of copies, edited copies). Only these bring their bytes, and deep-shallow sorting of their suffixes finds equal windows.

Rows of one owner with the same bytes are reduced to the first document before the shuffle. Owners with very many different
surroundings are dealt out by their windows instead.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmetrics.llm.batches import arrow_map, arrow_schema, chunks, documents_of, joined, mix, prefix_hashes, span_hashes
from jobmetrics.runtime import Stage
from jobmetrics.llm.suffix_sort import sort_suffixes

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM + 1  # grams in a window
SIDE = (LENGTH - GRAM) // 2  # a window has at least so many bytes on one side of its owner
CHUNK = 1 << 20
#: Owners with more surroundings than this are dealt out by window; so many rows of one owner are held at most.
HOT, HELD = 20_000, 200_000
#: Bytes of pieces that are sorted at a time.
SORTED = 1 << 20
_PLACE = np.uint64((1 << 31) - 1)
_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def grams(buf: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each place on."""
    w = buf.astype(np.uint64)
    for j in (1, 2, 4):
        w = w[:-j] | (w[j:] << np.uint64(8 * j))
    return mix(w[:-8] * _A ^ mix(w[8:] * _B))


def owners(hashes: np.ndarray) -> np.ndarray:
    """Place of the owner of the window at each place."""
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        rest = REACH - width
        least = np.minimum(least[:-rest], least[rest:])
    return (least & _PLACE).astype(np.int64)


OWNED = "gram long, ctx long, doc long, twin int, loc long"


def _owned(ids: np.ndarray, twins: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...] | None:
    """Owner rows of some documents, reduced, and which of them are repeats already: (gram, ctx, doc, twin, loc, hit).

    ``loc`` packs tags of the two sides, the first window's place in the document, the number of windows and the owner's offset.
    Repeats are put together to runs of windows, with ``loc`` the place and the number, and dealt out by a hash of their own.
    """
    buf, offsets = joined(texts, None, b"\0")
    if len(buf) < LENGTH:
        return None
    room = np.repeat(offsets[1:] - 1, np.diff(offsets))[: len(buf) - LENGTH + 1] - np.arange(len(buf) - LENGTH + 1)
    starts = np.flatnonzero(room >= LENGTH)
    if not len(starts):
        return None
    h = grams(buf)
    own = owners(h)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    low, p = starts[first], own[first]
    row = np.searchsorted(offsets, low, side="right") - 1
    begin, end = offsets[row], offsets[row + 1] - 1
    prefix = prefix_hashes(buf)
    ctx = mix(span_hashes(prefix, low, low + n + LENGTH - 1) + (p - low).astype(np.uint64) * _A)

    def tag(start: np.ndarray, there: np.ndarray) -> np.ndarray:
        at = np.where(there, start, 0)
        return np.where(there, (span_hashes(prefix, at, np.minimum(at + SIDE, len(buf))) >> np.uint64(54)).astype(np.int64) % 1023 + 1, 0)

    left, right = tag(p - SIDE, p - SIDE >= begin), tag(p + GRAM, p + GRAM + SIDE <= end)
    loc = (left << 53) | (right << 43) | ((low - begin) << 12) | (n << 6) | (p - low)
    gram, ctx, doc, twin = h[p].view(np.int64), ctx.view(np.int64), ids[row], twins[row]
    order = np.lexsort((doc, ctx, gram))
    gram, ctx, doc, twin, loc = gram[order], ctx[order], doc[order], twin[order], loc[order]
    row, low, n = row[order], low[order], n[order]
    hit = _repeated(gram, ctx, doc)
    rows, starts, sizes = _runs(row[hit], low[hit], n[hit])
    placed = starts - offsets[rows]
    own_key = mix(ids[rows].view(np.uint64) * _A + placed.astype(np.uint64)).view(np.int64)
    owned = [np.concatenate(x) for x in ((gram[~hit], own_key), (ctx[~hit], np.zeros(len(rows), np.int64)), (doc[~hit], ids[rows]), (twin[~hit], twins[rows]), (loc[~hit], (placed << 31) | sizes))]
    return *owned, np.arange(len(owned[0])) >= len(owned[0]) - len(rows)


def _runs(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows put together where one begins with the window after the last of another."""
    order = np.lexsort((start, row))
    row, start, n = row[order], start[order], n[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return row[first], start[first], np.add.reduceat(n, first) if len(first) else n


def _repeated(gram: np.ndarray, ctx: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of rows sorted by all three, those with an earlier document of the same owner and bytes."""
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])
    return doc > doc[np.flatnonzero(new)[np.cumsum(new) - 1]]


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.asarray(c.fill_null(0)) for c in batch.columns]


def _owner_rows(rows: DataFrame) -> DataFrame:
    target = arrow_schema(OWNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, twins = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            texts = batch.column(2).cast(pa.binary())
            for low, high in chunks(texts, CHUNK):
                found = _owned(ids[low:high], twins[low:high].astype(np.int32), texts[slice(low, high)].to_pylist())
                if found:
                    gram, ctx, doc, twin, loc, hit = found
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(ctx, mask=hit), pa.array(doc), pa.array(twin), pa.array(loc)], schema=target)

    return arrow_map(rows, run, OWNED)


#: Windows from ``start`` on: repeats where ``gram`` is null, else to be looked at under that key.
MARKS = "doc long, twin int, start long, n int, gram long, hot boolean"
_MARKS = pa.schema(
    [("doc", pa.int64()), ("twin", pa.int32()), ("start", pa.int64()), ("n", pa.int32()), ("gram", pa.int64()), ("hot", pa.bool_())]
)


def _windows(doc, twin, loc, gram=None, hot=False, runs=False) -> pa.RecordBatch:
    start, n = (loc >> 31, loc & ((1 << 31) - 1)) if runs else ((loc >> 12) & ((1 << 31) - 1), (loc >> 6) & 63)
    key = pa.nulls(len(doc), pa.int64()) if gram is None else pa.array(gram)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(twin), pa.array(start), pa.array(n.astype(np.int32)), key, pa.array(np.broadcast_to(hot, len(doc)))],
        schema=_MARKS,
    )


def _shared(gram: np.ndarray, tag: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows whose owner and tag, not 0, another document has too."""
    order = np.lexsort((doc, tag, gram))
    g, t, d = gram[order], tag[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(g)) - 1
    several = (d[first] != d[last]) & (t[first] > 0)
    out = np.zeros(len(g), bool)
    out[order] = several[np.cumsum(new) - 1]
    return out


def _marks(owned: DataFrame, hot: int, most: int) -> DataFrame:
    """Repeats and windows to look at, from owner rows brought together by owner."""

    def settle(rows: list[np.ndarray], forced: bool) -> Iterator[pa.RecordBatch]:
        gram, ctx, doc, twin, loc = rows
        hit = _repeated(gram, ctx, doc)
        yield _windows(doc[hit], twin[hit], loc[hit])
        gram, doc, twin, loc = (x[~hit] for x in (gram, doc, twin, loc))
        if not forced:
            open_ = _shared(gram, loc >> 53, doc) | _shared(gram, (loc >> 43) & 1023, doc)
            gram, doc, twin, loc = (x[open_] for x in (gram, doc, twin, loc))
        _, where, size = np.unique(gram, return_inverse=True, return_counts=True)
        yield _windows(doc, twin, loc, gram, (size[where] > hot) | forced)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        forced = None  # an owner with too many rows to hold, of which some are out already
        for batch in batches:
            rows = _arrays(batch)
            known = ~np.asarray(batch.column(1).is_null())
            yield _windows(rows[2][~known], rows[3][~known], rows[4][~known], runs=True)
            rows = [x[known] for x in rows]
            if not len(rows[0]):
                continue
            held.append(rows)
            ahead = sum(len(h[0]) for h in held)
            if ahead < 4096 and held[0][0][0] == rows[0][-1]:
                continue
            rows = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                done = [x[:cut] for x in rows]
                if forced is not None:
                    mine = done[0] == forced
                    yield from settle([x[mine] for x in done], True)
                    done = [x[~mine] for x in done]
                    forced = None
                if len(done[0]):
                    yield from settle(done, False)
                rows = [x[cut:] for x in rows]
            if len(rows[0]) > most:
                yield from settle(rows, True)
                forced = rows[0][0]
                keep = int(np.flatnonzero(rows[1] == rows[1][-1])[0])  # the first document with the last bytes
                rows = [x[keep : keep + 1] for x in rows]
            held = [rows]
        if held:
            rows = [np.concatenate(x) for x in zip(*held)]
            if len(rows[0]):
                mine = rows[0] == forced if forced is not None else np.zeros(len(rows[0]), bool)
                if mine.any():
                    yield from settle([x[mine] for x in rows], True)
                if not mine.all():
                    yield from settle([x[~mine] for x in rows], False)

    return arrow_map(owned.repartition("gram").sortWithinPartitions("gram", "ctx", "doc"), run, MARKS)


PIECES = "key long, doc long, twin int, start long, n int, piece binary"


def _pieces(opened: DataFrame) -> DataFrame:
    """Bytes of the windows to look at. Windows of hot owners go alone, under their own hash, one document for each in a batch;
    those of later documents are repeats already (no piece).
    """
    target = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, alone = [], {}
            for doc, twin, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                for s in spans:
                    start, n = s["start"], s["n"]
                    if not s["hot"]:
                        out.append((s["gram"], doc, twin, start, n, data[start : start + n + LENGTH - 1]))
                        continue
                    for at in range(start, start + n):
                        alone.setdefault(data[at : at + LENGTH], []).append((doc, twin, at))
                if len(out) > 20_000:
                    yield _table(out, target)
                    out = []
            names = list(alone)
            buf, offsets = joined(names, None, b"\0")
            keys = span_hashes(prefix_hashes(buf), offsets[:-1], offsets[1:] - 1).view(np.int64).tolist() if names else []
            for key, window in zip(keys, names):
                first = min(d for d, _, _ in alone[window])
                for doc, twin, at in alone[window]:
                    out.append((key, doc, twin, at, 1, None if doc > first else window))
            yield _table(out, target)

    return arrow_map(opened, run, PIECES)


def _table(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in target]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)


HITS = "doc long, twin int, start long, n int"


def _sorted_hits(pieces: DataFrame) -> DataFrame:
    """Repeats among the windows of the pieces with the same key."""
    target = arrow_schema(HITS)

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        doc, twin, start, n = (np.array(x, np.int64) for x in list(zip(*rows))[:4])
        data = [r[4] for r in rows]
        begins = np.cumsum([0] + [len(d) for d in data])[:-1]
        buf = np.frombuffer(b"".join(data) + bytes(LENGTH + 16), np.uint8)
        row = np.repeat(np.arange(len(rows)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        order, group = sort_suffixes(buf, begins[row] + within, LENGTH)
        docs = doc[row[order]]
        first = np.minimum.reduceat(docs, np.flatnonzero(np.diff(group, prepend=-1)))
        hit = np.zeros(len(row), bool)
        hit[order] = docs > first[group]
        at = np.flatnonzero(hit)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(at)))
        at = at[begin]
        r = row[at]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[r]), pa.array(twin[r].astype(np.int32)), pa.array(start[r] + within[at]), pa.array(length.astype(np.int32))], schema=target
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            found = []
            for key, doc, twin, start, n, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is None:
                    found.append((doc, twin, start, n))
                    continue
                if size >= SORTED and key != last:
                    yield settle(held)
                    held, size = [], 0
                held.append((doc, twin, start, n, piece))
                size += len(piece)
                last = key
            yield _table(found, target)
        if held:
            yield settle(held)

    return arrow_map(pieces.repartition("key").sortWithinPartitions("key"), run, HITS)


KEPT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _cut_out(found: DataFrame) -> DataFrame:
    target = arrow_schema(KEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for low, high in chunks(texts, 1 << 22):
                part = slice(low, high)
                out = []
                for doc, text, hits in zip(batch.column(0)[part].to_pylist(), texts[part].to_pylist(), batch.column(2)[part]):
                    text = text or b""
                    spans, kept = _merged(hits, text)
                    out.append((doc, len(text), spans, kept))
                yield _table(out, target)

    return arrow_map(found, run, KEPT)


def _merged(hits: pa.ListScalar, text: bytes) -> tuple[list[dict], bytes]:
    """Maximal runs of bytes under the hit windows, and the bytes outside them."""
    if not hits.is_valid or not len(hits.values):
        return [], text
    start, n = (np.asarray(hits.values.field(i)).astype(np.int64) for i in (0, 1))
    order = np.argsort(start, kind="stable")
    low, high = start[order], np.maximum.accumulate((start + n + LENGTH - 1)[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    first = np.flatnonzero(new)
    low, high = low[first], high[np.append(first[1:], len(high)) - 1]
    kept, at = [], 0
    for s, e in zip(low.tolist(), high.tolist()):
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return [{"start": s, "end": e} for s, e in zip(low.tolist(), high.tolist())], b"".join(kept)


def _release(spark) -> None:
    """Lets Spark remove the shuffle files of steps whose results are written.

    Spark does so once the driver has collected its references to them; the first pass frees what the second then finds.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def _with_twins(rows: DataFrame) -> DataFrame:
    """(doc, twin, text) of rows with an id; ``twin`` tells different texts of one id apart and is 0 where an id comes once."""
    named = rows.where("doc_id is not null").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    several = named.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")
    if several.isEmpty():
        return named.select("doc", F.lit(0).alias("twin"), "text")
    hashed = named.withColumn("h", F.xxhash64("text"))
    ranked = hashed.join(several, "doc", "left_semi").select("doc", "h").distinct()
    ranked = ranked.withColumn("twin", F.row_number().over(Window.partitionBy("doc").orderBy("h")))
    return hashed.join(ranked, ["doc", "h"], "left").select("doc", F.coalesce("twin", F.lit(0)).alias("twin"), "text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, most: int = HELD) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes) and kept (the other bytes) of each row.

    A byte goes if a string of 50 bytes over it also starts in a row with a smaller id; strings are judged on the input and
    never cross rows. A null text counts as empty. Rows with one id never remove each other's bytes; a row with a null id
    neither loses nor removes any. Repeated rows are alike. Other columns are left out; an empty table gives an empty one.
    ``hot`` and ``most`` only say how the work on frequent strings is dealt out.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "repeats")
    rows = documents_of(docs, id_col, text_col)
    named = _with_twins(rows)
    marks = stage.put("marks", _marks(_owner_rows(named), hot, most))
    _release(spark)
    opened = marks.where("gram is not null").groupBy("doc", "twin").agg(F.collect_list(F.struct("start", "n", "gram", "hot")).alias("spans"))
    pieces = _pieces(named.join(opened, ["doc", "twin"]).select("doc", "twin", "text", "spans"))
    hits = stage.put("hits", _sorted_hits(pieces))
    _release(spark)
    every = marks.where("gram is null").select("doc", "twin", "start", "n").union(hits)
    spans = every.groupBy("doc", "twin").agg(F.collect_list(F.struct("start", "n")).alias("hits"))
    found = named.join(spans, ["doc", "twin"], "left").select("doc", "text", "hits")
    nameless = rows.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<start:bigint,n:int>>").alias("hits"))
    return _cut_out(found.union(nameless))
