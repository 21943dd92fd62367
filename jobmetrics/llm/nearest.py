"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact distances.

Each table turns unit vectors by sign flips and Hadamard transforms and files them under the signed axis they come nearest to. A
query looks into the cells of the axes nearest to it, in every table, and takes the exact distance to all that it finds
there. How many tables and cells that takes is measured, for each width: a sample of the queries is held against all entries,
and the fewest tables times cells with which ``GOAL`` of the sample's true neighbours are seen are taken for all. Equal vectors
are one entry with the smallest ids that can be in a result. Cells are worked on in blocks of bounded size, however many
vectors share one. A query that finds too few is held against all entries, in blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmetrics.llm.batches import arrow_map, arrow_schema, to_batch
from jobmetrics.runtime import Stage

#: At most so many tables; tables and probes are the cheapest that show this share of the neighbours of so many queries of a width.
TABLES, GOAL, SAMPLE = 8, 0.97, 256
ROUNDS = 3
#: Entries of a cell that are held in memory at a time.
BLOCK = 4096
FOUND = "query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x


def turned(x: np.ndarray, table: int) -> np.ndarray:
    """Unit vectors, padded to a power of two and pseudo-rotated by the table's signs."""
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), width))
    scale = np.abs(x).max(axis=1, keepdims=True)  # keeps squares of extreme components finite
    scaled = x / scale
    out[:, : x.shape[1]] = scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))
    rng = np.random.default_rng([table, x.shape[1]])
    for _ in range(ROUNDS):
        out = hadamard(out * rng.choice([-1.0, 1.0], width)) / np.sqrt(width)
    return out


def cells(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """For each row the axes nearest to it, best first: twice the axis, plus one for its negative side."""
    y = turned(x, table)
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    k = min(probes, both.shape[1])
    best = np.argpartition(-both, k - 1, axis=1)[:, :k]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(both, best, axis=1), axis=1, kind="stable"), axis=1)


def usable(vector: Column) -> Column:
    """Vectors with components, all finite, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and float64 rows of the vectors, by width."""
    lengths = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten(), dtype=np.float64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    return [(rows := np.flatnonzero(lengths == w), values[begins[rows][:, None] + np.arange(w)]) for w in np.unique(lengths).tolist()]


def _filed(rows: DataFrame, shapes: dict[int, tuple[int, int]]) -> DataFrame:
    """Each row once for every table and probe of its width, with the cell it goes to. Widths without a shape are left out."""
    schema = "cell string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    target = arrow_schema(schema)
    place = rows.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for numbers, x in _matrix(part.column(place)):
                    tables, probes = shapes.get(x.shape[1], (0, 0))
                    for t in range(tables):
                        for axes in cells(x, t, probes).T:
                            named = pa.array([f"{x.shape[1]}:{t}:{a}" for a in axes.tolist()])
                            taken = part.take(pa.array(numbers))
                            yield pa.RecordBatch.from_arrays([named, *(c.cast(f.type) for c, f in zip(taken.columns, list(target)[1:]))], schema=target)

    return arrow_map(rows, run, schema)


def _distances(filed: DataFrame, probing: DataFrame, k: int, block: int) -> DataFrame:
    """The ``k`` nearest (query_id, vec_id, score) of each query in each cell and block."""
    sizes = filed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    held = filed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("ids"), F.col("blocks")).cast("int"))
    asked = probing.join(sizes, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    none = F.lit(None)
    rows = held.select("cell", "block", none.cast("long").alias("query_id"), "ids", "vector").unionByName(
        asked.select("cell", "block", "query_id", none.cast("array<bigint>").alias("ids"), "vector")
    )
    rows = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", F.col("query_id").asc_nulls_first())
    target = arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, vectors, ids, matrix = None, [], [], None
        for batch in batches:
            found = []
            for cell, part, query, own, vector in zip(*(batch.column(i).to_pylist() for i in range(4)), _vectors(batch.column(4))):
                if current != (cell, part):
                    current, vectors, ids, matrix = (cell, part), [], [], None
                if query is None:
                    vectors.append(vector)
                    ids.append(own)
                    continue
                if not vectors:
                    continue
                if matrix is None:
                    matrix = np.array(vectors)
                gap = matrix - vector
                d = np.sqrt((gap * gap).sum(axis=1))
                found.extend((query, v, s) for s, v, _ in _closest(d, ids, query, k))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(target)], schema=target)

    return arrow_map(rows, run, FOUND)


def _closest(d: np.ndarray, ids: list[list[int]], query: int, k: int) -> list[tuple[float, int, int]]:
    """Distance, id and place of the ``k`` nearest ids but the query's own, each with its nearest vector, ties to the smaller id."""
    take = k + 1
    while True:
        near = np.flatnonzero(d <= np.partition(d, take - 1)[take - 1]) if take < len(d) else np.arange(len(d))
        best: dict[int, tuple[float, int]] = {}
        for i in near[np.argsort(d[near], kind="stable")].tolist():
            for v in ids[i]:
                if v != query:
                    best.setdefault(v, (float(d[i]), i))
        if len(best) >= k or len(near) == len(d):
            return sorted((s, v, i) for v, (s, i) in best.items())[:k]
        take *= 2  # some ids have several vectors here


def _vectors(column: pa.Array) -> Iterator[np.ndarray]:
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.flatten(), dtype=np.float64)
    for s, e in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0]):
        yield values[s:e]


def _shown(entries: DataFrame, sample: list[tuple[int, np.ndarray]], k: int, tables: int) -> DataFrame:
    """The entries nearest to each sampled query, at least the ``k`` nearest of all, by full comparison: number of the query,
    vec_id, score, and the probes with which the first table, the first two and so on show the entry."""
    schema = "n int, vec_id long, score double, probes array<int>"
    target = arrow_schema(schema)
    shared = entries.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, best = defaultdict(list), defaultdict(list)
        for n, (_, vector) in enumerate(shared.value):
            numbered[len(vector)].append(n)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = part.column(0).to_pylist()
                for numbers, x in _matrix(part.column(1)):
                    for n in numbered.get(x.shape[1], ()):
                        query, vector = shared.value[n]
                        gap = x - vector
                        d = np.sqrt((gap * gap).sum(axis=1))
                        near = np.flatnonzero(d <= (best[n][-1][0] if len(best[n]) == k else np.inf))
                        new = _closest(d[near], [ids[numbers[i]] for i in near.tolist()], query, k)
                        if new:
                            every = sorted(best[n] + [(s, v, x[near[i]].copy()) for s, v, i in new], key=lambda c: c[:2])
                            nearest_of = {v: (s, v, vector) for s, v, vector in reversed(every)}
                            best[n] = sorted(nearest_of.values(), key=lambda c: c[:2])[:k]
        rows = []
        for asked in numbered.values():
            near = [(i, n, *c) for i, n in enumerate(asked) for c in best[n]]
            if near:
                of, x, queries = [c[0] for c in near], np.array([c[4] for c in near]), np.array([shared.value[n][1] for n in asked])
                places = [np.argmax(cells(queries, t, 1 << 62)[of] == cells(x, t, 1), axis=1) + 1 for t in range(tables)]
                probes = np.minimum.accumulate(places).T.tolist()
                rows.extend((n, v, score, p) for (_, n, score, v, _), p in zip(near, probes))
        yield to_batch(rows, target)

    return arrow_map(entries.select("ids", "vector"), run, schema)


def _shapes(entries: DataFrame, asked: DataFrame, k: int, tables: int) -> dict[int, tuple[int, int]]:
    """For each width of a query the tables and probes with the least product that show ``GOAL`` of the sample's neighbours."""
    some = F.row_number().over(Window.partitionBy(F.size("vector")).orderBy(F.xxhash64("query_id", "vector"), "query_id"))
    picked = asked.withColumn("n", some).where(F.col("n") <= SAMPLE).select("query_id", "vector").collect()
    sample = [(r["query_id"], np.array(r["vector"], np.float64)) for r in picked]
    shapes, needed = {len(v): (1, 1) for _, v in sample}, defaultdict(list)
    if sample:
        rank = F.row_number().over(Window.partitionBy("n").orderBy("score", "vec_id"))
        for r in _shown(entries, sample, k, tables).withColumn("rank", rank).where(F.col("rank") <= k).select("n", "probes").collect():
            needed[len(sample[r["n"]][1])].append(r["probes"])
    for width, probes in needed.items():
        enough = np.sort(np.array(probes), axis=0)[int(np.ceil(GOAL * len(probes))) - 1]
        t = int(np.argmin(enough * np.arange(1, tables + 1)))
        shapes[width] = (t + 1, int(enough[t]))
    return shapes


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    probes: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found for each row that ``queries`` (on ``vec_id``) picks.

    The score is the Euclidean distance in double precision; ties go to the smaller id. A query's own id is no candidate;
    an id with several vectors counts with its nearest one. Vectors that are null, empty, zero or not finite throughout
    take no part, nor do null ids; vectors of other widths never meet. All candidates are given if there are fewer than ``k``.
    Repeated rows count once; other columns are left out; an empty table gives an empty one. With ``probes`` given, all of
    ``tables`` are used with so many probes, and nothing is measured.
    """
    stage = Stage(vectors.sparkSession, "nearest")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).distinct()
    # Of equal vectors only the k + 1 smallest ids can be in a result: one of them may be the query's own.
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    entries = stage.put("entries", rows.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "vector")
    if probes is None:
        shapes = _shapes(entries, asked, k, tables)
    else:
        shapes = {r["w"]: (tables, probes) for r in asked.select(F.size("vector").alias("w")).distinct().collect()}
    filed = _filed(entries, {width: (t, 1) for width, (t, _) in shapes.items()})
    found = stage.put("found", _distances(filed, _filed(asked, shapes), k, block))

    def best(pairs: DataFrame) -> DataFrame:
        once = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return once.withColumn("rank", rank).where(F.col("rank") <= k)

    full = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= k)
    short = stage.put("short", asked.join(full, "query_id", "left_anti"))
    if not short.isEmpty():
        wide = F.size("vector").cast("string").alias("cell")
        found = found.unionByName(_distances(entries.select(wide, "ids", "vector"), short.select(wide, "query_id", "vector"), k, block))
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
