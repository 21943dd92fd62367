"""Row-wise Arrow steps with bounded memory, and vectorised word hashing over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK_BYTES = 1 << 21
_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}
_models: dict = {}


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id as a long and text, under fixed names; other columns go, so their names cannot clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def map_texts(df: DataFrame, fn: Callable[[list, list], Iterable[tuple]], schema: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``fn(ids, texts as bytes or None)`` over (id, text) rows in chunks of at most ``chunk_bytes`` or one row."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for low, high in chunks(texts, chunk_bytes):
                rows = list(fn(ids.slice(low, high - low).to_pylist(), texts.slice(low, high - low).to_pylist()))
                yield to_batch(rows, target)

    return arrow_map(df, run, schema)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose workers find this package also where it is not installed but lies beside the driver's script."""
    environment = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [root, environment.get("PYTHONPATH")]))
    return df.mapInArrow(run, schema)


def remembered(key: object, build: Callable[[], object]) -> object:
    """A model that a worker keeps from task to task; only the last one, so a worker that does other work lets it go."""
    if key not in _models:
        _models.clear()
        _models[key] = build()
    return _models[key]


def forget() -> None:
    """Let go of the model of another step that this worker did before."""
    _models.clear()


def lean_workers(spark: SparkSession) -> None:
    """Python workers started from now on give memory back: large arrays are mapped and unmapped one by one, Arrow takes its memory
    from the same allocator, and matrix products run in the worker's own thread instead of with buffers for every core of the machine.
    For jobs in which many steps share the workers. Settings that are there already stay.
    """
    environment = spark.sparkContext.environment
    for key, value in {
        "MALLOC_MMAP_THRESHOLD_": str(1 << 18),
        "MALLOC_TRIM_THRESHOLD_": str(1 << 20),
        "MALLOC_ARENA_MAX": "2",
        "ARROW_DEFAULT_MEMORY_POOL": "system",
        "OPENBLAS_NUM_THREADS": "1",
    }.items():
        environment.setdefault(key, value)


def to_batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in target]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


def chunks(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay within ``limit``; a longer row stands alone."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    low, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > low and total + n > limit:
            yield low, i
            low, total = i, 0
        total += n
    if len(lengths):
        yield low, len(lengths)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, up to ``n`` excluded."""
    if _powers.get("n", 0) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
        _powers["n"] = size
    if n > 2 * CHUNK_BYTES:  # one very long text: do not hold its powers for ever
        up, down = _powers["up"], _powers["down"]
        _powers.clear()
        return up, down
    return _powers["up"], _powers["down"]


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """Sums over prefixes from which ``span_hashes`` gets the hash of any span."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; the same bytes give the same hash wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def byte_table(separators: Iterable[int]) -> bytes:
    """Translation that lower-cases A-Z and turns separators into spaces."""
    table = bytearray(range(256))
    for c in range(65, 91):
        table[c] = c + 32
    for c in separators:
        table[c] = 32
    return bytes(table)


def word_spans(buf: np.ndarray, separator: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than the separator."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = buf != separator
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def joined(texts: list[bytes | None], table: bytes | None = None, gap: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer with a gap after each, and where each begins (one more entry for the end)."""
    parts = [t or b"" for t in texts]
    offsets = np.cumsum([0] + [len(t) + len(gap) for t in parts])
    data = gap.join(parts) + gap
    return np.frombuffer(data.translate(table) if table else data, np.uint8), offsets


def keep_rows(df: DataFrame, text_col: str, keep: Callable[[list], np.ndarray], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of ``df``, unchanged and with all columns, for which ``keep(texts as bytes or None)`` is true."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())
            for low, high in chunks(texts, chunk_bytes):
                kept = keep(texts.slice(low, high - low).to_pylist())
                yield batch.slice(low, high - low).filter(pa.array(np.asarray(kept, bool)))

    return arrow_map(df, run, df.schema)
