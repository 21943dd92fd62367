"""Phrases that stand together more often than their parts would, by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a cycle. Words are counted from the first shard on. At the stop after each
shard, phrases whose count has come to the threshold are marked as reached; a phrase of one more word is counted from the next
shard on once both the phrase without its last and the one without its first word have been reached, until it is
reached itself or has been through one full cycle. So lengths are counted side by side, and a phrase whose parts are
rare is never counted.

What is reached is held in filters of a fixed size: for each slot the first stop at which a reached phrase fell into it. A
phrase counts as reached from the largest stop of its slots on. That is never later than the true stop and never changes once
it is there, so every task sees the same beginning of a phrase's cycle. The scans count by 64-bit hash, which can only
mark too much. A last pass counts what is marked by its words: these counts are exact, and what chance let in falls out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobmetrics.llm.batches import arrow_map, arrow_schema, chunks, mix, prefix_hashes, span_hashes
from jobmetrics.operators.skew import lookup, top_per_key
from jobmetrics.runtime import Stage

#: Phrases up to so many words, counted in full from this many occurrences on; how many a language reports.
MAX_WORDS, LEAST, TOP = 3, 10, 2000
#: A phrase goes if a longer one accounts for this share of its occurrences, in percent.
ABSORBED = 50
#: Stops in a cycle. More of them let longer phrases begin earlier, and cost a job each.
SHARDS = 3
#: Slots of the filter for each length (a byte each, in the driver and in every worker), whatever the size of the corpus: a
#: fuller filter lets more phrases be counted in vain, and changes no result.
FILTER_BITS = 24
NO_LANG = "und"
_NEVER = 255
_BREAK = b"\xff"  # in no UTF-8 text
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_OPEN = "h long, tag int, n long"
_COUNTED = "size int, lang string, phrase string, n long"


def _letters() -> bytes:
    """Lower case for A-Z, a break for what ends a piece, a space for a tab."""
    table = bytearray(range(256))
    table[65:91] = bytes(range(97, 123))
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = _BREAK[0]
    table[9] = 32
    return bytes(table)


TABLE = _letters()


class Filter:
    """For each slot the first stop at which something reached fell into it, 255 for none."""

    def __init__(self, bits: int):
        self.bits, self.slots = bits, np.full(1 << bits, _NEVER, np.uint8)

    def reached(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        return np.maximum(self.slots[(h & mask).astype(np.int64)], self.slots[(h >> np.uint64(64 - self.bits)).astype(np.int64)])

    def add(self, rows: DataFrame, stop: int) -> bool:
        """Mark the slots of the rows' hashes; whether there were any. What comes to the driver is at most a bit for each slot."""
        mask = F.lit((1 << self.bits) - 1)
        slot = F.explode(F.array(F.col("h").bitwiseAND(mask) + 1, F.shiftrightunsigned("h", 64 - self.bits) + 1))
        found = (
            rows.select(slot.alias("slot"))
            .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
            .collect()
        )
        for r in found:
            set_ = np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")) + (r["bucket"] - 1) * len(r["bits"]) * 8
            set_ = set_[set_ < len(self.slots)]
            self.slots[set_] = np.minimum(self.slots[set_], stop)
        return bool(found)


class _Numbers(dict):
    """A number for each word, in the order in which they come up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Spots:
    """Where the phrases of each length begin in the texts of one language, with their hashes and when they were reached."""

    def __init__(self, lang: str, texts: list[bytes], filters: list[Filter]):
        self.data, self.filters = _BREAK.join(texts).translate(TABLE), filters
        buf = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = (buf != 32) & (buf != _BREAK[0])
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.piece = np.searchsorted(np.flatnonzero(buf == _BREAK[0]), starts)
        self.hashes = mix(span_hashes(prefix_hashes(buf), starts, ends) + np.uint64(xxhash.xxh32_intdigest(lang.encode())))

    def lengths(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """size, then by position: inside a piece, hash, stop at which both parts were reached, stop at which it was itself."""
        n, h, at = len(self.piece), self.hashes, self.filters[0].reached(self.hashes)
        yield 1, np.ones(n, bool), h, np.zeros(n, np.uint8), at
        for size in range(2, len(self.filters) + 1):
            m = n - size + 1
            if m <= 0:
                return
            since = np.maximum(at[:m], at[1 : m + 1])
            here = self.piece[:m] == self.piece[size - 1 :]
            h = mix(h[:m] * _FACTOR + self.hashes[size - 1 :])
            at = np.full(m, _NEVER, np.uint8)
            known = np.flatnonzero(here & (since < _NEVER))
            at[known] = self.filters[size - 1].reached(h[known])
            yield size, here, h, since, at

    def open_(self, stop: int, shards: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Hashes, tags (length and stop of the parts) and counts of what is being counted at this stop and not reached yet."""
        for size, here, h, since, at in self.lengths():
            active = here & (at == _NEVER) & (since < stop) & (since.astype(int) >= stop - shards)
            found, first, n = np.unique(h[active], return_index=True, return_counts=True)
            if len(found):
                yield found, size * 256 + since[active][first].astype(np.int64), n

    def counted(self) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        """size, phrases and counts of all that has been reached, by their words; size 0 is the number of all words."""
        if not len(self.piece):
            return
        number, words = _Numbers(), self.data.replace(_BREAK, b" ").split()
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        names = pa.array(list(number), pa.binary()).cast(pa.string())
        yield 0, pa.array([""]), np.array([len(words)])
        for size, here, _, _, at in self.lengths():
            place = np.flatnonzero(here & (at != _NEVER))
            code = ids[place]
            for k in range(1, size - 1):
                code = np.unique(code << 32 | ids[place + k], return_inverse=True)[1]
            if size > 1:
                code = code << 32 | ids[place + size - 1]
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            if len(place):
                parts = [names.take(pa.array(ids[place[first] + k])) for k in range(size)]
                yield size, pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0], n


def _by_lang(batch: pa.RecordBatch, chunk_bytes: int = 1 << 21) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of each language in chunks."""
    langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
    for low, high in chunks(texts, chunk_bytes):
        own: dict[str, list[bytes]] = {}
        for lang, text in zip(langs[low:high], texts.slice(low, high - low).to_pylist()):
            own.setdefault(lang, []).append(text)
        yield from own.items()


def _scan(shard: DataFrame, shared: Broadcast, stop: int, shards: int) -> DataFrame:
    target = arrow_schema(_OPEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_lang(batch, 1 << 20):
                for h, tag, n in _Spots(lang, texts, shared.value).open_(stop, shards):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tag.astype(np.int32)), pa.array(n)], schema=target)

    return arrow_map(shard, run, _OPEN)


def _count(docs: DataFrame, shared: Broadcast) -> DataFrame:
    target = arrow_schema(_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_lang(batch):
                for size, phrases, n in _Spots(lang, texts, shared.value).counted():
                    k = len(phrases)
                    columns = [pa.array(np.full(k, size, np.int32)), pa.array([lang] * k, pa.string()), phrases.cast(pa.string()), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, schema=target)

    return arrow_map(docs, run, _COUNTED)


def frequent_phrases(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    least: int = LEAST,
    shards: int = SHARDS,
    filter_bits: int = FILTER_BITS,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """size, lang, phrase, n of all phrases of up to ``max_words`` words with ``least`` or more occurrences; size 0 has all words of a language.

    A null language is ``und``, a null text empty. Ids do not matter, and repeated rows count as often as they occur. An
    empty table, or one without words, gives no row.
    """
    if not (max_words >= 1 and shards >= 1 and 3 <= filter_bits <= 31 and shards * max_words < _NEVER):
        raise ValueError("max_words, shards or filter_bits out of range")
    spark = docs.sparkSession
    stage = Stage(spark, "phrases")
    texts = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    dealt = texts.withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int"))
    stage.paths["corpus"] = f"{stage.root}/corpus"
    dealt.write.partitionBy("shard").parquet(stage.paths["corpus"])
    corpus = spark.read.schema(dealt.schema).parquet(stage.paths["corpus"])
    filters = [Filter(filter_bits) for _ in range(max_words)]
    last = [0] + [-shards] * max_words  # the last stop at which something of each length came in; words can begin at once
    schema, stop, left = StructType.fromDDL(_OPEN + ", reached boolean"), 0, None
    while stop < max(last[:-1]) + shards:
        stop += 1
        shared = spark.sparkContext.broadcast(filters)
        found = _scan(corpus.where(F.col("shard") == (stop - 1) % shards).select("lang", "text"), shared, stop, shards)
        if left is not None:
            found = found.unionByName(left)
        merged = found.groupBy("h", "tag").agg(F.sum("n").alias("n")).withColumn("reached", F.col("n") >= least)
        # Others go when their cycle is over.
        going_on = F.lit(stop) < F.col("tag").bitwiseAND(255) + shards
        path = stage.paths[f"stop-{stop}"] = f"{stage.root}/stop-{stop}"
        merged.where(F.col("reached") | going_on).write.partitionBy("reached").parquet(path)
        shared.destroy()
        written = spark.read.schema(schema).parquet(path)
        for size, f in enumerate(filters, 1):
            if stop <= last[size - 1] + shards and f.add(written.where(F.col("reached") & (F.shiftright("tag", 8) == size)), stop):
                last[size] = stop
        if left is not None:
            stage.drop(f"stop-{stop - 1}")
        left = written.where("not reached").select("h", "tag", "n")
    stage.drop("corpus", f"stop-{stop}")
    shared = spark.sparkContext.broadcast(filters)
    sums = _count(texts, shared).groupBy("size", "lang", "phrase").agg(F.sum("n").alias("n"))
    out = stage.put("frequent", sums.where((F.col("n") >= least) | (F.col("size") == 0)))
    shared.destroy()
    return out


def collocations(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    least: int = LEAST,
    top: int = TOP,
    absorbed: int = ABSORBED,
    shards: int = SHARDS,
    filter_bits: int = FILTER_BITS,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of two and more words in each language.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts at the cut with the lowest score (of equal ones the
    first), ``n`` that of all words, score floor(1000000 a a / (l r)), exact up to counts of 10^15. Phrases inside a longer one
    with ``absorbed`` percent or more of their occurrences are left out. Order: score, count, then bytes of the phrase.
    Nulls, ties, repeated rows and empty tables as in ``frequent_phrases``.
    """
    found = frequent_phrases(docs, max_words, least, shards, filter_bits, text_col, lang_col)
    words, size = F.split("phrase", " "), F.col("size")
    candidates = found.where("size >= 2")

    def part(first, length):
        return F.array_join(F.slice(words, first, length), " ")

    cut = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "size", F.col("n").alias("a"), cut)
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, size - F.col("k")).alias("right"))
    counts = found.where("size >= 1").groupBy("lang", "phrase").agg(F.max("n").alias("n"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = lookup(cuts, counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    wide = F.col("a").cast("decimal(19,0)")
    square = (wide * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(23,0)") * F.col("a").cast("decimal(15,0)")
    product = F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")
    cuts = cuts.withColumn("_square", square).withColumn("_product", product).withColumn("score", F.expr("_square div _product"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    scored = cuts.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    inner = F.explode(F.sequence(F.lit(2), size - 1)).alias("length")
    longer = candidates.where("size > 2").select("lang", "phrase", "size", "n", inner)
    longer = longer.select("*", F.explode(F.sequence(F.lit(1), size - F.col("length") + 1)).alias("first"))
    longer = longer.select("lang", part(F.col("first"), F.col("length")).alias("phrase"), "n")
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("inside"))
    kept = lookup(scored, longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("inside") * 100 < F.col("a") * absorbed, F.lit(True)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = top_per_key(kept.drop("inside"), ["lang"], order, top)
    ranked = first.join(found.where("size = 0").select("lang", "n"), "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return ranked.select("lang", rank.cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
