"""Near-duplicate documents by MinHash over word shingles, with minima and maxima of each permutation.

One multiplication per shingle and permutation gives two signature values, the least and the greatest hash, each of
which two sets share with a probability of their Jaccard similarity. Values are banded; documents that share a band
are candidates, and a link counts only once the full sets confirm it.

Documents with equal sets are one class from the start. A bucket never forms all its pairs: first every class is held
against the smallest class it shares a bucket with, then the members of a bucket against its smallest one where they are still in different
components, and what is left in different components is compared in blocks, only members outside a bucket's
largest component against the others. So a bucket of near copies costs about as much as it has members, and no
pair that shares a bucket and could still join two components goes unchecked.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmetrics.llm.batches import arrow_map, arrow_schema, byte_table, chunks, documents_of, joined, mix, prefix_hashes, span_hashes, to_batch, word_spans
from jobmetrics.runtime import Stage

SEPARATORS = [0x20, *range(0x09, 0x0E)]
TABLE = byte_table(SEPARATORS)
#: 160 values in 32 bands of 5: at a similarity of 0.8 a pair shares no band with a probability of 3e-6.
PERMUTATIONS, BANDS, ROWS = 80, 32, 5
#: Members of a bucket that meet in one comparison of blocks, on either side.
BLOCK = 128
_FACTORS = np.random.default_rng(7).integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text; fewer words are one shingle, none are none."""
    buf, offsets = joined(texts, TABLE)
    starts, ends = word_spans(buf)
    words = span_hashes(prefix_hashes(buf), starts, ends)
    first = np.searchsorted(starts, offsets)
    runs = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k if len(runs) else 0):
        runs = runs * _STEP + words[j : j + len(runs)]
    runs = mix(runs)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        if high - low >= k:
            out.append(np.unique(runs[low : high - k + 1]))
        else:
            whole = np.uint64(high - low)
            for w in words[low:high]:
                whole = np.multiply(whole, _STEP) + w
            out.append(mix(np.array([whole], np.uint64)) if high > low else np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least, then greatest hash under each permutation."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 4096):
        hashed = np.multiply.outer(_FACTORS, shingles[at : at + 4096])
        np.minimum(low, hashed.min(axis=1), out=low)
        np.maximum(high, hashed.max(axis=1), out=high)
    return np.concatenate([low, high])


def bands(values: np.ndarray) -> np.ndarray:
    """One number per band. The values of a band come from different permutations."""
    rows = values.reshape(ROWS, BANDS)
    out = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for r in rows:
        out = mix(out * _STEP + r)
    return out.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two non-empty sets have 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a hash of the text that tells rows of one id apart."""
    return documents_of(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))


SIGNATURES = "doc_id long, text_hash long, n long, key binary, bands array<long>"


def signatures(rows: DataFrame, k: int) -> DataFrame:
    """Size, digest and bands of each row's set; no digest and bands for an empty one."""
    target = arrow_schema(SIGNATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hashes = batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)
            for low, high in chunks(texts, 1 << 21):
                part = slice(low, high)
                out = []
                for doc, th, s in zip(ids[part].to_pylist(), hashes[part].to_pylist(), shingle_sets(texts[part].to_pylist(), k)):
                    full = len(s) > 0
                    out.append((doc, th, len(s), blake2b(s.tobytes(), digest_size=16).digest() if full else None, bands(signature(s)) if full else None))
                yield to_batch(out, target)

    return arrow_map(rows, run, SIGNATURES)


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are linked."""
    both = (
        pairs.select("a", "b")
        .join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    target = arrow_schema("a binary, b binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            for low, high in chunks(left, 1 << 20):
                part = slice(low, high)
                names = list(zip(batch.column(0)[part].to_pylist(), batch.column(1)[part].to_pylist()))
                known = dict(zip([a for a, _ in names], left[part].to_pylist())) | dict(zip([b for _, b in names], right[part].to_pylist()))
                sets = dict(zip(known, shingle_sets(list(known.values()), k)))
                yield to_batch([(a, b) for a, b in names if linked(sets[a], sets[b], percent)], target)

    return arrow_map(both, run, "a binary, b binary")


def _compare_blocks(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between members of one block pair (``block``) that are in different components, sides ``left`` and not."""
    schema = "a binary, b binary"
    target = arrow_schema(schema)
    rows = members.join(texts, "key").select("block", "left", "key", "comp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def done() -> pa.RecordBatch:
            known = {key: text for _, key, _, text in held}
            sets = dict(zip(known, shingle_sets([t.encode() for t in known.values()], k)))
            right = [(key, comp) for left, key, comp, _ in held if not left]
            found = []
            for key, comp in ((key, comp) for left, key, comp, _ in held if left):
                met = {comp}
                for other, theirs in right:
                    if theirs not in met and linked(sets[key], sets[other], percent):
                        found.append((key, other))
                        met.add(theirs)
            return to_batch(found, target)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != block:
                    if held:
                        yield done()
                    block, held = row[0], []
                held.append(row[1:])
        if held:
            yield done()

    return arrow_map(rows.repartition("block").sortWithinPartitions("block"), run, schema)


def components(links: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(key, root) of every key in ``links``, root being the smallest key that can be reached.

    Each round takes the smallest label of the neighbours and then the label of that label, until none changes.
    """
    edges = stage.put(f"{name}-edges", links.select(F.col("a").alias("key"), F.col("b").alias("to")).union(links.select("b", "a")).distinct())
    labels = stage.put(f"{name}-0", edges.groupBy("key").agg(F.min("to").alias("root")).select("key", F.least("key", "root").alias("root")))
    r = 0
    while True:
        theirs = labels.select(F.col("key").alias("to"), F.col("root").alias("their"))
        near = edges.join(theirs, "to").groupBy("key").agg(F.min("their").alias("their"))
        closer = labels.join(near, "key").select("key", F.col("root").alias("was"), F.least("root", "their").alias("root"))
        jump = labels.select(F.col("key").alias("root"), F.col("root").alias("beyond"))
        r += 1
        moved = stage.put(f"{name}-{r}", closer.join(jump, "root").select("key", "was", F.least("root", "beyond").alias("root")))
        stage.drop(f"{name}-{r - 1}")
        labels = moved.select("key", "root")
        if moved.where("root <> was").isEmpty():
            stage.drop(f"{name}-edges")
            return labels


def _labelled(grouped: DataFrame, labels: DataFrame) -> DataFrame:
    return grouped.join(labels, "key", "left").select("bucket", "key", "lead", F.coalesce("root", "key").alias("comp"))


def _mixed(members: DataFrame, *more: Column) -> DataFrame:
    """Buckets with members of several components."""
    return members.groupBy("bucket").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), *more).where("_low < _high").drop("_low", "_high")


def _blocks(members: DataFrame) -> DataFrame:
    """Rows (block, left, key, comp): members outside the largest component of their bucket on the left, all on the right.

    Buckets with the same members are compared once. Both sides are dealt into blocks of about ``BLOCK``, and each
    left block meets each right one.
    """
    name = F.xxhash64("key")
    mixed = _mixed(members, F.count("*").alias("n"), F.bit_xor(name).alias("x"), F.sum(F.shiftright(name, 8)).alias("s"))
    once = mixed.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    sizes = members.join(once.select("bucket"), "bucket", "left_semi").groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    major = sizes.groupBy("bucket").agg(F.max(F.struct("size", "comp")).alias("major")).select("bucket", F.col("major.comp").alias("major"), F.col("major.size").alias("size"))
    dealt = (
        members.join(once, "bucket").join(major, "bucket")
        .withColumn("right_blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("left_blocks", F.ceil((F.col("n") - F.col("size")) / BLOCK).cast("int"))
        .withColumn("i", F.pmod(F.xxhash64("key", F.lit(1)), F.col("left_blocks")).cast("int"))
        .withColumn("j", F.pmod(F.xxhash64("key", F.lit(2)), F.col("right_blocks")).cast("int"))
    )
    block = F.concat_ws(":", F.col("bucket").cast("string"), F.col("i").cast("string"), F.col("j").cast("string")).alias("block")
    left = dealt.where("comp <> major").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1)))
    right = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)))
    return left.select(block, F.lit(True).alias("left"), "key", "comp").union(right.select(block, F.lit(False).alias("left"), "key", "comp"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept and representative of each row.

    Rows are linked if 100 * intersection >= ``percent`` * union of their sets of k-word shingles. ``component_id`` is
    the smallest id that can be reached by links, ``kept`` tells whether it is the row's own, and ``representative`` marks
    one (doc_id, text_hash) in each component: the one with the smallest id, then the smallest hash. A null or empty
    text, or one of white space, has an empty set and is linked with nothing. A null id never becomes a component_id
    where another is there, and is never kept; rows that share an id are linked only by their texts. Repeated rows are
    alike in all columns. Other columns are left out; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "minhash")
    rows = _rows(docs, id_col, text_col)
    signed = stage.put("signatures", signatures(rows, k))
    who = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    classes = signed.where("n > 0").groupBy("key").agg(F.min(who).alias("first"), F.first("bands").alias("bands"))
    sets = stage.put("sets", classes)

    members = sets.select("key", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("key").alias("lead"), F.max("key").alias("last")).where("lead < last")
    grouped = stage.put("grouped", members.join(shared, "bucket").select("bucket", "key", "lead"))
    wanted = sets.join(grouped.select("key"), "key", "left_semi").select("key", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("th"))
    same = rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["text_hash"] == wanted["th"])
    texts = stage.put("texts", rows.join(wanted, same).select("key", "text").dropDuplicates(["key"]))

    nearest = grouped.where("key <> lead").groupBy("key").agg(F.min("lead").alias("b")).select(F.col("key").alias("a"), "b")
    links = stage.put("links-a", _confirm(nearest, texts, k, percent))
    labels = components(links, stage, "a")

    open_ = _labelled(grouped, labels)
    lead = F.min(F.struct("key", "comp")).alias("first")
    star = open_.join(_mixed(open_, lead), "bucket").where("key <> lead and comp <> first.comp").select(F.col("key").alias("a"), F.col("lead").alias("b"))
    more = stage.put("links-b", _confirm(star.distinct().join(nearest, ["a", "b"], "left_anti"), texts, k, percent))
    links = links.union(more)
    labels = components(links, stage, "b")

    rest = stage.put("rest", _labelled(grouped, labels).where("key <> lead"))
    last = stage.put("links-c", _compare_blocks(_blocks(rest), texts, k, percent))
    labels = components(links.union(last), stage, "c")

    joined_ = labels.join(sets.select("key", "first"), "key")
    heads = joined_.groupBy("root").agg(F.min("first").alias("head"))
    of_linked = joined_.join(heads, "root").select("key", "head")
    heads = stage.put("heads", sets.select("key", "first").join(of_linked, "key", "left").select("key", F.coalesce("head", "first").alias("head")))
    stage.drop("grouped", "texts", "rest", "links-a", "links-b", "links-c", "sets")

    found = signed.drop("bands").join(heads, "key", "left")
    return found.select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.coalesce(F.col("head.doc_id"), F.col("doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce(F.col("head.doc_id"), F.col("doc_id")), F.lit(False)).alias("kept"),
        (F.col("head").isNull() | (F.col("head") == who)).alias("representative"),
    )
