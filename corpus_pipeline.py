"""A training corpus from documents: without toxic texts, near copies, benchmark passages and secrets, then as token ids.

Each stage reads what the one before has written. All but the last keep the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmetrics.llm import decontamination, minhash, secret_scan, sentencepiece_bpe, toxicity
from jobmetrics.llm.batches import lean_workers
from jobmetrics.llm.queries import table, vocabulary
from jobmetrics.runtime import Stage

Step = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score is 0.7 or more; texts without known terms stay."""
    lean_workers(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % of its five-word shingles: the one with the smallest id. Texts without words all stay.

    Rows alike in id and text are one document; of several texts under one id in a group, one stays.
    """
    kept = minhash.near_duplicates(docs, k=5).where("representative").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    hashed = docs.withColumn("_hash_", F.xxhash64(F.col("text").cast("string")))
    stays = hashed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_hash_") == F.col("_hash")), "left_semi")
    several = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not several.isEmpty():
        stays = stays.dropDuplicates(["doc_id", "_hash_"])
    return stays.select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which ten words in a row of a benchmark item occur, or the whole of a shorter one."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; ``n_chars`` follows."""
    scanned = secret_scan.scan_secrets(docs, spans_col="_spans_")
    # A step of its own: in one with a new ``text``, the functions inside would read that one.
    clean = scanned.withColumn("_clean_", secret_scan.redact(F.col("text"), F.col("_spans_")))
    changed = F.size("_spans_") > 0
    columns = {"text": F.when(changed, F.col("_clean_")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(changed, F.length("_clean_").cast(kind)).otherwise(F.col("n_chars"))
    return clean.select(*(columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded text."""
    encoded = sentencepiece_bpe.encode_texts(docs, vocabulary("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Step]] = [
    ("toxicity", without_toxic),
    ("minhash", without_near_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("sentencepiece", as_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written to the shared folder and read again by the next."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage.put(name, step(spark, docs, sf_dir))
    stage.drop(*(name for name, _ in STAGES[:-1]))
    return docs


#: No SQL: learned scores, hashes and the tokenizer cannot be put in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
