"""Toxicity by a factorization machine over hashed terms.

Terms are words and beginnings of words, as 64-bit hashes; a text has each of its terms once. The machine adds to the
weights of single terms the products of learned vectors of each two, so that a pair can count for more than its parts.
Terms are chosen on the training rows in two ways. Alone, by their chi-squared statistic with the label, those that speak for it: a
harmless word takes nothing back. In company, whichever way they speak alone, those of pairs in which each term tells
something about the label among the texts that have the other, by log-likelihood ratios of all pairs of frequent terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmetrics.llm.batches import arrow_map, arrow_schema, byte_table, chunks, documents_of, forget, joined, keep_rows, map_texts, mix, prefix_hashes, span_hashes, to_batch, word_spans

#: Everything in ASCII but letters separates words.
TABLE = byte_table([*range(65), *range(91, 97), *range(123, 128)])
#: Beginnings of words that are terms, in bytes.
PREFIXES = (3, 4, 5)
#: At most so many labelled texts are learned from (those with the smallest hashes of their ids), and so many terms kept.
TRAINING_ROWS, TERMS = 12_000, 4096
LEAST_TEXTS, LEAST_CHI = 3, 12.0
#: Terms whose pairs are looked at (those in the largest share of either class), how many of them are kept besides, from which ratio on.
PAIRED, COMPANY, LEAST_RATIO = 4096, 1024, 40.0
_PAIR_BLOCK = 512
#: Errors on positive rows, which are few, count this many times.
POSITIVE_WEIGHT = 3.0
FACTORS, EPOCHS, BATCH, RATE, PENALTY = 8, 40, 256, 0.1, 1e-3
THRESHOLD = 0.7
_FILTER_BITS = 20


def terms(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of each word and each beginning of a word, repeats included."""
    lowered = [t.decode().lower().encode() if t else b"" for t in texts]
    buf, offsets = joined(lowered, TABLE)
    starts, ends = word_spans(buf)
    prefix = prefix_hashes(buf)
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
    rows, hashes = [row], [span_hashes(prefix, starts, ends)]
    for n in PREFIXES:
        longer = ends - starts > n
        rows.append(row[longer])
        hashes.append(mix(span_hashes(prefix, starts[longer], starts[longer] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(hashes)


@dataclass
class Machine:
    """Sorted hashes of the kept terms, their weights and vectors."""

    known: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def __post_init__(self) -> None:
        self.likely = np.zeros(1 << _FILTER_BITS, bool)
        self.likely[(self.known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def features(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, place of the term) of the kept terms."""
        row, h = terms(texts)
        near = self.likely[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        row, h = row[near], h[near]
        place = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        hit = self.known[place] == h if len(self.known) else np.zeros(len(h), bool)
        pairs = np.unique(row[hit] * np.int64(len(self.known) or 1) + place[hit])
        return pairs // (len(self.known) or 1), pairs % (len(self.known) or 1)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Probability of the label, 0 to 1, of each text."""
        return sigmoid(self.margins(len(texts), *self.features(texts))[0])

    def margins(self, n: int, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margin of each of ``n`` rows, and the sums of their vectors."""
        sums, squares = np.zeros((n, self.vectors.shape[1])), np.zeros(n)
        np.add.at(sums, row, self.vectors[place])
        np.add.at(squares, row, (self.vectors[place] ** 2).sum(axis=1))
        linear = np.bincount(row, self.weights[place], n)
        return self.bias + linear + ((sums**2).sum(axis=1) - squares) / 2, sums


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def in_training(doc_id: Column) -> Column:
    """Whether a row's label may be learned: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _train(machine: Machine, rows: list[np.ndarray], labels: np.ndarray) -> None:
    """Logistic loss by AdaGrad in small batches of a fixed order."""
    rng = np.random.default_rng(11)
    n_terms, k = machine.vectors.shape
    grad_w, grad_v, grad_b = np.full(n_terms, 1e-6), np.full((n_terms, k), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            place = np.concatenate([rows[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            margin, sums = machine.margins(len(part), row, place)
            error = (sigmoid(margin) - labels[part]) * np.where(labels[part] > 0, POSITIVE_WEIGHT, 1.0)
            used, where = np.unique(place, return_inverse=True)
            gw = np.bincount(where, error[row], len(used)) / len(part) + PENALTY * machine.weights[used]
            gv = np.zeros((len(used), k))
            np.add.at(gv, where, error[row, None] * (sums[row] - machine.vectors[place]))
            gv = gv / len(part) + PENALTY * machine.vectors[used]
            grad_w[used] += gw**2
            grad_v[used] += gv**2
            grad_b += error.mean() ** 2
            machine.weights[used] -= RATE * gw / np.sqrt(grad_w[used])
            machine.vectors[used] -= RATE / 2 * gv / np.sqrt(grad_v[used])
            machine.bias -= RATE * error.mean() / np.sqrt(grad_b)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine learned from at most ``rows`` labelled texts whose ids are ``in_training``.

    Labels other than 0 and 1, null ids and labels without a text are left out; of several labels of an id the larger
    counts; of an id with several texts each is learned, but of all texts at most ``rows``, those with the smallest hashes.
    Equal texts count once. Without any label the machine gives 0.5 throughout.
    """
    chosen = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & in_training(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = documents_of(docs, id_col, text_col).where("text is not null")
    training = texts.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows
    training = training.select("label", "text").groupBy(F.xxhash64("text").alias("h")).agg(F.max("label").alias("label"), F.first("text").alias("text"))
    # An id may stand on any number of texts: the bound holds for texts too.
    first = training.select("h").orderBy("h").limit(rows)
    training = training.join(F.broadcast(first), "h", "left_semi").select("label", "text").persist()
    counted = None
    try:
        counted = _term_counts(training).groupBy("term").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).persist()
        n, positive = training.agg(F.count("*"), F.sum("label")).first()
        positive = positive or 0
        if not 0 < positive < n:
            rate = positive / n if n else 0.5
            bias = 0.0 if not n else float(np.log((rate + 0.01) / (1.01 - rate)))
            return Machine(np.empty(0, np.uint64), bias, np.empty(0), np.empty((0, FACTORS)))
        a, b = F.col("positive"), F.col("n") - F.col("positive")
        gap = a * F.lit(float(n - positive)) - b * F.lit(float(positive))
        chi = gap * gap * n / (F.lit(float(positive) * float(n - positive)) * F.col("n") * F.greatest(F.lit(n) - F.col("n"), F.lit(1)))
        best = counted.where((F.col("n") >= LEAST_TEXTS) & (gap > 0)).select("term", chi.alias("chi")).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "term").limit(TERMS)
        alone = np.array([r["term"] for r in best.collect()], np.int64).view(np.uint64)
        share = F.greatest(a / F.lit(float(positive)), b / F.lit(float(n - positive)))
        frequent = counted.where(F.col("n") >= LEAST_TEXTS).orderBy(share.desc(), "term").limit(PAIRED)
        frequent = np.sort(np.array([r["term"] for r in frequent.select("term").collect()], np.int64).view(np.uint64))
        company = _in_company(training, frequent)
        known = np.union1d(alone, company[~np.isin(company, alone)][:COMPANY])
        rng = np.random.default_rng(5)
        start = float(np.log(positive / (n - positive)))
        machine = Machine(known, start, np.zeros(len(known)), rng.normal(0, 0.01, (len(known), FACTORS)))
        found = _kept_terms(training, machine).collect()  # bounded by ``rows``, ``TERMS`` and ``COMPANY``
        found.sort(key=lambda r: (r["h"], r["label"], r["places"]))
        _train(machine, [np.array(r["places"], np.int64) for r in found], np.array([r["label"] for r in found], float))
        return machine
    finally:
        if counted is not None:
            counted.unpersist()
        training.unpersist()


def _in_company(training: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """Of the sorted terms those with a pair whose ratio is ``LEAST_RATIO`` or more, the highest first.

    The ratio of a pair is the smaller one of two: what each term tells about the label among the texts that have the
    other. A pair is worth no more to one of its terms than to the other, so no term comes before its best company.
    """
    if len(frequent) < 2:
        return frequent[:0]
    spark = training.sparkSession
    rows = _presence(training, frequent).collect()  # a bit for each of ``PAIRED`` terms and each training row
    bits = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1)
    shared = spark.sparkContext.broadcast((bits, np.array([r["label"] for r in rows], bool), len(frequent)))
    blocks = -(-len(frequent) // _PAIR_BLOCK)
    both = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    target = arrow_schema("place int, ratio double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, labels, n_terms = shared.value
        forget()
        x = np.arange(len(labels) + 1, dtype=float)
        times_log = x * np.log(np.maximum(x, 1))

        def fit_of(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
            return times_log[positive] + times_log[n - positive] - times_log[n]

        def columns(block: int) -> np.ndarray:
            part = bits[:, block * _PAIR_BLOCK // 8 : (block + 1) * _PAIR_BLOCK // 8]
            return np.unpackbits(part, axis=1)[:, : n_terms - block * _PAIR_BLOCK].astype(np.float32)

        for batch in batches:
            for number in batch.column(0).to_pylist():
                i, j = both[number]
                first, second = columns(i), columns(j)
                n, positive = (first.T @ second).astype(int), (first[labels].T @ second[labels]).astype(int)
                ratio = np.full(n.shape, np.inf)
                for c, axis in ((first, 1), (second, 0)):
                    has, told = (np.expand_dims(v.astype(int), axis) for v in (c.sum(axis=0), c[labels].sum(axis=0)))
                    ratio = np.minimum(ratio, 2 * (fit_of(n, positive) + fit_of(has - n, told - positive) - fit_of(has, told)))
                for block, best in ((i, ratio.max(axis=1)), (j, ratio.max(axis=0))):
                    places = np.flatnonzero(best >= LEAST_RATIO)
                    yield to_batch([(block * _PAIR_BLOCK + p, float(best[p])) for p in places.tolist()], target)

    found = arrow_map(spark.range(0, len(both), 1, len(both)), run, "place int, ratio double").groupBy("place").agg(F.max("ratio").alias("ratio"))
    found = sorted(found.collect(), key=lambda r: (-r["ratio"], r["place"]))
    shared.destroy()
    return frequent[np.array([r["place"] for r in found], np.int64)]


def _presence(training: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Label of each training row, and a bit for each of the terms that its text has."""
    machine = Machine(frequent, 0.0, np.zeros(len(frequent)), np.zeros((len(frequent), 1)))
    schema = "label long, bits binary"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for low, high in chunks(texts, 1 << 21):
                row, place = machine.features(texts[slice(low, high)].to_pylist())
                # Not more than some hundred rows at a time: a byte for each term.
                for at in range(0, high - low, 256):
                    here = (row >= at) & (row < at + 256)
                    has = np.zeros((min(256, high - low - at), len(frequent)), bool)
                    has[row[here] - at, place[here]] = True
                    yield to_batch([(labels[low + at + i], p.tobytes()) for i, p in enumerate(np.packbits(has, axis=1))], target)

    return arrow_map(training, run, schema)


def _term_counts(training: DataFrame) -> DataFrame:
    """Texts with each term and how many of them are positive, added up within batches."""
    schema = "term long, n long, positive long"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, texts = np.asarray(batch.column(0).to_pylist(), np.int64), batch.column(1).cast(pa.binary())
            for low, high in chunks(texts, 1 << 21):
                row, h = terms(texts[slice(low, high)].to_pylist())
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                term, where = np.unique(h[new], return_inverse=True)
                n = np.bincount(where, minlength=len(term))
                positive = np.bincount(where, labels[low + row[new]], len(term)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(positive)], schema=target)

    return arrow_map(training, run, schema)


def _kept_terms(training: DataFrame, machine: Machine) -> DataFrame:
    schema = "label long, h long, places array<int>"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for low, high in chunks(texts, 1 << 21):
                row, place = machine.features(texts[slice(low, high)].to_pylist())
                ends = np.searchsorted(row, np.arange(high - low + 1))
                out = [place[s:e].tolist() for s, e in zip(ends[:-1], ends[1:])]
                digest = [hash(tuple(p)) for p in out]
                yield to_batch([(labels[low + i], digest[i], p) for i, p in enumerate(out)], target)

    return arrow_map(training, run, schema)


def score_texts(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row, from its whole text alone. Null and empty texts get the score of a text without known terms.

    One row out for each row in; repeated and null ids stay; other columns are left out; an empty table gives an empty
    one. The machine has at most ``TERMS`` and ``COMPANY`` terms, so every worker can hold it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def rows(ids: list, texts: list):
        forget()
        return zip(ids, shared.value.scores(texts).tolist())

    return map_texts(documents_of(docs, id_col, text_col), rows, "doc_id long, score double")


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``; null and empty texts as in ``score_texts``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def keep(texts: list) -> np.ndarray:
        forget()
        return shared.value.scores(texts) < threshold

    return keep_rows(docs, text_col, keep)
