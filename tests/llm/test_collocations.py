"""Phrases and their scores against plain counting, whatever the shards and however full the filter."""

import re
from collections import Counter, defaultdict

import pytest

from jobmetrics.llm import collocations
from jobmetrics.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n int, phrase string, shard int"
COPIES = "the quick fox, THE QUICK fox jumps over the lazy dog; ends\there\n"
ODD = [
    (None, None, None),
    (1, None, "en"),
    (2, "", "en"),
    (3, " \t\n.,;", "de"),
    *[(4, COPIES, "en")] * 12,
    *[(None, "São paulo é bonita. são paulo\x00x naïve-word", None)] * 11,
    (5, "quick fox " * 400, "en"),
    (6, "a b " * 30 + "." + "x" * 70_000 + " y", "fr"),
    (7, "aa aa aa aa aa aa aa aa aa aa aa aa aa", ""),
    (8, "one one two " * 10 + "one two! one two? one two:", "tie"),
    (9, "Bb cC " * 10 + "cc bb " * 10, "tie"),
]


def brute(rows, max_words, least, top, absorbed):
    """rank, phrase, a, l, r, n, score of each language."""
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, max_words + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = set()
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], a)
        scored = []
        for p, a in candidates.items():
            if inside[p] and 100 * inside[p] >= absorbed * a:
                continue
            score, _, left, right = min((10**6 * a * a // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()] + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 7, "s", 1) for i, t, lang in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize(
    "max_words, least, top, absorbed, shards, filter_bits",
    [(3, 10, 2000, 50, 3, 12), (3, 4, 50, 90, 2, 3), (2, 10, 2000, 50, 1, 16), (4, 5, 2000, 50, 4, 16)],
)
def test_phrases(docs, rows, max_words, least, top, absorbed, shards, filter_bits):
    got = collocations.collocations(docs, max_words, least, top, absorbed, shards, filter_bits)
    got = [tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, max_words, least, top, absorbed)


def test_query(spark):
    own = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    assert {tuple(r) for r in QUERIES["op12_collocations"](spark, SMALL).collect()} == brute(own, 3, 10, 2000, 50)


def test_longer_phrases_begin_at_later_stops(spark):
    """A phrase is counted from the stop at which its parts were reached on, until it is reached or its cycle is over."""
    filters = [collocations.Filter(16) for _ in range(3)]

    def counted(stop):
        return {tag[0] // 256: h for h, tag, _ in collocations._Spots("en", [b"x y z"] * 3, filters).open_(stop, 3)}

    def mark(h, size, stop):
        assert filters[size - 1].add(spark.createDataFrame([(int(v),) for v in h.view("int64")], "h long"), stop)

    assert set(counted(1)) == {1}
    mark(counted(1)[1], 1, 1)
    assert [set(counted(stop)) for stop in (2, 3, 4, 5)] == [{2}, {2}, {2}, set()]
    mark(counted(3)[2], 2, 3)
    assert [set(counted(stop)) for stop in (4, 6, 7)] == [{3}, {3}, set()]


def test_nothing(spark, docs):
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs.where("text is null")).collect() == []
    with pytest.raises(ValueError):
        collocations.frequent_phrases(docs, shards=0)
