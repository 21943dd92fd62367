"""Divergences against double loops over all terms of a language, however the cube is cut."""

import re
from collections import Counter, defaultdict

import pytest

from jobmetrics.llm import divergence
from jobmetrics.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n int, term string, value long"
ODD = [
    (None, None, None, None),
    (1, None, "en", "silent"),
    (2, "", "en", None),
    (3, "12 34 !?", "en", "numbers"),
    *[(4, "Same WORDS in a row, déjà vu É", "en", "copies")] * 5,
    (5, "only here", "xx", "a"),
    (6, "nothing shared", "xx", "b"),
    (7, None, "xx", None),
    (8, "word " * 20_000, "hot", "hot"),
    (9, "word other " * 3, "hot", "cold"),
    (10, "other word\x00x ünïcödé", "hot", "cool"),
    (11, "alone", "one", "one"),
]


def brute(rows, least, top):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    groups, documents, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in words:
        groups[lang].add(source)
        documents[lang].update(set(found))
        counts[lang, source].update(found)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in documents[lang].items() if n >= least]
        v = len(kept)

        def shares(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 1) // (total + v) for t in kept}

        of = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))

        def f(p, q):
            return (p - q) * (p - q) // q

        for s in sources:
            pairs = [(-sum(f(of[s][t], of[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            own = [(-f(of[s][t], whole[t]), t.encode()) for t in kept if counts[lang, s][t] and of[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)}
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()] + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, "s", 1) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("least, top, group_size, term_size", [(3, 200, 32, 2048), (3, 200, 3, 50), (1, 5, 1, 7), (2, 20, 6, 100_000)])
def test_divergences(docs, rows, least, top, group_size, term_size):
    got = [tuple(r) for r in divergence.divergences(docs, least, top, group_size, term_size).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, least, top)


def test_query(spark):
    own = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert {tuple(r) for r in QUERIES["op13_divergence"](spark, SMALL).collect()} == brute(own, 3, 200)


def test_nothing(docs):
    assert divergence.divergences(docs.limit(0)).collect() == []
