"""The machine's margins and the choice of terms against plain double loops."""

import math
import random

import numpy as np
import pytest

from jobmetrics.llm import toxicity


def words(*parts):
    return " ".join(parts).encode()


def own_terms(text):
    """Distinct hashes of the terms of one text."""
    return set(toxicity.terms([text])[1].tolist())


def test_margins_equal_a_double_loop():
    rng = np.random.default_rng(2)
    texts = [words(*rng.choice(["ab", "cd", "ef", "gh", "ij"], n)) for n in (0, 1, 2, 5, 9)] + [None]
    known = np.array(sorted(set().union(*(own_terms(t) for t in texts if t))), np.uint64)[:4]
    machine = toxicity.Machine(known, 0.3, rng.normal(0, 1, 4), rng.normal(0, 1, (4, 3)))
    for text, score in zip(texts, machine.scores(texts)):
        places = [k for k, h in enumerate(known.tolist()) if text and h in own_terms(text)]
        margin = 0.3 + sum(machine.weights[k] for k in places)
        margin += sum(float(machine.vectors[i] @ machine.vectors[j]) for i in places for j in places if i < j)
        assert score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-12)


def likelihood(positive, n):
    return sum(x * math.log(x) for x in (positive, n - positive, ) if x) - (n * math.log(n) if n else 0)


def test_terms_in_company_equal_a_double_loop(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        both = rng.random() < 0.2
        text = ["mild"] * (both or rng.random() < 0.3) + ["grp"] * (both or rng.random() < 0.3) + rng.choices(["xa", "xb", "xc"], k=2)
        rows.append((int("mild" in text and "grp" in text), " ".join(text)))
    frequent = np.array(sorted(set().union(*(own_terms(t.encode()) for _, t in rows))), np.uint64)
    have = [(label, own_terms(t.encode())) for label, t in rows]

    def counts(*terms):
        labels = [label for label, own in have if all(t in own for t in terms)]
        return sum(labels), len(labels)

    best = {}
    for a in frequent.tolist():
        for b in frequent.tolist():
            ratios = []
            for t, other in ((a, b), (b, a)):
                (p, n), (told, has) = counts(t, other), counts(t)
                ratios.append(2 * (likelihood(p, n) + likelihood(told - p, has - n) - likelihood(told, has)))
            best[a] = max(best.get(a, -math.inf), min(ratios))
    want = [t for t in sorted(best, key=lambda t: (-round(best[t], 6), t)) if best[t] >= toxicity.LEAST_RATIO]
    got = toxicity._in_company(spark.createDataFrame(rows, "label long, text string"), frequent).tolist()
    assert set(got) == set(want) and len(got) >= 2
    assert [round(best[t], 6) for t in got] == sorted((round(best[t], 6) for t in want), reverse=True)


def test_terms_that_tell_alone_equal_a_double_loop(spark):
    """Chi-squared of each term, through ``fit``: what is kept alone speaks for the label and is not rare."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        label = int(rng.random() < 0.3)
        rows.append((i, label, " ".join([*(["vile"] if label and rng.random() < 0.8 else []), *(["nice"] if not label else []), f"u{i}", *rng.choices("abcdef", k=3)])))
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, label) for i, label, _ in rows], "doc_id long, toxic int")
    used = {r["doc_id"] for r in labels.where(toxicity.in_training(labels["doc_id"])).collect()}
    have = [(label, own_terms(t.encode())) for i, label, t in rows if i in used]
    n, positive = len(have), sum(label for label, _ in have)
    alone = set()
    for t in set().union(*(own for _, own in have)):
        a, m = sum(label for label, own in have if t in own), sum(t in own for _, own in have)
        gap = a * (n - positive) - (m - a) * positive
        chi = gap * gap * n / (positive * (n - positive) * m * max(n - m, 1))
        if m >= toxicity.LEAST_TEXTS and gap > 0 and chi >= toxicity.LEAST_CHI:
            alone.add(t)
    machine = toxicity.fit(docs, labels)
    assert alone and alone <= set(machine.known.tolist())
    company = set(machine.known.tolist()) - alone
    assert all(sum(t in own for _, own in have) >= toxicity.LEAST_TEXTS for t in company)


def test_an_id_with_many_texts_does_not_lift_the_bound(spark, monkeypatch):
    seen = []
    kept = toxicity._kept_terms
    monkeypatch.setattr(toxicity, "_kept_terms", lambda training, machine: seen.append(training.count()) or kept(training, machine))
    docs = spark.range(500).selectExpr("id % 4 as doc_id", "concat('word', id, if(id % 2 = 0, ' vile', ' nice')) as text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, rows=60)
    assert seen == [60]
