"""The pipeline's stages against brute-force versions, each on its own input, and all together."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobmetrics.llm import toxicity
from jobmetrics.llm.queries import table, vocabulary
from test_llm_operators import brute_components, brute_contamination, brute_secrets

SMALL = "/root/testdata/sf0.001"
COPY = " ".join(f"word{i % 37} other{i % 11}" for i in range(120))


@pytest.fixture(scope="module")
def planted(spark):
    """Documents with copies, benchmark passages, secrets, toxic texts, rows without texts or ids, and more columns."""
    docs = table(spark, SMALL, "documents")
    item = table(spark, SMALL, "benchmark").orderBy("item_id").first().text
    toxic = docs.join(table(spark, SMALL, "labels").where("toxic = 1"), "doc_id").first()
    rows = [
        (5001, COPY), (5002, COPY + " more"), (5003, COPY), (5003, COPY), (5004, None), (5005, ""), (5005, ""),
        (5006, f"some words before {item} and after"), (5007, "the token=abcdef0123456789 is secret " + "deadbeef" * 4),
        (None, "a row without an id but with a text of its own"), (5008, toxic.text if toxic else "x"),
    ]
    more = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select(more.columns).union(more).withColumn("score", F.lit(1)).withColumn("secret_spans", F.lit("x"))


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def stages(spark, docs, tmp_path):
    out = []
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{i}-{name}")
        step(spark, docs, SMALL).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages(spark, planted, tmp_path):
    (a0, a), (b0, b), (c0, c), (d0, d), (e0, e) = stages(spark, planted, tmp_path)
    for df in (a, b, c, d):
        assert df.columns == planted.columns

    machine = toxicity.fit(a0, table(spark, SMALL, "labels"))
    score = dict(zip(rows := list(texts(a0)), machine.scores([(t.encode() if t is not None else None) for _, t in rows])))
    assert texts(a) == Counter({k: n for k, n in texts(a0).items() if score[k] < 0.7})

    rows = sorted(texts(b0), key=lambda r: (r[0] is None, r[0] or 0))
    sizes, roots = brute_components([t for _, t in rows], 5)
    kept = texts(b)
    assert set(kept.values()) == {1} and set(kept) <= set(rows)
    groups = {}
    for row, n, root in zip(rows, sizes, roots):
        groups.setdefault(root if n else row, []).append(row)
    assert all(sum(r in kept for r in group) == 1 for group in groups.values())
    assert all(group[0][0] == next(r for r in group if r in kept)[0] for group in groups.values()), "the smallest id stays"

    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    assert texts(c) == Counter({k: n for k, n in texts(c0).items() if not brute_contamination(k[1], items)[1]})

    before, after = {r.doc_id: r for r in d0.collect()}, {r.doc_id: r for r in d.collect()}
    assert set(before) == set(after)
    for i, row in after.items():
        spans = brute_secrets(before[i].text or "")
        assert not brute_secrets(row.text or "")
        if not spans and "[SECRET]" not in (row.text or ""):
            assert row.text == before[i].text and row.n_chars == before[i].n_chars
        else:
            assert row.n_chars == len(row.text) and re.search(r"\[SECRET\]", row.text)

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = Counter()
    for (i, t), n in texts(e0).items():
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), tuple(ids), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += n
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in e.collect()) == want


def test_stages_of_nothing(spark, planted):
    empty = planted.where("false")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, SMALL).count() == 0


def test_run_is_all_stages(spark, tmp_path):
    last = stages(spark, table(spark, SMALL, "documents"), tmp_path)[-1][1]
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == last.columns
    assert sorted(map(tuple, got.drop("ids").collect())) == sorted(map(tuple, last.drop("ids").collect()))
