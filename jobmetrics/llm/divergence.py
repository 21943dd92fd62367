"""How the sources of each language differ in their words, by a cube of (group block, group block, term block) cells.

A group is a source within a language. Groups and terms of a language are dealt into blocks by hash, so many that a cell's two
slices (the shares of its groups' terms) stay small. A slice is copied to the cells that need it, one for each other
group block; a cell compares every two of its groups over its own terms only, both ways, and the partial divergences are added up
along the term axis. A term that neither group of a cell has costs no row: each slice comes with its groups and their share
for absent terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmetrics.llm.batches import arrow_map, arrow_schema, byte_table, chunks
from jobmetrics.operators.skew import lookup, top_per_key
from jobmetrics.runtime import Stage

#: A term counts in a language if at least so many of its documents have it; how many terms a group reports.
LEAST_DOCUMENTS, TOP = 3, 200
#: Shares are in parts of this.
UNIT = 1_000_000_000
#: Groups and terms of a block, on average.
GROUPS, TERMS = 32, 2048
#: Everything in ASCII but letters separates terms.
TABLE = byte_table([*range(65), *range(91, 97), *range(123, 128)])
_COUNTS = "lang string, source string, term string, n long, docs long"
_PARTIAL = "lang string, source string, item string, value long"


def _term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of each term in each group, and documents that have it, added up within batches."""
    target = arrow_schema(_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            for low, high in chunks(texts, 1 << 21):
                groups: dict[tuple[str, str], list[bytes]] = {}
                for at, text in zip(range(low, high), texts.slice(low, high - low).to_pylist()):
                    groups.setdefault((langs[at], sources[at]), []).append(text.translate(TABLE))
                for (lang, source), own in groups.items():
                    number: dict[bytes, int] = {}
                    split = [text.split() for text in own]
                    ids = np.fromiter((number.setdefault(w, len(number)) for words in split for w in words), np.int64)
                    if not len(ids):
                        continue
                    row = np.repeat(np.arange(len(split)), [len(words) for words in split])
                    n = np.bincount(ids)
                    have = np.bincount(np.unique(row * len(number) + ids) % len(number), minlength=len(number))
                    k = len(number)
                    columns = [pa.array([lang] * k), pa.array([source] * k), pa.array(list(number), pa.binary()).cast(pa.string()), pa.array(n), pa.array(have)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return arrow_map(docs, run, _COUNTS)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (n + 1) / (total + terms)), exact for counts of any 64-bit size."""
    number = (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", number, (total + terms).cast("decimal(20,0)")) + 1


def _cell(key: tuple, table: pa.Table) -> pa.Table:
    """Partial divergences of every two groups of a cell, in both directions.

    Rows without a term are its groups: their block, their share for an absent term (``p``) and the number of terms of the
    cell (``n_terms``). Rows with a term are shares of groups that have it.
    """
    term, source, p = table.column("term"), table.column("source").to_pylist(), np.asarray(table.column("p"))
    block, n_terms = np.asarray(table.column("block")), np.asarray(table.column("n_terms"))
    header = np.flatnonzero(np.asarray(term.is_null()))
    place = {source[i]: k for k, i in enumerate(header.tolist())}
    codes = term.combine_chunks().dictionary_encode() if len(term) else None
    names = len(codes.dictionary)
    shares = np.repeat(p[header][:, None], max(names, 1), axis=1)
    rest = np.setdiff1d(np.arange(len(source)), header)
    column = np.asarray(codes.indices.fill_null(-1))
    shares[[place[source[i]] for i in rest.tolist()], column[rest]] = p[rest]
    shares = shares[:, :names]
    absent = int(n_terms[header[0]]) - names  # terms that no group of this cell has
    first, second = key[1].as_py(), key[2].as_py()
    of = block[header]
    lang = key[0].as_py()
    out: dict[str, list] = {"lang": [], "source": [], "item": [], "value": []}
    others_of = {first: np.flatnonzero(of == second), second: np.flatnonzero(of == first)}
    for g in range(len(header)):
        others = others_of[int(of[g])]
        others = others[others != g]
        if not len(others):
            continue
        q, q0 = shares[others], p[header][others]
        value = (((shares[g] - q) ** 2) // q).sum(axis=1) + (p[header][g] - q0) ** 2 // q0 * absent
        out["lang"] += [lang] * len(others)
        out["source"] += [source[header[g]]] * len(others)
        out["item"] += [source[header[o]] for o in others.tolist()]
        out["value"] += value.tolist()
    return pa.table({name: pa.array(values, pa.int64() if name == "value" else pa.string()) for name, values in out.items()})


def _pairs(shares: DataFrame, groups: DataFrame, terms: DataFrame, group_size: int, term_size: int) -> DataFrame:
    """lang, source, item, value: divergence of each source from each other one of its language."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_groups") / group_size)).cast("int")
    slices = F.greatest(F.lit(1), F.ceil(F.col("n_kept") / term_size)).cast("int")
    own = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    placed = groups.withColumn("blocks", blocks).withColumn("slices", slices).withColumn("block", own)
    part = F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("part")
    # How many terms each part has, the empty ones too.
    sizes = lookup(terms.select("lang", "term"), placed.groupBy("lang").agg(F.max("slices").alias("slices")), ["lang"])
    sizes = sizes.groupBy("lang", part).agg(F.count(F.lit(1)).alias("n_terms"))
    headers = placed.select("lang", "source", "blocks", "block", F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("part"))
    headers = lookup(headers, sizes, ["lang", "part"], "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0).cast("bigint")))
    inside = lookup(shares, placed.select("lang", "source", "blocks", "slices", "block"), ["lang", "source"])
    rows = headers.select("lang", "source", "blocks", "block", "part", F.lit(None).cast("string").alias("term"), "p", "n_terms").unionByName(
        inside.select("lang", "source", "blocks", "block", part, "term", "p", F.lit(0).cast("bigint").alias("n_terms"))
    )
    with_ = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = rows.select("lang", "source", "block", "part", "term", "p", "n_terms", with_)
    cells = cells.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")).drop("other")
    partial = cells.groupBy("lang", "a", "b", "part").applyInArrow(_cell, _PARTIAL)
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergences(
    docs: DataFrame,
    least: int = LEAST_DOCUMENTS,
    top: int = TOP,
    group_size: int = GROUPS,
    term_size: int = TERMS,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: each other source of the language, with the sum over all kept terms of floor((p - q)^2 / q), p being this
    source's share of the term and q the other's. Part ``term``: the ``top`` terms that this source has and uses more than
    its language does, with the same figure against the language's share. The highest value is first, of equal ones the one whose
    bytes come first.

    Nulls in the three columns count as empty. A group without terms has the same share of each term; without kept terms
    all values are 0. Each row is a document, repeated ones too; an empty table gives an empty result. Values are exact while
    a language has fewer than two thousand million kept terms.
    """
    stage = Stage(docs.sparkSession, "divergence")
    text = {name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for name, c in (("lang", lang_col), ("source", source_col), ("text", text_col))}
    counts = _term_counts(docs.select(text["lang"], text["source"], text["text"]))
    counts = stage.put("counts", counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).where(F.col("docs") >= least).drop("docs")
    terms = stage.put("terms", terms)
    kept = stage.put("kept", lookup(counts, terms, ["lang", "term"]).select("lang", "source", "term", "n", "in_lang"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("in_lang").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = docs.select(text["lang"], text["source"]).distinct()
    per_lang = every.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups"))
    zero = F.lit(0).cast("bigint")
    groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(per_lang, "lang")
    groups = groups.select("lang", "source", "n_groups", *(F.coalesce(c, zero).alias(c) for c in ("total", "n_kept", "lang_total")))
    absent = F.when(F.col("n_kept") > 0, _share(zero, F.col("total"), F.greatest(F.col("n_kept"), F.lit(1)))).otherwise(F.lit(1)).cast("bigint")
    groups = stage.put("groups", groups.withColumn("p0", absent))
    shares = lookup(kept, groups.select("lang", "source", "total", "n_kept", "lang_total"), ["lang", "source"])
    shares = shares.select(
        "lang", "source", "term",
        _share(F.col("n"), F.col("total"), F.col("n_kept")).alias("p"),
        _share(F.col("in_lang"), F.col("lang_total"), F.col("n_kept")).alias("q"),
    )
    pairs = _pairs(shares.drop("q"), groups, terms, group_size, term_size)
    order = [F.col("value").desc(), F.col("item")]
    square = (F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))
    own = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.call_function("div", square, F.col("q")).alias("value"))
    own = top_per_key(own, ["lang", "source"], order, top)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(own.withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order))
    return both.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), rank.alias("rank"))
