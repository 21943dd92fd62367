"""Queries: word count (A6, J9, S7, S8, X25)."""

from pyspark.sql import functions as F

from jobmetrics.functions.names import words
from jobmetrics.operators import words as wd
from jobmetrics.plans.registry import query
from jobmetrics.plans.selections import WORDS
from jobmetrics.runtime import scratch_path
from jobmetrics.sources.text import read_lines, write_tsv

RARE = """select w.word, w.n as count, v.word as swv, v.n as swv_count
    from (select word, n from words where regexp_matches(word, '^[^aeiou]') order by n, word limit 20) w
    full outer join (select word, n from words where regexp_matches(word, '^[aeiou]') order by n, word limit 20) v
    on w.word = v.word"""


@query("a6_word_count", "select word, n as count from words", {"words": WORDS})
def _(t):
    return wd.word_count(t.lines)


@query("j9_join_words", RARE, {"words": WORDS})
def _(t):
    return wd.rare_words(t.lines)


@query("p10_p11_word_columns", "select word as swv, cast(n as bigint) as swv_count from words", {"words": WORDS})
def _(t):
    return wd.word_columns(wd.word_count(t.lines), "swv", "swv_count")


@query(
    "x25_words",
    "select word, doc_id from (select doc_id, unnest(regexp_split_to_array("
    "regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+')) as word from documents)",
)
def _(t):
    return t.raw("documents").select(F.explode(words(F.col("text"))).alias("word"), "doc_id")


@query("s7_read_lines", "select word, n as count from words", {"words": WORDS})
def _(t):
    path = scratch_path(t.spark, "lines")
    # One line of text per document: line breaks become spaces, which split words just the same.
    t.lines.select(F.translate("line", "\n\r", "  ").alias("value")).write.text(path)
    return wd.word_count(read_lines(t.spark, path))


@query("s8_write_tsv", RARE, {"words": WORDS})
def _(t):
    path = scratch_path(t.spark, "tsv")
    write_tsv(wd.rare_words(t.lines), path)
    return t.spark.read.option("sep", "\t").schema("word string, count bigint, swv string, swv_count bigint").csv(path)
