"""Word count with a join of its rarest words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmetrics.functions.names import words
from jobmetrics.operators.select import by_initial
from jobmetrics.operators.skew import top_per_key
from jobmetrics.operators.unpack import word_columns

VOWEL = "^[aeiou]"
OTHER = "^[^aeiou]"
LIST_SIZE = 20


def word_count(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.select(F.explode(words(F.col(column))).alias("word")).groupBy("word").count()


def rarest(words_df: DataFrame, regex: str, word: str, count: str, size: int = LIST_SIZE) -> DataFrame:
    """The ``size`` rarest words with that beginning; ties in alphabetical order."""
    kept = by_initial(words_df, regex).orderBy("count", "word").limit(size)
    return word_columns(kept, word, count)


def join_words(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, F.col("word") == F.col("swv"), "full_outer")


def rare_words(lines: DataFrame, size: int = LIST_SIZE) -> DataFrame:
    """Rarest words without and with a vowel at the start, side by side, from one word count.

    A word has one beginning, so the full outer join of the two lists pairs no words: each row fills one side.
    """
    vowel = F.col("word").rlike(VOWEL)
    counts = word_count(lines).filter(vowel | F.col("word").rlike(OTHER)).withColumn("_vowel", vowel)
    top = top_per_key(counts, ["_vowel"], [F.col("count"), F.col("word")], size)
    sides = {"word": ~F.col("_vowel"), "swv": F.col("_vowel")}
    columns = [F.when(own, F.col(value)).alias(name) for side, own in sides.items() for name, value in ((side, "word"), ("count" if side == "word" else "swv_count", "count"))]
    return top.select(*columns)
