"""Per-key work that stays spread out when one key holds a large part of the rows.

Each helper bounds what one task sees of a key: ranking filters are cut down before the shuffle, windows run
inside (key, bucket) slices with the slices stitched together from small aggregates, and joins with one row per key
can be split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lookup(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join many rows per key with a table that was made by grouping by these keys.

    An aggregate is already partitioned by its keys, and Spark would join it in place. Adaptive execution splits
    an oversized partition only where both sides of a join come straight from a shuffle, so the keys are made
    new expressions, which moves the small side once more. Null keys match nothing and are filtered in the same
    way on both sides, which lets them share the scan and shuffle they have in common.
    """

    def known(df: DataFrame) -> DataFrame:
        for key in keys:
            df = df.filter(F.col(key).isNotNull())
        return df

    def renewed(key: str) -> Column:
        """The same values under an expression that the optimizer doesn't see through; keys of any type."""
        kind = per_key.schema[key].dataType
        if isinstance(kind, T.StringType):
            return F.coalesce(F.concat(key, F.lit("")), F.lit(""))
        if isinstance(kind, T.IntegralType):
            return F.coalesce(F.bitwise_not(F.bitwise_not(key)), F.lit(0).cast(kind))
        return F.try_element_at(F.array(key), F.lit(1))

    right = known(per_key).withColumns({key: renewed(key) for key in keys})
    return (known(rows) if how in ("inner", "left_semi") else rows).join(right, list(keys), how)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows of each key. Spark limits each group on the map side first (WindowGroupLimit),
    so at most ``n`` rows per key and map task are shuffled."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return top_per_key(df, keys, [F.col(c).desc() for c in order])


def lag_in_slices(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    value: str,
    name: str,
    initial: DataFrame | None = None,
) -> DataFrame:
    """``lag(value)`` per key, where ``bucket`` cuts the order into consecutive slices.

    Inside a slice a window does it. The first row of a slice takes the last value of the nearest slice
    before it, found in a table with one row per (key, slice). ``initial`` has the keys and ``value`` before
    the first row; it only meets that table.
    """
    slice_keys = [*keys, bucket]
    position = F.struct(*order)
    inside = Window.partitionBy(*slice_keys).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(bucket)
    before = df.groupBy(*slice_keys).agg(F.max_by(F.struct(value), position).alias("_last"))
    before = before.withColumn("_before", F.lag("_last").over(across)).drop("_last")
    if initial is not None:
        start = initial.select(*keys, F.struct(value).alias("_start"))
        before = before.join(start, list(keys), "left").withColumn("_before", F.coalesce("_before", "_start")).drop("_start")
    return (
        df.withColumn("_inside", F.lag(F.struct(value)).over(inside))
        .join(before, slice_keys, "left")
        .withColumn(name, F.coalesce("_inside", "_before")[value])
        .drop("_inside", "_before")
    )


def rank_in_slices(df: DataFrame, keys: Sequence[str], bucket: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``row_number`` per key over (bucket, order): rank inside the slice plus the size of all earlier slices."""
    slice_keys = [*keys, *bucket]
    inside = Window.partitionBy(*slice_keys).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*slice_keys)
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(across), F.lit(0)))
        .drop("_size")
    )
    return (
        df.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, slice_keys)
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset")
    )
