"""Places where a user's own code joins in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Transform = Callable[[DataFrame], DataFrame]


def extract(df: DataFrame, fn: Transform) -> DataFrame:
    """Run a user's query over the steps."""
    return df.transform(fn)


def chain(*transforms: Transform | None) -> Transform:
    """One transform that applies all given ones in order and skips ``None``."""

    def run(df: DataFrame) -> DataFrame:
        for transform in transforms:
            if transform is not None:
                df = df.transform(transform)
        return df

    return run
