"""The newest delivery of every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of Unicode, for trimming (fixed values).
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"


def trimmed(column: Column) -> Column:
    """A text without outer white space of any kind."""
    return F.btrim(column, F.lit(BLANKS))


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row per key: that with the greatest ``at``; null counts as oldest.

    Of several rows with the same ``at`` the greatest in the other columns (in their order) is
    taken, so the result doesn't depend on row order. Null keys are a key like any other. The
    aggregation combines before the shuffle, so a key with a third of all rows is no hot spot.
    """
    rest = [c for c in df.columns if c not in keys and c != at]
    return df.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("_lg_row")).select(*keys, *[F.col(f"_lg_row.`{c}`").alias(c) for c in [at, *rest]])
