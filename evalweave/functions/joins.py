"""Lookups with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key. Of rows that share it the greatest by value stays, whatever the partitioning."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__row")).select(*keys, *[f"__row.{c}" for c in rest])
