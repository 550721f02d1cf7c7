"""Shaping of results for comparison: the oracle rounds the same columns the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers widened to bigint, column order kept."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        c = F.col(f"`{field.name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)
