"""Violation tables: ``rule_id, severity, entity_id, detail``. An empty one means all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["rule_id", "severity", "entity_id", "detail"]


class ViolationsFound(ValueError):
    """A fail-closed gate found at least one error."""


def violation(df: DataFrame, rule_id: str, entity, detail="", severity: str = "error") -> DataFrame:
    """Rows of ``df`` as violations of one rule."""
    detail = F.lit(detail) if isinstance(detail, str) else detail
    entity = F.col(entity) if isinstance(entity, str) else entity
    return df.select(
        F.lit(rule_id).alias("rule_id"),
        F.lit(severity).alias("severity"),
        F.coalesce(entity.cast("string"), F.lit("")).alias("entity_id"),
        F.coalesce(detail.cast("string"), F.lit("")).alias("detail"),
    )


def rule_rows(df: DataFrame, entity, rules) -> DataFrame:
    """Many rules over one table in one pass.

    ``rules``: ``(rule_id, severity, condition, detail)``; a row yields one violation for each
    condition that holds. Rules that read the same joined row share one join this way.
    """
    entity = F.col(entity) if isinstance(entity, str) else entity
    hits = []
    for rule_id, severity, cond, detail in rules:
        detail = F.lit(detail) if isinstance(detail, str) else detail
        hits.append(
            F.when(
                F.coalesce(cond, F.lit(False)),
                F.struct(
                    F.lit(rule_id).alias("rule_id"),
                    F.lit(severity).alias("severity"),
                    F.coalesce(detail.cast("string"), F.lit("")).alias("detail"),
                ),
            )
        )
    # A plain array stays in generated code; the nulls of rules that hold back fall to the filter.
    found = df.select(
        F.coalesce(entity.cast("string"), F.lit("")).alias("entity_id"), F.explode(F.array(*hits)).alias("v")
    ).filter(F.col("v").isNotNull())
    return found.select("v.rule_id", "v.severity", "entity_id", "v.detail")


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def fail_if_any(violations: DataFrame, *, show: int = 5) -> None:
    """Raise when an error exists. Looks at a few rows only, to name them in the message."""
    found = violations.filter(F.col("severity") == "error").take(show)
    if found:
        raise ViolationsFound("; ".join(f"{r.rule_id}[{r.entity_id}] {r.detail}" for r in found))


def status(violations: DataFrame) -> DataFrame:
    """Counts per severity and the overall status."""
    return violations.agg(
        F.count(F.when(F.col("severity") == "error", 1)).alias("errors"),
        F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"),
    ).withColumn("ok", F.col("errors") == 0)
