"""Skill artifacts and their self-consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.expr import count_where, id_part, label, ratio
from evalweave.operators.responses import CONSISTENCY_SCORES, consistency_errors, field_number
from evalweave.operators.scoring import numeric_summary
from evalweave.operators.text import section_rule_counts

METRICS = [
    "skill_char_length",
    "required_rules",
    "optional_rules",
    "do_not_generalize_rules",
    "conflicts_count",
    "outliers_count",
    "candidate_rules_count",
]


def _items(report: Column, name: str) -> Column:
    """A list field of a VARIANT report; a missing one is empty."""
    return F.coalesce(
        F.try_variant_get(report, f"$.{name}", "array<variant>"), F.array().cast("array<variant>")
    )


def rule_support(rule: Column) -> Column:
    """support of a candidate rule: a count field, else its distinct supporting ids, else null."""
    counts = [
        F.when(F.schema_of_variant(F.try_variant_get(rule, f"$.{f}", "variant")) == "BIGINT", F.try_variant_get(rule, f"$.{f}", "bigint"))
        for f in ("support_count", "supported_count")
    ]
    lists = [
        F.size(F.array_distinct(F.try_variant_get(rule, f"$.{f}", "array<string>"))).cast("long")
        for f in ("supporting_examples", "supported_examples", "evidence_examples")
    ]
    return F.coalesce(*counts, *lists)


def artifact_metrics(skills: DataFrame) -> DataFrame:
    """one metric row per skill row. ``report`` is the cross-example report as JSON text."""
    report = F.col("report_v")  # parsed once, in a column of its own
    rules = _items(report, "candidate_rules")
    return (
        skills.withColumn("s", section_rule_counts("skill_md"))
        .withColumn("report_v", F.try_parse_json("report"))
        .select(
            "pack_id", "mode", "status", "seq",
            F.length(F.coalesce("skill_md", F.lit(""))).cast("long").alias("skill_char_length"),
            "s.*",
            F.size(_items(report, "conflicts")).cast("long").alias("conflicts_count"),
            F.size(_items(report, "outliers")).cast("long").alias("outliers_count"),
            F.size(rules).cast("long").alias("candidate_rules_count"),
            F.array_compact(F.transform(rules, rule_support)).alias("support_counts"),
        )
    )


def _long(metrics: DataFrame) -> DataFrame:
    items = F.array(*[F.struct(F.lit(m).alias("field"), F.col(m).alias("value")) for m in METRICS])
    return metrics.select("pack_id", "mode", "seq", F.explode(items).alias("i")).select("pack_id", "mode", "seq", "i.*")


def artifact_summary(metrics: DataFrame) -> DataFrame:
    """numeric summary per mode and field over success rows; rule support as one more field."""
    ok = metrics.filter((F.col("status") == "success") & (id_part("mode") != ""))
    support = ok.select("mode", F.lit("rule_support").alias("field"), F.explode("support_counts").alias("value"))
    values = _long(ok).select("mode", "field", "value").unionByName(support)
    return numeric_summary(values, "value", by=["mode", "field"])


def artifact_deltas(metrics: DataFrame, *, left_mode: str, right_mode: str) -> DataFrame:
    """per pack and field, right minus left mode; the last row of a ``(pack, mode)`` counts.

    Reduced to one value per ``(pack, field)`` and side with ``max_by``, so no self-join is needed.
    """
    ok = metrics.filter(
        (F.col("status") == "success") & (id_part("pack_id") != "") & F.col("mode").isin(left_mode, right_mode)
    )
    side = lambda m: F.max_by(F.when(F.col("mode") == m, F.col("value")), F.when(F.col("mode") == m, F.col("seq")))
    both = _long(ok).groupBy("pack_id", "field").agg(side(left_mode).alias("left_value"), side(right_mode).alias("right_value"))
    return both.filter(F.col("left_value").isNotNull() & F.col("right_value").isNotNull()).withColumn(
        "delta", F.col("right_value") - F.col("left_value")
    )


def mean_artifact_deltas(deltas: DataFrame) -> DataFrame:
    """mean delta per field and the number of paired packs."""
    return deltas.groupBy("field").agg(F.count("*").alias("paired_packs"), F.avg("delta").alias("mean_delta"))


# -- F16 --------------------------------------------------------------------------------------


def consistency_rows(rows: DataFrame) -> DataFrame:
    """Success rows with their faults and seven scores.

    ``rows``: ``pack_id, mode, status, seq, judge_report`` (JSON text), ``matched_literal_count``,
    ``has_literal_leakage``.
    """
    # Behind an explode of one item the parse, and then the faults, stand as columns: a filter on ``errors``
    # is not pushed in front of them, where each row would be parsed again, and before the rows are dealt out.
    out = rows.filter(F.col("status") == "success").withColumn("mode", label("mode"))
    out = out.select("*", F.explode(F.array(F.try_parse_json("judge_report"))).alias("__report"))
    report, scores = F.col("__report"), F.col("__scores")
    out = out.withColumn("__scores", F.struct(*[field_number(report, f).alias(f) for f in CONSISTENCY_SCORES]))
    recorded = F.try_variant_get(report, "$.parse_error", "string")
    errors = F.coalesce(consistency_errors(report, recorded, scores), F.array(F.lit("judge_report_must_be_object")))
    checked = F.struct(errors.alias("errors"), *[scores[f].alias(f) for f in CONSISTENCY_SCORES])
    out = out.withColumn("__checked", checked)
    return out.select(*rows.columns, F.explode(F.array("__checked")).alias("c")).select(*rows.columns, "c.*")


def invalid_consistency_rows(checked: DataFrame) -> DataFrame:
    """F16: success rows whose report breaks the schema, with all faults."""
    return checked.filter(F.size("errors") > 0).select("pack_id", "mode", "seq", "errors")


def consistency_summary(checked: DataFrame) -> DataFrame:
    """F16: numeric summary per mode and score over valid rows."""
    ok = checked.filter(F.size("errors") == 0)
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in CONSISTENCY_SCORES])
    long = ok.select("mode", F.explode(items).alias("i")).select("mode", "i.*")
    return numeric_summary(long, "value", by=["mode", "field"])


def leakage_by_mode(checked: DataFrame) -> DataFrame:
    """F16: literal-leak rows, matches and rate per mode over valid rows."""
    leak = F.coalesce(F.col("has_literal_leakage"), F.lit(False))
    out = checked.filter(F.size("errors") == 0).groupBy("mode").agg(
        F.count("*").alias("successful_rows"),
        count_where(leak).alias("leak_rows"),
        F.coalesce(F.sum("matched_literal_count"), F.lit(0)).alias("matched_literals"),
    )
    return out.withColumn("leak_rate", ratio("leak_rows", "successful_rows"))


def consistency_warnings(checked: DataFrame, *, high: float = 8.0) -> DataFrame:
    """F16: valid rows that score high although literals leaked."""
    return checked.filter(
        (F.size("errors") == 0)
        & F.coalesce(F.col("has_literal_leakage"), F.lit(False))
        & (F.col("overall_self_consistency") >= high)
    ).select("pack_id", "mode", "seq", "overall_self_consistency", "matched_literal_count")


