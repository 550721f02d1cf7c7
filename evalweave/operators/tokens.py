"""Token accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.expr import count_where, label, ratio

FIELDS = ["input_tokens", "output_tokens", "total_tokens"]
BUCKETS = ["layout_plan", "generation", "judge"]


def usage_tokens(usage: Column) -> Column:
    """A usage struct as ``input/output/total`` counts.

    ``usage`` has the fields ``prompt_tokens, input_tokens, completion_tokens, output_tokens,
    total_tokens``; a missing or zero total is the sum of the two others.
    """
    pick = lambda a, b: F.coalesce(usage[a], usage[b], F.lit(0)).cast("long")
    inp, out = pick("prompt_tokens", "input_tokens"), pick("completion_tokens", "output_tokens")
    total = F.when(F.coalesce(usage["total_tokens"], F.lit(0)) != 0, usage["total_tokens"]).otherwise(inp + out)
    return F.struct(inp.alias(FIELDS[0]), out.alias(FIELDS[1]), total.cast("long").alias(FIELDS[2]))


def usage_lines(rows: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Evaluation rows as usage lines ``(by, mode, bucket, input/output/total)``.

    Rows carry ``generation_usage``, ``layout_plan_usage``, ``judge_usage`` structs and
    ``judge_call_usages``, an array of them that counts as judge usage.
    """
    empty = F.array().cast(rows.schema["judge_call_usages"].dataType)
    item = lambda u, b: F.struct(F.lit(b).alias("bucket"), u.alias("usage"))
    own = F.array(
        item(F.col("layout_plan_usage"), "layout_plan"),
        item(F.col("generation_usage"), "generation"),
        item(F.col("judge_usage"), "judge"),
    )
    calls = F.transform(F.coalesce("judge_call_usages", empty), lambda u: item(u, "judge"))
    lines = rows.select(*by, label("mode").alias("mode"), F.explode(F.concat(own, calls)).alias("l"))
    return lines.filter(F.col("l.usage").isNotNull()).select(
        *by, "mode", F.col("l.bucket").alias("bucket"), usage_tokens(F.col("l.usage")).alias("t")
    ).select(*by, "mode", "bucket", "t.*")


def _averages(totals: DataFrame, attempts: DataFrame) -> DataFrame:
    out = attempts.join(totals, "mode", "left")
    for f in FIELDS:
        out = out.withColumn(f, F.coalesce(f, F.lit(0)).cast("long"))
    for f in FIELDS:
        out = out.withColumn(f"{f}_per_success", ratio(f, "successful_rows"))
        out = out.withColumn(f"{f}_per_attempt", ratio(f, "attempted_rows"))
    return out


def _attempts(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by, label("mode").alias("mode")).agg(
        F.count("*").alias("attempted_rows"),
        count_where(F.coalesce(F.col("status") == "success", F.lit(False))).alias("successful_rows"),
    )


def token_usage(rows: DataFrame, lines: DataFrame | None = None, *, by: Sequence[str] = ()) -> DataFrame:
    """per mode and bucket (within ``by``), token sums and averages; bucket ``combined`` is all three.

    Tokens of failed rows count; successes only set the denominator. ``lines`` may be given when
    usage lives in a table of its own.
    """
    lines = usage_lines(rows, by=by) if lines is None else lines
    per_bucket = lines.groupBy(*by, "mode", "bucket").agg(*[F.sum(f).alias(f) for f in FIELDS])
    total = per_bucket.groupBy(*by, "mode").agg(*[F.sum(f).alias(f) for f in FIELDS]).withColumn("bucket", F.lit("combined"))
    sums = per_bucket.unionByName(total)
    # Every mode reports every bucket, also one without tokens: a literal array, not a cross join.
    frame = _attempts(rows, by).withColumn("bucket", F.explode(F.array(*[F.lit(b) for b in [*BUCKETS, "combined"]])))
    out = frame.join(sums, [*by, "mode", "bucket"], "left")
    for f in FIELDS:
        out = out.withColumn(f, F.coalesce(f, F.lit(0)).cast("long"))
    for f in FIELDS:
        out = out.withColumn(f"{f}_per_success", ratio(f, "successful_rows"))
        out = out.withColumn(f"{f}_per_attempt", ratio(f, "attempted_rows"))
    return out


def generation_comparison(usage: DataFrame, *, examples_only_mode: str) -> DataFrame:
    """generation averages per success against the examples-only mode, one row per field."""
    gen = usage.filter(F.col("bucket") == "generation")
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_per_success").alias("avg")) for f in FIELDS])
    long = gen.select("mode", F.explode(items).alias("i")).select("mode", "i.*")
    base = long.filter(F.col("mode") == examples_only_mode).select("field", F.col("avg").alias("examples_only_avg"))
    return (
        long.filter(F.col("mode") != examples_only_mode)
        .join(F.broadcast(base), "field")  # three rows: one per field of the one baseline mode
        .select(
            "mode", "field", "examples_only_avg", F.col("avg").alias("mode_avg"),
            (F.col("avg") - F.col("examples_only_avg")).alias("delta"),
            F.try_divide("avg", "examples_only_avg").alias("ratio"),
        )
    )


def induction_usage(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """per mode, and per mode and stage. ``model_calls``: array of ``stage, model, usage``."""
    calls = rows.select(label("mode").alias("mode"), F.explode("model_calls").alias("c")).select(
        "mode", label("c.stage").alias("stage"), usage_tokens(F.col("c.usage")).alias("t")
    ).select("mode", "stage", "t.*")
    by_stage = calls.groupBy("mode", "stage").agg(*[F.sum(f).alias(f) for f in FIELDS])
    by_mode = by_stage.groupBy("mode").agg(*[F.sum(f).alias(f) for f in FIELDS])
    return _averages(by_mode, _attempts(rows)), by_stage
