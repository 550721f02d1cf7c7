"""Domain tables derived from the driver's parquet tables.

Each function is a deterministic projection. ``oracle_tables.py`` states the same projections in
SQL, so that an operator and its oracle read the same data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ["prompt_only", "click", "purchase", "signup", "never_run"]  # `error` stays unexpected
BASELINE = "prompt_only"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wide_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for CPU-heavy text work, dealt over many tasks by its first column, the id.

    A scan has as many tasks with rows as the file has row groups, which can be one. What the caller
    does not read is not moved. The number of tasks grows with cores and bytes.
    """
    df = table(spark, sf, name)
    return df.repartition(many_tasks(spark, sf, name), df.columns[0])


def many_tasks(spark: SparkSession, sf: str, name: str) -> int:
    """A number of tasks for work on a table that grows with cores and with the table's bytes."""
    return max(2 * spark.sparkContext.defaultParallelism, 8 * table(spark, sf, name).rdd.getNumPartitions())


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def eval_row(spark: SparkSession, sf: str, *, wide: bool = False) -> DataFrame:
    k = _k()
    ok = k % 10 != 0
    return (wide_table if wide else table)(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("pack_id"),
        (F.col("event_id") % 4).cast("string").alias("task_id"),
        F.when(F.col("event_type") == "view", "prompt_only").otherwise(F.col("event_type")).alias("mode"),
        F.when(ok, "success").otherwise("model_error").alias("status"),
        F.when(ok, F.col("value")).alias("overall_score"),
        F.col("event_id").alias("seq"),
        F.lit("e").alias("evaluator_kind"),
        (F.col("user_id") % 3).cast("string").alias("judge_model"),
        k.alias("k"),
    )


def heldout(spark: SparkSession, sf: str) -> DataFrame:
    """Four heldout tasks for each pack seen in the events."""
    packs = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("pack_id")).distinct()
    return packs.select(
        "pack_id", F.posexplode(F.array(*[F.lit(str(i)) for i in range(4)])).alias("pos", "task_id")
    )


def _n_docs(spark: SparkSession, sf: str) -> int:
    """Number of documents; a footer-only count."""
    return table(spark, sf, "documents").count()


def doc_text_by(spark: SparkSession, sf: str, rows: DataFrame, key: str) -> DataFrame:
    """Give each row the text of document ``key % n_docs`` as ``doc_text``."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("__doc"), F.col("text").alias("doc_text"))
    n = _n_docs(spark, sf)
    return rows.withColumn("__doc", F.col(key) % F.lit(n)).join(docs, "__doc", "left").drop("__doc")


# Phrases that are planted into every ninth text, in turn: one for each leak pattern, and near misses.
PLANTED = [
    "a Benchmark Training Example", "PRIVATE SUPERVISION", "the construction prompt", "benchmark rubric", "judge metadata", "rubric criteria",
    "hidden rubric", "Hidden Checklist", "grading criteria", "private  checklist", "criteria grading", "checklist groups", "teacher critique",
    "heldout feedback", "evaluation metadata", "benchmark 评分标准", "隐藏的评分标准", "内部用评分标准", "评审提示", "隐藏 checklist", "BAILIAN_API_KEY=x",
    "openai_api_key", "hidden rubrics", "private supervisions", "a rubric, private", "评分标准", "judge meta data", "benchmarks rubric",
]


def planted(text: Column, n: Column) -> Column:
    """Where ``n`` is a multiple of nine, the text with one of the phrases behind it."""
    phrase = F.element_at(F.array(*[F.lit(p) for p in PLANTED]), (F.floor(n / 9) % len(PLANTED) + 1).cast("int"))
    return F.when(n % 9 == 0, F.concat(text, F.lit(" "), phrase, F.lit("."))).otherwise(text)


def planted_sql(text: str, n: str) -> str:
    phrases = ", ".join(f"'{p}'" for p in PLANTED)
    return f"CASE WHEN {n} % 9 = 0 THEN {text} || ' ' || ([{phrases}])[CAST({n} // 9 % {len(PLANTED)} + 1 AS BIGINT)] || '.' ELSE {text} END"


def generation_log(spark: SparkSession, sf: str, *, with_text: bool = False) -> DataFrame:
    k = _k()
    status = (
        F.when(k % 10 == 0, "error")
        .when(k % 10 == 1, "rejected_incomplete_generation")
        .when(k % 10 == 2, "rejected_private_leak")
        .otherwise("success")
    )
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"),
        F.sha2(F.col("event_type"), 256).alias("prompt_sha256"),
        (F.col("user_id") % 50).cast("string").alias("pack_id"),
        F.col("user_id").cast("string").alias("example_id"),
        F.col("event_id").alias("seq"),
        F.when(k % 10 == 1, "length").otherwise("stop").alias("finish_reason"),
        status.alias("status"),
        F.concat(F.lit("v"), (k % 2).cast("string")).alias("prompt_template_version"),
        F.concat(F.lit("model"), (k % 3).cast("string")).alias("model"),
        F.col("ts").alias("finished_at"),
    )
    if not with_text:
        return rows
    out = doc_text_by(spark, sf, rows, "seq")
    return out.withColumn(
        "desired_output", F.when(F.col("status") == "success", planted(F.col("doc_text"), F.col("seq")))
    ).drop("doc_text")


def job(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct log keys, plus jobs of ten more ids per type that never ran."""
    events = table(spark, sf, "events")
    ran = events.select("user_id", "event_type").distinct()
    never = ran.filter(F.col("user_id") < 10).withColumn("user_id", F.col("user_id") + 1000000)
    return ran.unionByName(never).select(
        F.col("user_id").cast("string").alias("job_id"),
        F.sha2(F.col("event_type"), 256).alias("prompt_sha256"),
        (F.col("user_id") % 50).cast("string").alias("pack_id"),
        F.col("user_id").cast("string").alias("example_id"),
        F.concat(F.lit("src"), (F.col("user_id") % 2).cast("string")).alias("source"),
        F.concat(F.lit("write "), F.col("event_type")).alias("prompt"),
        (F.col("user_id") * 10 + F.length("event_type")).alias("seq"),
    )
