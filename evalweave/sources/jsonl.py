"""JSON-lines files in and out (A1-A4).

Lines are read with the splittable text source. Each line's number comes from its split's start
offset and its place in the split: per split, the first id and the line count are aggregated (one
small row per split), and split counts are summed per file. No file is ever read whole by one task
and no line is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalweave.functions.expr import strip
from evalweave.operators.responses import kind, strict_json
from evalweave.operators.violations import violation


def scan_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Non-blank lines as ``path, line, raw, state, is_last``.

    ``state`` is ``ok`` for a JSON object, ``bad_json`` or ``not_object``. ``line`` counts from 1
    and includes blank lines; ``is_last`` marks the last non-blank line of its file.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("raw"),
    )
    split = ["path", "start"]
    filled = F.length(strip("raw")) > 0
    per_split = lines.groupBy(*split).agg(
        F.min("id").alias("first"), F.count("*").alias("n"), F.max(F.when(filled, F.col("id"))).alias("last_filled")
    )
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("path")
    places = per_split.select(
        *split, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), "last_filled",
        F.max(F.when(F.col("last_filled").isNotNull(), F.col("start"))).over(whole).alias("last_start"),
    )
    value = strict_json(F.col("raw"))
    state = F.when(value.isNull(), "bad_json").when(kind(value) != "object", "not_object").otherwise("ok")
    return (
        lines.filter(filled)
        .join(places, split)
        .select(
            "path",
            (F.col("lines_before") + F.col("id") - F.col("first") + 1).alias("line"),
            "raw",
            state.alias("state"),
            ((F.col("start") == F.col("last_start")) & (F.col("id") == F.col("last_filled"))).alias("is_last"),
        )
    )


def _at(df_col: str = "path"):
    return F.concat_ws(":", F.col(df_col), F.col("line").cast("string"))


def strict_violations(scan: DataFrame) -> DataFrame:
    """A1: every line that is not a JSON object, named ``path:line``."""
    return violation(scan.filter(F.col("state") != "ok"), "A1_bad_row", _at(), F.col("state"))


def good_rows(scan: DataFrame, schema: StructType | str | None = None) -> DataFrame:
    """A1, A2: the object rows; with a schema also their typed columns."""
    ok = scan.filter(F.col("state") == "ok").select("path", "line", "raw")
    if schema is None:
        return ok
    return ok.withColumn("__r", F.from_json("raw", schema)).select("path", "line", "raw", "__r.*")


def lenient_violations(scan: DataFrame) -> DataFrame:
    """A2: like A1, but a malformed last line is only a warning (an interrupted append)."""
    tail = (F.col("state") == "bad_json") & F.col("is_last")
    bad = scan.filter(F.col("state") != "ok").withColumn("severity", F.when(tail, "warning").otherwise("error"))
    out = violation(bad.filter("severity = 'error'"), "A2_bad_row", _at(), F.col("state"))
    return out.unionByName(violation(bad.filter("severity = 'warning'"), "A2_ignored_tail", _at(), F.col("state"), "warning"))


def with_seq(rows: DataFrame, *, width: int = 10**12) -> DataFrame:
    """Arrival order as one number: file ordinal, then line. Needs ``file_ordinal`` (A4)."""
    return rows.withColumn("seq", F.col("file_ordinal") * F.lit(width) + F.col("line"))


def write_jsonl(df: DataFrame, path: str, *, append: bool = False) -> None:
    """A3: JSON lines with nulls written out. Appending adds part files and rewrites none."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """A3: the append-only log in its inner form, Parquet part files."""
    df.write.mode("append").parquet(path)


def merge_files(spark: SparkSession, paths: Sequence[str], *, severity: str = "error") -> tuple[DataFrame | None, DataFrame]:
    """A4: the scans of several inputs in the given order, and a violation for each missing one.

    Only a path that does not exist counts as missing; any other fault of an input is raised.
    """
    scans, missing = [], []
    for i, path in enumerate(paths):
        try:
            scans.append(scan_lines(spark, path).withColumn("file_ordinal", F.lit(i)))
        except AnalysisException as fault:
            if fault.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(path)
    merged = None
    for s in scans:
        merged = s if merged is None else merged.unionByName(s, allowMissingColumns=True)
    rows = spark.createDataFrame([(p,) for p in missing], "path string")
    return merged, violation(rows, "A4_missing_file", "path", "file does not exist", severity)
