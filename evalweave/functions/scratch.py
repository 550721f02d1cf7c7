"""Tables written to the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from evalweave.functions.session import checkpoint_dir

#: With it, the shuffle files of a query go as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *, codec: str = "snappy", group_rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    ``group_rows``, for rows of megabytes, is the most rows of a row group. Writer and reader hold a row group
    per task, of 100 rows at least if nothing else is said.
    """
    path = scratch_path(df.sparkSession, name)
    options = {"compression": codec} | ({"parquet.block.row.count.limit": group_rows} if group_rows else {})
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps whose results are written.

    They otherwise stay until the driver happens to collect its garbage. Drop your own references
    to the frames of those steps first.
    """
    for _ in range(2):  # references from Python go first
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder at once; its shuffle files go with the job that wrote it.

    A query of several parts holds the shuffle files of one part at a time this way, not of all.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return written(df, name, codec="zstd")
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
