"""Tables written to the shared folder, and the tables of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalweave.functions.scratch import release, scratch_path, written  # noqa: F401


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
