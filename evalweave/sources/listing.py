"""Inventories over file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions.expr import count_where

# What a pointer file of large-file storage looks like.
POINTER_PREFIX = "version https://git-lfs.github.com/spec/"
POINTER_MAX_BYTES = 512
CASE_MARK = "/generation_task/instructions.md"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files under ``root``: ``rel, bytes, is_pointer``.

    Contents are read for files of at most 512 bytes only; the length filter reaches the source.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = files.filter(F.col("length") <= POINTER_MAX_BYTES).select(
        "path", F.col("content").cast("string").startswith(POINTER_PREFIX).alias("is_pointer")
    )
    base = root.rstrip("/")
    rel = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.substring(rel, F.lit(len(base) + 2), F.length(rel))
    return files.select("path", F.col("length").alias("bytes")).join(small, "path", "left").select(
        rel.alias("rel"), "bytes", F.coalesce("is_pointer", F.lit(False)).alias("is_pointer")
    )


def case_materials(files: DataFrame) -> DataFrame:
    """A5: material files of each case directory: ``case, category, collection, material, bytes,
    is_pointer``. A case without materials keeps one row with nulls."""
    cases = files.filter(F.concat(F.lit("/"), F.col("rel")).endswith(CASE_MARK)).select(
        F.substring("rel", F.lit(1), F.length("rel") - len(CASE_MARK)).alias("case")
    )
    parent = F.regexp_extract("rel", r"^(.*)/[^/]+$", 1)
    name = F.regexp_extract("rel", r"([^/]+)$", 1)
    mats = files.filter(name.startswith("material")).select(parent.alias("case"), name.alias("material"), "bytes", "is_pointer")
    parts = F.split("case", "/")
    second = F.when(F.size(parts) > 2, F.element_at(parts, 2)).otherwise(F.element_at(parts, -1))
    return cases.join(mats, "case", "left").select(
        "case", F.element_at(parts, 1).alias("category"), second.alias("collection"), "material", "bytes", "is_pointer"
    )


def inventory_totals(materials: DataFrame) -> DataFrame:
    """A5: cases, material files, bytes and pointer files per category."""
    per_case = materials.groupBy("category", "case").agg(
        F.count("material").alias("m"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), count_where(F.coalesce("is_pointer", F.lit(False))).alias("p")
    )
    return per_case.groupBy("category").agg(
        F.count("*").alias("cases"), F.sum("m").alias("material_files"), F.sum("b").alias("material_bytes"), F.sum("p").alias("pointer_files")
    )


_STAMP = r"(\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}_\p{Nd}{2}-\p{Nd}{2}-\p{Nd}{2})"
SCORE_SUFFIX = "_score.yaml"


def latest_score_artifact(files: DataFrame, *, judge_model: str | None = None) -> DataFrame:
    """Per ``result_dir`` the newest score file by ``(timestamp, name)``.

    ``pick`` is ``found``, ``ambiguous`` or ``none``. Ambiguous: several judge prefixes and no
    judge asked for, or several files without any timestamp. One aggregation per directory.
    """
    score = F.col("name").endswith(SCORE_SUFFIX)
    if judge_model:
        score = score & F.col("name").startswith(f"{judge_model}_")
    stamp = F.regexp_extract("name", _STAMP, 1)
    parts = files.select(
        "result_dir",
        F.when(score, F.col("name")).alias("name"),
        F.when(score, F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd_HH-mm-ss"))).alias("ts"),
        F.when(score, F.regexp_replace(F.substring("name", F.lit(1), F.instr("name", stamp) - 1), "_$", "")).alias("prefix"),
    )
    stamped = F.col("ts").isNotNull()
    named = F.when(stamped & (F.col("prefix") != ""), F.col("prefix"))
    agg = parts.groupBy("result_dir").agg(
        F.count("name").alias("n_files"),
        F.count("ts").alias("n_stamped"),
        F.min(named).alias("lo"),
        F.max(named).alias("hi"),
        F.max(F.when(stamped, F.struct("ts", "name"))).alias("newest"),
        F.min("name").alias("only"),
    )
    many = F.lit(judge_model is None) & F.col("lo").isNotNull() & (F.col("lo") != F.col("hi"))
    pick = (
        F.when(F.col("n_files") == 0, "none")
        .when(F.col("n_stamped") > 0, F.when(many, "ambiguous").otherwise("found"))
        .when(F.col("n_files") == 1, "found")
        .otherwise("ambiguous")
    )
    out = agg.withColumn("pick", pick)
    chosen = F.when(F.col("n_stamped") > 0, F.col("newest.name")).otherwise(F.col("only"))
    return out.select("result_dir", "pick", F.when(F.col("pick") == "found", chosen).alias("name"), "n_files")
