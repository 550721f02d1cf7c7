"""From documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``; ``docs`` is what the stage before it kept, written as Parquet and
read again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import decontaminate, line_dedup, ngram_join, packing, quality_knn
from evalweave.llm.scratch import documents, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 2) does not reject."""
    model = quality_knn.fit_quality(docs, documents(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality_knn.score(docs.select(COLUMNS), model).where("score >= 0.5").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeats of boilerplate lines of any length (operator 1); ``n_chars`` counts what is left."""
    out = line_dedup.strip_boilerplate(docs.select(COLUMNS), min_chars=1)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 5)."""
    return ngram_join.one_per_group(docs.select(COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages (operator 3)."""
    return decontaminate.drop_leaks(docs.select(COLUMNS), documents(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of powers of two (operator 7)."""
    return packing.packed_digest(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

# The classifier, the edit matching and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
