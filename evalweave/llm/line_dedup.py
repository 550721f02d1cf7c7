"""Line dedup by distinct-site spread: lines that many sites share are boilerplate.

A HyperLogLog sketch of sites per line key merges by aggregation, so a line that a third of all
documents hold costs one small sketch per task. Estimates near the threshold are settled by exact
distinct counts over the few lines concerned. Each boilerplate line keeps its first occurrence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.scratch import documents, release, written

BLANKS = " \t\r"


def _key(line: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds; together a key without collisions in practice."""
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def _lines(docs: DataFrame, text: str, doc: str, site: str, min_chars: int) -> DataFrame:
    exploded = docs.select(
        F.col(f"`{doc}`").alias("doc"), F.col(f"`{site}`").cast("string").alias("site"), F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("pos", "line")
    ).withColumn("line", F.btrim("line", F.lit(BLANKS)))
    one, two = _key(F.col("line"))
    return exploded.where(F.length("line") >= min_chars).select("doc", "site", "pos", one.alias("h1"), two.alias("h2"))


def strip_boilerplate(
    docs: DataFrame,
    *,
    text: str = "text",
    doc: str = "doc_id",
    site: str = "source",
    min_sites: int = 5,
    min_chars: int = 1,
    lg_k: int = 12,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus ``n_lines`` and ``n_removed``.

    Lines end at a line feed and compare without spaces, tabs and carriage returns at their ends. A
    line that is not blank and occurs on ``min_sites`` distinct sites is boilerplate: only its
    occurrence with the smallest (document, position) stays. Lines of fewer than ``min_chars``
    characters, blank ones by default, always stay.

    A null text stays null, with no lines; an empty text has one line. A null site counts as no
    site. Rows that share a document id count as one document, in which equal positions hold equal
    rank: each of them keeps its line. A null id is an id of its own, the smallest. A very long text is
    one row of one task. Without documents the result is empty. Other columns pass through, whatever their
    names, but for ``n_lines`` and ``n_removed``, which are replaced.
    """
    spark = docs.sparkSession
    margin = max(1.0, 3 * 1.04 / math.sqrt(2**lg_k) * min_sites)
    lines = _lines(docs, text, doc, site, min_chars)
    spread = written(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(F.struct("doc", "pos")).alias("first"))
        .select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites - margin),
        "spread",
    )
    release(spark)
    # The occurrences of lines that are boilerplate or near the threshold, a small part of all.
    found = written(lines.join(spread, ["h1", "h2"]), "occurrences")
    release(spark)
    exact = found.where(F.col("sites") <= min_sites + margin).groupBy("h1", "h2").agg(F.count_distinct("site").alias("exact"))
    over = spread.where(F.col("sites") > min_sites + margin).select("h1", "h2")
    boilerplate = over.unionByName(exact.where(F.col("exact") >= min_sites).select("h1", "h2"))
    # Only the places that go travel to their document. Rows that share its id may hold other lines there.
    place = lambda pos, one, two: F.concat_ws(":", pos.cast("string"), one.cast("string"), two.cast("string"))
    goes = found.join(boilerplate, ["h1", "h2"], "left_semi").where(~F.col("first").eqNullSafe(F.struct("doc", "pos")))
    gone = goes.groupBy(F.col("doc").alias("gone_doc")).agg(F.collect_set(place(F.col("pos"), F.col("h1"), F.col("h2"))).alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc}`").alias("doc"), F.split(F.col(f"`{text}`"), "\n").alias("lines"))
    joined = rows.join(gone, F.col("doc").eqNullSafe(F.col("gone_doc")), "left")
    places = F.transform("lines", lambda line, at: place(at, *_key(F.btrim(line, F.lit(BLANKS)))))
    # A difference of sets takes time linear in the lines, however many of them go.
    kept = F.transform(F.array_except(places, F.col("gone")), lambda p: F.get("lines", F.substring_index(p, ":", 1).cast("int")))
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept)
    counted = joined.select("row", "lines", left.alias("left"))
    columns = [F.col("row")[c].alias(c) if c != text else F.when(F.col("lines").isNotNull(), F.array_join("left", "\n")).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return counted.select(
        *columns,
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op1_line_dedup": op1_line_dedup}
LINES_SQL = """
    cut AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
        unnest(range(len(string_split(text, chr(10))))) AS pos FROM {docs}),
    lines AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM cut),
    shared AS (SELECT k, min((doc_id, pos)) AS first FROM lines WHERE length(k) >= 1
      GROUP BY k HAVING count(DISTINCT source) >= 5),
    marked AS (SELECT l.*, s.k IS NOT NULL AND s.first <> (doc_id, pos) AS gone FROM lines l LEFT JOIN shared s USING (k)),
    stripped AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
      FROM marked GROUP BY doc_id)"""
ORACLE = {
    "op1_line_dedup": "WITH "
    + LINES_SQL.format(docs="documents")
    + """ SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(s.text, '')) AS kept_sha256
    FROM documents d LEFT JOIN stripped s USING (doc_id)"""
}
