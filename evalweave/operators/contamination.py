"""Phrase overlap between train examples and heldout outputs.

Sizes at scale: candidate texts are the big side. A Bloom filter of the train n-grams stands beside
their scan, so only n-grams that may be in a train text become rows. These are counted and meet the
train n-grams by ``(pack, gram)``, which spreads a hot pack over its grams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalweave.functions.bloom import KeyFilter
from evalweave.functions.expr import count_where, id_part, let
from evalweave.functions.patterns import content_grams, text_content_grams, tokens
from evalweave.functions.scan import DEFAULT_BLOCK, blocked_scan

CELL = ["pack_id", "task_id", "mode"]


def text_grams(df: DataFrame, keys: Sequence[str], n: int, *, text: str = "text") -> DataFrame:
    """Distinct content n-grams of each text."""
    grams = F.array_distinct(text_content_grams(F.col(text), n))
    return df.select(*keys, F.explode(grams).alias("gram"))


def chunk_grams(
    chunks: DataFrame, group: Sequence[str], n: int, *, pos: str = "pos", block: int = DEFAULT_BLOCK
) -> DataFrame:
    """Distinct content n-grams per group of the chunks joined in ``pos`` order.

    N-grams may run across chunk borders, yet no group is ever joined into one string: grams
    inside a chunk come straight from its text. For the borders only the first and last ``n - 1``
    tokens of each chunk travel. Chunks with tokens get a dense index by a blocked scan, and each
    sends its head to the ``n - 1`` chunks before it.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    inner = text_grams(chunks, group, n)
    if n == 1:
        return inner.distinct()
    toks = chunks.select(*group, F.col(pos).cast("long").alias("pos"), tokens(F.col("text")).alias("toks"))
    ends = toks.filter(F.size("toks") > 0).select(
        *group,
        "pos",
        F.slice("toks", 1, n - 1).alias("head"),
        F.slice("toks", -F.least(F.size("toks"), F.lit(n - 1)), F.lit(n - 1)).alias("tail"),
    )
    indexed = blocked_scan(ends, group, "pos", F.lit(1), "idx", block=block)
    steps = F.explode(F.sequence(F.lit(1), F.lit(n - 1)))
    heads = (
        indexed.select(*group, "idx", "head", steps.alias("k"))
        .withColumn("idx", F.col("idx") - F.col("k"))
        .filter("idx >= 0")
        .groupBy(*group, "idx")
        .agg(F.array_sort(F.collect_list(F.struct("k", "head"))).alias("after"))
    )
    follow = F.slice(F.flatten(F.transform("after", lambda h: h["head"])), 1, n - 1)
    border = indexed.join(heads, [*group, "idx"]).select(
        *group, F.explode(content_grams(F.concat("tail", follow), n)).alias("gram")
    )
    return inner.unionByName(border).distinct()


def contamination_rows(
    candidates: DataFrame,
    train_chunks: DataFrame,
    heldout_chunks: DataFrame,
    *,
    n: int = 3,
    baseline_mode: str = "prompt_only",
) -> tuple[DataFrame, DataFrame]:
    """E4 and E5. Returns ``(rows, matches)``.

    ``candidates``: cell columns, ``seq`` (unique), ``status``, ``text``. ``train_chunks``:
    ``pack_id, pos, text``; its packs are the known packs. ``heldout_chunks``:
    ``pack_id, task_id, pos, text``. Only success rows of known packs are reported.
    ``matches`` holds the suspicious phrases with their frequency in the candidate.
    """
    cells = candidates.select(
        *[id_part(c).alias(c) for c in CELL], "seq", "status", "text"
    ).filter(F.col("status") == "success")
    train = chunk_grams(train_chunks, ["pack_id"], n)
    heldout = chunk_grams(heldout_chunks, ["pack_id", "task_id"], n)
    packs = train_chunks.select("pack_id").distinct()
    may_hold = KeyFilter(train, ["pack_id", "gram"])

    def counted(grams: Column) -> Column:
        """Number of distinct grams, and those that a filter of the train grams lets through.

        A text without any gets a stand-in of its own, which no train text holds.
        """
        near = F.filter(grams, lambda g: may_hold(F.xxhash64(F.col("pack_id"), g)))
        none = F.array(F.concat(F.lit("\x00"), F.col("seq").cast("string")))
        return F.struct(
            F.size(F.array_distinct(grams)).cast("long").alias("n"), F.when(F.size(near) > 0, near).otherwise(none).alias("near")
        )

    known = cells.join(packs, "pack_id", "left_semi").withColumn("__words", may_hold.words)
    scanned = known.select(*CELL, "seq", let(text_content_grams(F.col("text"), n), counted).alias("g"))
    keys = [*CELL, "seq", "candidate_grams"]
    found = (
        scanned.select(*CELL, "seq", F.col("g.n").alias("candidate_grams"), F.explode("g.near").alias("gram"))
        .groupBy(*keys, "gram")
        .agg(F.count("*").alias("candidate_count"))
        .join(train.withColumn("in_train", F.lit(True)), ["pack_id", "gram"], "left")
        .join(heldout.withColumn("in_heldout", F.lit(True)), ["pack_id", "task_id", "gram"], "left")
    )
    bad = F.col("in_train").isNotNull() & F.col("in_heldout").isNull()
    matches = found.filter(bad).select("seq", "pack_id", "task_id", "gram", "candidate_count")

    train_n = train.groupBy("pack_id").agg(F.count("*").alias("train_grams"))
    heldout_n = heldout.groupBy("pack_id", "task_id").agg(F.count("*").alias("heldout_grams"))
    per_row = found.groupBy(*keys).agg(count_where(bad).alias("suspicious"))
    rows = (
        per_row.join(train_n, "pack_id", "left")
        .join(heldout_n, ["pack_id", "task_id"], "left")
        .na.fill(0, ["train_grams", "heldout_grams"])
        .withColumn(
            "suspicious_rate",
            F.coalesce(F.try_divide(F.col("suspicious").cast("double"), F.col("candidate_grams").cast("double")), F.lit(0.0)),
        )
    )
    base = (
        per_row.filter(F.col("mode") == baseline_mode)
        .groupBy("pack_id", "task_id")
        .agg(F.max_by("suspicious", "seq").alias("baseline_suspicious"))
    )
    rows = rows.join(base, ["pack_id", "task_id"], "left").withColumn(
        "excess", F.col("suspicious") - F.col("baseline_suspicious")
    )
    return rows, matches


def top_matches(matches: DataFrame, *, top_k: int | None = None) -> DataFrame:
    """The suspicious phrases of each candidate, most frequent first, ties by text; ``top_k`` of them if given."""
    order = W.partitionBy("seq").orderBy(F.desc("candidate_count"), F.asc("gram"))
    ranked = matches.withColumn("rank", F.row_number().over(order))
    if top_k is not None:
        ranked = ranked.filter(F.col("rank") <= top_k)
    return ranked.select("seq", "rank", F.col("gram").alias("phrase"), "candidate_count")


def contamination_summary(rows: DataFrame) -> DataFrame:
    """Per mode, count and means; rows without a baseline do not enter the mean excess."""
    return rows.groupBy(id_part("mode").alias("mode")).agg(
        F.count("*").alias("n"),
        F.avg("suspicious").alias("mean_suspicious"),
        F.avg("suspicious_rate").alias("mean_rate"),
        F.avg("excess").alias("mean_excess"),
    )
