"""Preference formatting: common prompt and masked completions of chosen and rejected conversations.

Only DataFrame functions. Turns meet at (pair, turn number), so a very long conversation is spread
over tasks; rendered text is gathered in blocks of consecutive turn numbers, never as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.scratch import documents

# Fixed values of the template.
BEGIN, MIDDLE, END = "<|", "|>\n", "\n<|end|>\n"


def _side(rows: DataFrame, name: str, pair: str, turn: str, role: str, text: str) -> DataFrame:
    return rows.select(
        F.col(pair).alias("pair_id"),
        F.coalesce(F.col(turn), F.lit(-1)).cast("long").alias("turn"),
        F.lit(name).alias("side"),
        F.struct(F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("said"),
    )


def _rendered(parts: Column, trained_roles: list[str]) -> Column:
    """Text and trained character ranges of an ordered list of (turn, side lists)."""

    def step(acc: Column, x: Column) -> Column:
        head = F.concat(F.lit(BEGIN), x["role"], F.lit(MIDDLE))
        start = acc["size"] + F.length(head)
        stop = start + F.length(x["text"]) + F.lit(len(END))
        ranges = F.when(x["role"].isin(trained_roles), F.concat(acc["ranges"], F.array(F.struct(start.alias("start"), stop.alias("stop")))))
        return F.struct(
            stop.alias("size"),
            F.concat(acc["texts"], F.array(F.concat(head, x["text"], F.lit(END)))).alias("texts"),
            ranges.otherwise(acc["ranges"]).alias("ranges"),
        )

    zero = F.struct(
        F.lit(0).alias("size"),
        F.array().cast("array<string>").alias("texts"),
        F.array().cast("array<struct<start:int,stop:int>>").alias("ranges"),
    )
    return F.aggregate(
        parts, zero, step, lambda acc: F.struct(F.array_join(acc["texts"], "").alias("text"), acc["ranges"].alias("ranges"), F.size(acc["texts"]).alias("turns"))
    )


def preference_pairs(
    chosen: DataFrame,
    rejected: DataFrame,
    *,
    pair: str = "pair_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained_roles: tuple[str, ...] = ("assistant",),
    block: int = 1024,
) -> DataFrame:
    """One row per pair and block of ``block`` turn numbers: ``prompt``, ``chosen``, ``rejected``.

    The prompt is the longest prefix of turns on which both conversations agree in role and text; it
    is rendered once and nothing in it is trained. Each of the others is a struct ``text, ranges,
    turns``; ``ranges`` are the character ranges (of that block's text) that the loss counts: what a
    trained role says, with the end mark. Conversations of fewer than ``block`` turns have one row.

    A null role or text counts as empty, a null turn comes first. Exact repeats of a turn count
    once; several turns of one number stand in the order of role and text. A pair with one
    conversation has an empty prompt and an empty other side; equal conversations are all prompt.
    Rows without a pair id form no pair and are left out. Other columns are ignored.
    """
    both = _side(chosen, "c", pair, turn, role, text).unionByName(_side(rejected, "r", pair, turn, role, text))
    met = (
        both.where(F.col("pair_id").isNotNull())
        .groupBy("pair_id", "turn")
        .agg(*[F.sort_array(F.collect_set(F.when(F.col("side") == s, F.col("said")))).alias(s) for s in ("c", "r")])
    )
    split_at = met.groupBy("pair_id").agg(F.min(F.when(F.col("c") != F.col("r"), F.col("turn"))).alias("split_at"))
    parted = met.join(split_at, "pair_id").withColumn("shared", F.col("split_at").isNull() | (F.col("turn") < F.col("split_at")))
    lists = [
        F.sort_array(F.collect_list(F.when(cond, F.struct("turn", F.col(s).alias("said"))))).alias(name)
        for name, s, cond in (("prompt", "c", F.col("shared")), ("chosen", "c", ~F.col("shared")), ("rejected", "r", ~F.col("shared")))
    ]
    grouped = parted.groupBy("pair_id", F.floor(F.col("turn") / block).cast("long").alias("block")).agg(*lists)
    flat = lambda name: F.flatten(F.transform(name, lambda t: t["said"]))
    return grouped.select("pair_id", "block", *[_rendered(flat(n), list(trained_roles)).alias(n) for n in ("prompt", "chosen", "rejected")])


def diverging(conversations: DataFrame) -> DataFrame:
    """A rejected conversation for each: its turns from some place on come from the next conversation.

    Turns below 1 + id % 4, and those without a number, stay the conversation's own; from there on they
    are those of conversation id + 1, so both share a prefix.
    """
    keep = F.col("conv_id") % 4 + 1
    own = conversations.where(F.coalesce(F.col("turn") < keep, F.lit(True)))
    other = conversations.withColumn("conv_id", F.col("conv_id") - 1).where(F.col("turn") >= keep)
    known = conversations.select("conv_id").distinct()
    return own.unionByName(other.join(known, "conv_id", "left_semi"))


def op9_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as chosen, and as rejected one that leaves it after some turns."""
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = preference_pairs(turns, diverging(turns), pair="conv_id")
    mask = lambda s: F.array_join(F.transform(f"{s}.ranges", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["stop"].cast("string"))), ",")
    return pairs.select(
        "pair_id",
        "block",
        F.col("prompt.text").alias("prompt"),
        F.col("prompt.turns").alias("prompt_turns"),
        F.col("chosen.text").alias("chosen"),
        F.col("rejected.text").alias("rejected"),
        mask("chosen").alias("chosen_mask"),
        mask("rejected").alias("rejected_mask"),
    )


QUERIES = {"op9_preference_pairs": op9_preference_pairs}
ORACLE = {
    "op9_preference_pairs": """
WITH s AS (SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT conv_id, 1, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND coalesce(turn < conv_id % 4 + 1, true)
  UNION ALL SELECT conv_id - 1, 1, turn, role, text FROM conversations WHERE turn >= (conv_id - 1) % 4 + 1 AND conv_id - 1 IN (SELECT conv_id FROM conversations)),
t AS (SELECT DISTINCT pair_id, side, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM s),
met AS (SELECT pair_id, turn, list((role, text) ORDER BY role, text) FILTER (side = 0) AS c,
    list((role, text) ORDER BY role, text) FILTER (side <> 0) AS r FROM t GROUP BY ALL),
cut AS (SELECT pair_id, min(turn) FILTER (c IS DISTINCT FROM r) AS split_at FROM met GROUP BY ALL),
parts AS (SELECT t.pair_id, turn // 1024 AS block, turn, role, text,
    CASE WHEN turn < coalesce(split_at, 1099511627776) THEN 'p' WHEN side = 0 THEN 'c' ELSE 'r' END AS part
  FROM t JOIN cut USING (pair_id) WHERE side = 0 OR turn >= coalesce(split_at, 1099511627776)),
sized AS (SELECT *, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS shown,
    sum(length(role) + length(text) + 14) OVER (PARTITION BY pair_id, block, part ORDER BY turn, role, text) AS stop FROM parts),
masked AS (SELECT *, (stop - length(text) - 9)::BIGINT::VARCHAR || '-' || stop::BIGINT::VARCHAR AS span FROM sized)
SELECT pair_id, block, coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (part = 'p'), '') AS prompt,
  (count(*) FILTER (part = 'p'))::INTEGER AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (part = 'c'), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (part = 'r'), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY turn, role, text) FILTER (part = 'c' AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY turn, role, text) FILTER (part = 'r' AND role = 'assistant'), '') AS rejected_mask
FROM masked GROUP BY pair_id, block"""
}
