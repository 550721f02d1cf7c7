"""Two raters on the same outputs (F19), and labels for their disagreements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.expr import has_text, id_part
from evalweave.functions.joins import one_row
from evalweave.operators.text import text_stats, truncate_preview
from evalweave.operators.violations import union_all, violation

CELL = ["pack_id", "task_id", "mode"]
EPSILON = 1e-9  # fixed value: deltas this small are ties


def delta_sign(value: Column, epsilon: float = EPSILON) -> Column:
    return F.when(value > epsilon, "positive").when(value < -epsilon, "negative").otherwise("tie")


def rater_success(rows: DataFrame) -> DataFrame:
    """Success rows of fully keyed cells with a score."""
    keyed = rows.withColumns({c: id_part(c) for c in CELL}).filter(
        (F.col("pack_id") != "") & (F.col("task_id") != "") & (F.col("mode") != "")
    )
    return keyed.filter((F.col("status") == "success") & F.col("overall_score").isNotNull())


def duplicate_success_cells(rows: DataFrame, rater: str) -> DataFrame:
    """cells with more than one success row, which make the comparison invalid."""
    dup = rater_success(rows).groupBy(*CELL).agg(F.count("*").alias("n")).filter("n > 1")
    return violation(dup, "F19_duplicate_success_cell", F.concat_ws("::", *CELL), rater)


def disagreements(
    left: DataFrame,
    right: DataFrame,
    *,
    baseline_mode: str,
    modes: Sequence[str] | None = None,
    max_output_chars: int | None = None,
) -> DataFrame:
    """cells where the two raters' deltas to their own baseline differ in sign.

    Rows carry ``overall_score``, ``judge_model`` and ``text``. Four narrow joins on scores find
    the disagreements first; output texts and their statistics are joined for those cells only. Where
    both sides carry ``scores`` (map of criterion to an array of ``score, reason, parse_error``), the
    packets hold them as lists by name: ``left_scores, right_scores, left_baseline_scores,
    right_baseline_scores``. ``max_output_chars`` shortens the outputs shown; without it they are whole.
    """
    task = ["pack_id", "task_id"]
    cut = lambda text: truncate_preview(text, max_output_chars or 0)
    scored = "scores" in left.columns and "scores" in right.columns

    def scores(rows: DataFrame, side: str) -> DataFrame:
        return rater_success(rows).select(
            *CELL, F.col("overall_score").cast("double").alias(f"{side}_score"), F.col("judge_model").alias(f"{side}_judge_model")
        )

    both = scores(left, "left").join(scores(right, "right"), CELL)
    base = both.filter(F.col("mode") == baseline_mode).select(
        *task, F.col("left_score").alias("left_baseline"), F.col("right_score").alias("right_baseline")
    )
    cells = both.filter(F.col("mode") != baseline_mode if modes is None else F.col("mode").isin(list(modes)))
    joined = (
        cells.join(base, task)
        .withColumn("left_delta", F.col("left_score") - F.col("left_baseline"))
        .withColumn("right_delta", F.col("right_score") - F.col("right_baseline"))
        .withColumn("left_sign", delta_sign(F.col("left_delta")))
        .withColumn("right_sign", delta_sign(F.col("right_delta")))
        .filter(F.col("left_sign") != F.col("right_sign"))
    )
    flip = F.col("left_sign").isin("positive", "negative") & F.col("right_sign").isin("positive", "negative")
    joined = joined.withColumn("disagreement_kind", F.when(flip, "sign_flip").otherwise("sign_or_tie_disagreement"))

    def texts(rows: DataFrame, name: str, mode: Column | None) -> DataFrame:
        t = rater_success(rows)
        wide = [F.col("text").alias(name)]
        if scored:
            wide.append(F.array_sort(F.map_entries("scores")).alias(name.replace("_base", "_baseline").replace("_text", "_scores")))
        if mode is None:
            return t.select(*CELL, *wide)
        return t.filter(F.col("mode") == mode).select(*task, *wide)

    base_mode = F.lit(baseline_mode)
    out = (
        joined.join(texts(left, "left_text", None), CELL)
        .join(texts(right, "right_text", None), CELL)
        .join(texts(left, "left_base_text", base_mode), task)
        .join(texts(right, "right_base_text", base_mode), task)
    )
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    return (
        out.withColumn("same_candidate_output", same("left_text", "right_text"))
        .withColumn("same_baseline_output", same("left_base_text", "right_base_text"))
        .withColumn("candidate_stats", text_stats("left_text"))
        .withColumn("baseline_stats", text_stats("left_base_text"))
        .withColumn("candidate_output", cut("left_text"))
        .withColumn("baseline_output", cut("left_base_text"))
        .withColumn("right_candidate_stats", text_stats("right_text"))
        .withColumn("right_baseline_stats", text_stats("right_base_text"))
        .withColumn("right_candidate_output", F.when(~F.col("same_candidate_output"), cut("right_text")))
        .withColumn("right_baseline_output", F.when(~F.col("same_baseline_output"), cut("right_base_text")))
        .drop("left_text", "right_text", "left_base_text", "right_base_text")
    )


def output_mismatches(packets: DataFrame) -> DataFrame:
    """disagreements that do not judge the same outputs (an error unless the caller allows it)."""
    bad = packets.filter(~F.col("same_candidate_output") | ~F.col("same_baseline_output"))
    return violation(bad, "F19_output_mismatch", F.concat_ws("::", *CELL), "left and right rows hold different outputs")


def with_context(
    packets: DataFrame,
    *,
    tasks: DataFrame | None = None,
    private: DataFrame | None = None,
    skills: DataFrame | None = None,
    skill_mode: Column | None = None,
    materials: DataFrame | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """task, private and skill context of each packet by left joins.

    ``tasks``: ``pack_id, task_id, source, task_input``. ``private``: ``pack_id, task_id,
    supervision, judge``. ``skills``: ``pack_id, mode, status, seq, skill_md``, last success wins.
    ``skill_mode`` gives the skill mode of a packet's mode; where ``skills`` carries ``solver_model``, so does
    the packet. ``materials``: ``pack_id, task_id, pos, path, text``; a packet gets its task's in order.
    ``max_chars`` shortens texts; without it they are whole.
    """
    key = ["pack_id", "task_id"]
    cut = lambda text: truncate_preview(text, max_chars or 0)
    if tasks is not None:
        shown = tasks.select(*key, "source", cut("task_input").alias("task_input"))
        packets = packets.join(one_row(shown, *key), key, "left")
    if materials is not None:
        # Only materials of tasks in dispute are gathered.
        wanted = materials.join(packets.select(*key).distinct(), key, "left_semi")
        lists = wanted.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "path", cut("text").alias("text")))).alias("materials"))
        packets = packets.join(lists, key, "left")
    if private is not None:
        packets = packets.join(private.select(*key, "supervision", "judge"), key, "left")
    if skills is not None and skill_mode is not None:
        ok = skills.filter(F.col("status") == "success")
        newest = ok.groupBy("pack_id", "mode").agg(F.max("seq").alias("seq"))
        last = ok.join(newest, ["pack_id", "mode", "seq"], "left_semi").select(
            "pack_id", F.col("mode").alias("skill_mode"), F.col("skill_md").alias("__md"), F.lit(True).alias("__found"),
            *(["solver_model"] if "solver_model" in skills.columns else []),
        )
        packets = packets.withColumn("skill_mode", skill_mode).join(last, ["pack_id", "skill_mode"], "left")
        state = F.when(F.col("skill_mode").isNull(), F.lit(None)).when(F.col("__found"), "found").otherwise("missing")
        packets = (
            packets.withColumn("skill_status", state)
            .withColumn("skill_stats", text_stats("__md"))
            .withColumn("skill_preview", cut("__md"))
            .drop("__md", "__found")
        )
    return packets


# -- F20 --------------------------------------------------------------------------------------

# Labels of a disagreement, and the signals a reviewer may find more credible.
LABELS = ["judge_error", "candidate_error", "baseline_error", "small_delta_noise", "ambiguous"]
SIGNALS = ["left", "right", "both", "neither", "unresolved"]
HASHES = ["candidate_sha256", "baseline_sha256"]
_HEX64 = "^[0-9a-f]{64}$"


def taxonomy_violations(packets: DataFrame, annotations: DataFrame) -> DataFrame:
    """every fault of a labelled set of disagreement packets.

    ``packets``: cell columns and the two hashes. ``annotations``: the same plus ``label,
    more_credible_signal, rationale``. Counts per cell are aggregated before the outer join.
    """
    key = F.concat_ws("::", *CELL)
    full = (F.col("pack_id") != "") & (F.col("task_id") != "") & (F.col("mode") != "")
    p_all = packets.withColumns({c: id_part(c) for c in CELL})
    a_all = annotations.withColumns({c: id_part(c) for c in CELL})
    p, a = p_all.filter(full), a_all.filter(full)
    among = lambda c, values: F.coalesce(F.col(c).isin(values), F.lit(False))
    hexed = lambda c: F.coalesce(F.col(c).rlike(_HEX64), F.lit(False))
    rules = [
        violation(p_all.filter(~full), "F20_packet_key_missing", key),
        violation(a_all.filter(~full), "F20_annotation_key_missing", key),
        violation(a.filter(~among("label", LABELS)), "F20_invalid_label", key, F.col("label")),
        violation(a.filter(~among("more_credible_signal", SIGNALS)), "F20_invalid_signal", key, F.col("more_credible_signal")),
        violation(a.filter(~has_text("rationale")), "F20_rationale_missing", key),
    ]
    for h in HASHES:
        rules.append(violation(p.filter(~hexed(h)), "F20_packet_hash", key, h))
        rules.append(violation(a.filter(~hexed(h)), "F20_annotation_hash", key, h))
    pn = p.groupBy(*CELL).agg(F.count("*").alias("np"), F.max(F.struct(*HASHES)).alias("row"))
    pn = pn.select(*CELL, "np", *[F.col(f"row.{h}").alias(f"p_{h}") for h in HASHES])
    an = a.groupBy(*CELL).agg(F.count("*").alias("na"), F.max(F.struct(*HASHES)).alias("row"))
    an = an.select(*CELL, "na", *[F.col(f"row.{h}").alias(f"a_{h}") for h in HASHES])
    both = pn.join(an, CELL, "full_outer").na.fill(0, ["np", "na"])
    same = F.lit(True)
    for h in HASHES:
        same = same & F.col(f"p_{h}").eqNullSafe(F.col(f"a_{h}"))
    rules += [
        violation(both.filter("np > 1"), "F20_duplicate_packet", key),
        violation(both.filter("np > 0 and na <> 1"), "F20_annotation_count", key, F.col("na").cast("string")),
        violation(both.filter((F.col("np") > 0) & (F.col("na") == 1) & ~same), "F20_hash_mismatch", key),
        violation(both.filter("np = 0"), "F20_orphan_annotation", key),
    ]
    for name, df in (("packets", packets), ("annotations", annotations)):
        empty = df.limit(1).agg(F.count("*").alias("n")).filter("n = 0")
        rules.append(violation(empty, "F20_empty_input", F.lit(name)))
    return union_all(rules)


def label_counts(annotations: DataFrame) -> DataFrame:
    """annotations per label."""
    return annotations.filter(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n"))
