"""Score cells: status, coverage, paired deltas, negative transfer.

A *cell* is ``(pack_id, task_id, mode)``. Score rows carry ``status``, ``overall_score`` (double)
and ``seq``, the arrival order. Every function takes ``by``: extra grouping columns (file,
evaluator, judge, ...), so that many reports come out of one plan.

Shuffle shape: raw rows are reduced map-side to one row per cell first. All later steps work on
cells. The only windows run over ``(by, pack_id, task_id)``, which holds one row per mode.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalweave.functions.expr import count_where, id_part, is_finite, label, lit_list, ratio
from evalweave.operators.tokens import token_usage

CELL = ["pack_id", "task_id", "mode"]
SUCCESS = "success"


def expected_cells(
    heldout: DataFrame, modes: Sequence[str], *, limit_heldout: int | None = None
) -> DataFrame:
    """heldout tasks x modes. ``limit_heldout`` keeps list positions below it.

    The mode list is a literal array, so this is a narrow explode and not a cross join.
    """
    rows = heldout.filter((id_part("pack_id") != "") & (id_part("task_id") != ""))
    if limit_heldout is not None:
        rows = rows.filter(F.col("pos") < limit_heldout)
    kept = [m for m in dict.fromkeys(modes) if m]
    return rows.select(
        id_part("pack_id").alias("pack_id"),
        id_part("task_id").alias("task_id"),
        F.explode(lit_list(kept)).alias("mode"),
    )


def normalise_cells(rows: DataFrame, *, blank_mode: str = "unknown") -> DataFrame:
    """Key parts and labels as the summaries read them; other columns pass through."""
    return rows.withColumns(
        {
            "pack_id": id_part("pack_id"),
            "task_id": id_part("task_id"),
            "mode": label("mode", blank_mode),
            "status": label("status"),
        }
    )


# -- F2 ---------------------------------------------------------------------------------------

# Finish reasons that mean the judge refused.
REFUSAL_REASONS = ("content_filter", "refusal", "safety")


def is_valid_score(score: str | Column) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return is_finite(score) & F.coalesce(score.between(1, 10), F.lit(False))


def _judge_chain(finish: Column, parse_error: Column, score: Column):
    return (
        (F.coalesce(finish.isin(*REFUSAL_REASONS), F.lit(False)), "judge_refusal"),
        (~finish.eqNullSafe(F.lit("stop")), "judge_incomplete"),
        (parse_error.isNotNull() | score.isNull(), "judge_parse_error"),
        (~is_valid_score(score), "judge_invalid_score"),
    )


def _chain(steps, default: str) -> Column:
    out = None
    for cond, name in steps:
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(default))


def score_row_status(gen_finish: Column, judge_finish: Column, parse_error: Column, score: Column) -> Column:
    """status of a generated and judged row, first failing step wins."""
    steps = ((~gen_finish.eqNullSafe(F.lit("stop")), "generation_incomplete"),)
    return _chain(steps + _judge_chain(judge_finish, parse_error, score), SUCCESS)


def audit_row_status(judge_finish: Column, parse_error: Column, score: Column) -> Column:
    """F2 variant for example audits: no generation step."""
    return _chain(_judge_chain(judge_finish, parse_error, score), SUCCESS)


def report_row_status(judge_finish: Column, parse_error: Column) -> Column:
    """F2 variant for grounding and pattern reports: finish reason, then parse error."""
    return _chain(
        (
            (~judge_finish.eqNullSafe(F.lit("stop")), "judge_incomplete"),
            (parse_error.isNotNull(), "judge_parse_error"),
        ),
        SUCCESS,
    )


# -- F4 ---------------------------------------------------------------------------------------


def criterion_call_status(finish: Column, parse_error: Column) -> Column:
    return _chain(
        (
            (F.coalesce(finish.isin(*REFUSAL_REASONS), F.lit(False)), "judge_refusal"),
            (~finish.eqNullSafe(F.lit("stop")), "judge_incomplete"),
            (parse_error.isNotNull(), "judge_parse_error"),
        ),
        SUCCESS,
    )


def cell_scores_from_calls(calls: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """one status and mean score per cell from its criterion calls.

    ``calls``: cell columns, ``pos``, ``finish_reason``, ``parse_error``, ``score`` (integer, null
    when not an integer). The first failing criterion gives the status; calls behind it are not
    counted. One aggregation: the failing position is a ``min``, the status a ``min_by``.
    """
    keys = [*by, *CELL]
    status = criterion_call_status(F.col("finish_reason"), F.col("parse_error"))
    failed = F.col("__status") != SUCCESS
    agg = (
        calls.withColumn("__status", status)
        .groupBy(*keys)
        .agg(
            F.min_by(F.when(failed, F.col("__status")), F.when(failed, F.col("pos"))).alias("bad"),
            F.min(F.when(failed, F.col("pos"))).alias("first_bad_pos"),
            F.avg(F.col("score")).alias("mean_score"),
            F.count("*").alias("n_calls"),
        )
    )
    return agg.select(
        *keys,
        F.coalesce("bad", F.lit(SUCCESS)).alias("status"),
        F.when(F.col("bad").isNull(), F.col("mean_score")).alias("overall_score"),
        "first_bad_pos",
        "n_calls",
    )


# -- F5 ---------------------------------------------------------------------------------------


def status_counts(rows: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """rows per status, overall (``mode`` null) and per mode, from one shuffle."""
    rows = normalise_cells(rows)
    per_mode = rows.groupBy(*by, "mode", "status").agg(F.count("*").alias("n"))
    sets = [[*by, "mode", "status"], [*by, "status"]]
    return (
        per_mode.groupingSets(
            [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*by, "mode", "status"]]
        )
        .agg(F.sum("n").alias("n"), F.grouping("mode").alias("all_modes"))
        .select(*by, (F.col("all_modes") == 1).alias("all_modes"), "mode", "status", "n")
    )


def mode_scores(rows: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """count and mean of finite scores on success rows. Duplicate rows all count."""
    rows = normalise_cells(rows).filter((F.col("status") == SUCCESS) & is_finite("overall_score"))
    return rows.groupBy(*by, "mode").agg(
        F.count("*").alias("n"), F.avg("overall_score").alias("mean_score")
    )


# -- cells ------------------------------------------------------------------------------------


def cell_table(rows: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """One row per observed cell: last finite success score, success flag, row count."""
    ok = F.col("status") == SUCCESS
    scored = ok & is_finite("overall_score")
    return (
        normalise_cells(rows)
        .groupBy(*by, *CELL)
        .agg(
            F.max_by(F.when(scored, F.col("overall_score")), F.when(scored, F.col("seq"))).alias("score"),
            F.max(ok).alias("has_success"),
            F.count("*").alias("n_rows"),
        )
    )


def cell_statuses(rows: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Per cell, its statuses with their counts as sorted text (``error:2,success:1``).

    Counted per status before they are gathered, so a cell with many repeats stays one short
    list of distinct labels.
    """
    counts = normalise_cells(rows).groupBy(*by, *CELL, "status").agg(F.count("*").alias("n"))
    item = F.concat_ws(":", F.col("status"), F.col("n").cast("string"))
    return counts.groupBy(*by, *CELL).agg(
        F.array_join(F.array_sort(F.collect_list(item)), ",").alias("statuses")
    )


# -- F7 ---------------------------------------------------------------------------------------


def coverage_cells(
    rows: DataFrame, expected: DataFrame, *, require_finite: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """every expected or observed cell, classified.

    ``missing``, ``non_success``, ``unexpected`` or ``ok``. With ``require_finite=False`` a
    success row is enough, whatever its score (the metrics-file variant).
    """
    keys = [*by, *CELL]
    good = F.col("score").isNotNull() if require_finite else F.col("has_success")
    seen = cell_table(rows, by=by).select(*keys, good.alias("good"), F.lit(True).alias("seen"))
    want = expected.select(*keys).distinct().withColumn("wanted", F.lit(True))
    joined = want.join(seen, keys, "full_outer")
    state = (
        F.when(F.col("wanted").isNull(), "unexpected")
        .when(F.col("seen").isNull(), "missing")
        .when(~F.col("good"), "non_success")
        .otherwise("ok")
    )
    return joined.select(*keys, state.alias("state"))


def coverage_summary(cells: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """F7 counts over ``coverage_cells``."""
    s = F.col("state")
    out = cells.groupBy(*by).agg(
        count_where(s != "unexpected").alias("expected_cells"),
        count_where(s.isin("ok", "non_success")).alias("observed_cells"),
        count_where(s == "ok").alias("successful_cells"),
        count_where(s == "missing").alias("missing_cells"),
        count_where(s == "non_success").alias("non_success_cells"),
        count_where(s == "unexpected").alias("unexpected_cells"),
    )
    return out.withColumn(
        "complete", (F.col("missing_cells") == 0) & (F.col("non_success_cells") == 0)
    )


# -- F6 ---------------------------------------------------------------------------------------


def paired_cells(
    rows: DataFrame,
    *,
    baseline_mode: str,
    expected: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """per cell the mode's and the baseline's last success score.

    The baseline is found with a window over ``(by, pack_id, task_id)``, which holds at most one
    row per mode, so no self-join is needed. ``is_pair`` says the cell belongs to the pair
    universe of an expected matrix; without one it is true for every cell of a task with any
    success.
    """
    keys = [*by, *CELL]
    cells = cell_table(rows, by=by)
    if expected is None:
        cells = cells.filter(F.col("score").isNotNull()).withColumn("wanted", F.lit(True))
    else:
        want = expected.select(*keys).distinct().withColumn("wanted", F.lit(True))
        cells = want.join(cells, keys, "full_outer").withColumn(
            "wanted", F.coalesce("wanted", F.lit(False))
        )
    task = W.partitionBy(*by, "pack_id", "task_id")
    base = F.col("mode") == baseline_mode
    out = cells.withColumn(
        "baseline_score", F.max(F.when(base, F.col("score"))).over(task)
    ).withColumn("base_wanted", F.coalesce(F.max(base & F.col("wanted")).over(task), F.lit(False)))
    is_pair = F.col("wanted") if expected is None else F.col("wanted") & F.col("base_wanted")
    return out.select(
        *keys,
        "baseline_score",
        F.col("score").alias("mode_score"),
        (F.col("score") - F.col("baseline_score")).alias("delta"),
        is_pair.alias("is_pair"),
    )


def _pair_statistics(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and delta statistics per mode of ``paired_cells``."""
    kept = F.when(F.col("is_pair"), F.col("delta"))
    return pairs.groupBy(*by, "mode").agg(
        count_where(F.col("mode_score").isNotNull()).alias("n_scored"),
        count_where(F.col("is_pair")).alias("n_pair_cells"),
        F.count(kept).alias("pairs"),
        F.avg(kept).alias("mean_delta"),
        F.min(kept).alias("min_delta"),
        F.max(kept).alias("max_delta"),
        count_where(kept > 0).alias("wins"),
        count_where(kept < 0).alias("losses"),
        count_where(kept == 0).alias("ties"),
        F.avg(F.when(kept < 0, F.abs(kept))).alias("mean_loss_magnitude"),
    )


def _deltas(per_mode: DataFrame, baseline_mode: str, by: Sequence[str]) -> DataFrame:
    """The columns of ``paired_deltas`` for all modes but the baseline."""
    return per_mode.filter(F.col("mode") != baseline_mode).select(
        *by,
        "mode",
        F.lit(baseline_mode).alias("baseline_mode"),
        "expected_pairs",
        "pairs",
        (F.col("expected_pairs") - F.col("pairs")).alias("missing_pairs"),
        "mean_delta",
        "min_delta",
        "max_delta",
        "wins",
        "losses",
        "ties",
        "mean_loss_magnitude",
    )


def paired_deltas(
    rows: DataFrame,
    *,
    baseline_mode: str,
    expected: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """F6 per mode: pair counts, delta statistics, wins, losses, ties."""
    pairs = paired_cells(rows, baseline_mode=baseline_mode, expected=expected, by=by)
    per_mode = _pair_statistics(pairs, by)
    if expected is None:
        # Every task with any success is a pair task of every mode: one small row per `by` group.
        universe = (
            pairs.groupBy(*by, "pack_id", "task_id").agg(F.lit(1).alias("one"))
            .groupBy(*by).agg(F.count("*").alias("expected_pairs"))
        )
        if by:
            per_mode = per_mode.join(universe, list(by), "left")
        else:
            per_mode = per_mode.withColumn("expected_pairs", F.coalesce(universe.scalar(), F.lit(0)))
    else:
        modes = expected.select(*by, "mode").distinct().withColumn("in_matrix", F.lit(True))
        per_mode = per_mode.join(modes, [*by, "mode"], "left").filter(
            (F.col("n_scored") > 0) | F.col("in_matrix")
        ).withColumn("expected_pairs", F.col("n_pair_cells"))
    return _deltas(per_mode, baseline_mode, by)


def missing_pairs(
    rows: DataFrame, *, baseline_mode: str, expected: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """pairs that lack a score on either side, with both sides' statuses.

    With an expected matrix its pairs are looked at; without one, every task that has any score is a
    pair task of every mode that has any.
    """
    keys = [*by, "pack_id", "task_id"]
    pairs = paired_cells(rows, baseline_mode=baseline_mode, expected=expected, by=by)
    other = F.col("mode") != baseline_mode
    if expected is not None:
        gaps = pairs.filter(F.col("is_pair") & other & F.col("delta").isNull()).select(*keys, "mode")
    else:
        scored = F.col("mode_score").isNotNull()
        modes = F.array_sort(F.collect_set(F.when(other, F.col("mode")))).alias("modes")
        tasks = pairs.filter(scored).select(*keys).distinct()
        found = pairs.filter(scored).groupBy(*by).agg(modes)  # one row per group of ``by``
        spread = tasks.join(found, list(by)) if by else tasks.withColumn("modes", found.scalar())
        whole = pairs.filter(F.col("delta").isNotNull()).select(*keys, "mode")
        gaps = spread.select(*keys, F.explode("modes").alias("mode")).join(whole, [*keys, "mode"], "left_anti")
    states = cell_statuses(rows, by=by)
    base = states.filter(F.col("mode") == baseline_mode).select(
        *keys, F.col("statuses").alias("baseline_statuses")
    )
    own = states.withColumnRenamed("statuses", "mode_statuses")
    return (
        gaps.join(own, [*keys, "mode"], "left")
        .join(base, keys, "left")
        .select(
            *keys,
            "mode",
            F.coalesce("baseline_statuses", F.lit("missing")).alias("baseline_statuses"),
            F.coalesce("mode_statuses", F.lit("missing")).alias("mode_statuses"),
        )
    )


def negative_examples(
    rows: DataFrame, *, baseline_mode: str, expected: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """the losing pairs themselves."""
    pairs = paired_cells(rows, baseline_mode=baseline_mode, expected=expected, by=by)
    return pairs.filter(
        F.col("is_pair") & (F.col("mode") != baseline_mode) & (F.col("delta") < 0)
    ).drop("is_pair")


# -- F8 ---------------------------------------------------------------------------------------


def negative_transfer(deltas: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """F8 from ``paired_deltas``: loss rates over paired and over expected pairs."""
    wanted = F.when(F.col("expected_pairs") == 0, F.col("pairs")).otherwise(F.col("expected_pairs"))
    return deltas.select(
        *by,
        "mode",
        "baseline_mode",
        wanted.alias("expected_pair_count"),
        F.col("pairs").alias("paired_count"),
        F.col("missing_pairs").alias("missing_pair_count"),
        ratio("missing_pairs", wanted).alias("missing_pair_rate"),
        ratio("pairs", wanted).alias("paired_success_rate"),
        F.col("losses").alias("negative_count"),
        ratio("losses", "pairs").alias("rate_on_pairs"),
        ratio("losses", wanted).alias("rate_on_expected"),
        F.col("mean_loss_magnitude").alias("mean_loss_magnitude"),
    )


# -- F9, F12 ----------------------------------------------------------------------------------


def duplicate_cells(rows: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """fully keyed cells that occur more than once in a group (a violation table)."""
    keyed = rows.select(*by, *[id_part(c).alias(c) for c in CELL]).filter(
        (F.col("pack_id") != "") & (F.col("task_id") != "") & (F.col("mode") != "")
    )
    return keyed.groupBy(*by, *CELL).agg(F.count("*").alias("n")).filter("n > 1")


_BLOCKS = 1024


def numeric_summary(values: DataFrame, value: str, *, by: Sequence[str]) -> DataFrame:
    """count, mean, min, exact interpolated median, max per group; nulls are left out.

    Spark's exact ``percentile`` keeps all distinct values of a group in one task. Here rows become counts
    per distinct value, which is the only time they are read. A sketch of a group's distinct values cuts
    them into 1,024 blocks of like size; only the blocks that hold the middle ranks are put in order.
    The sketch only chooses where to cut, so the result is exact.
    """
    by = list(by)
    v, c = F.col("__v"), F.col("__c")
    # Every use below reads the same columns and filters nothing, so that Spark shuffles the rows once.
    counted = values.select(*by, F.col(value).cast("double").alias("__v")).groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    counted = counted.withColumn("__c", F.when(v.isNotNull(), F.col("__n")).otherwise(F.lit(0))).drop("__n")
    stats = counted.groupBy(*by).agg(
        F.sum("__c").alias("n"), F.try_divide(F.sum(v * c), F.sum(c).cast("double")).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.percentile_approx(v, [i / _BLOCKS for i in range(1, _BLOCKS)], 10_000).alias("__cuts"),
    )

    def beside(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        """``rows`` with the columns of ``small``, one row a key; null keys count as equal."""
        other = small.withColumnsRenamed({k: f"__of_{k}" for k in keys})
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys], F.lit(True))
        return rows.join(other, same, how).drop(*[f"__of_{k}" for k in keys])

    # The block of a value is the number of cuts below it, found by halving.
    halves = F.array(*[F.lit(_BLOCKS >> i) for i in range(1, _BLOCKS.bit_length())])
    block = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get("__cuts", at + step - 1) < v, at + step).otherwise(at))
    placed = beside(counted, stats.select(*by, "n", "__cuts"), by).withColumn("__block", block).drop("__cuts")
    earlier = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    total = placed.groupBy(*by, "n", "__block").agg(F.sum("__c").alias("__c"))
    total = total.withColumn("__before", F.coalesce(F.sum("__c").over(earlier(*by).orderBy("__block")), F.lit(0)))
    lower, upper = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    holds = lambda k: (F.col("__before") <= k) & (k < F.col("__before") + c)
    target = total.filter(holds(lower) | holds(upper)).select(*by, "__block", "__before")
    ranked = beside(placed, target, [*by, "__block"]).withColumn(
        "__before", F.col("__before") + F.coalesce(F.sum("__c").over(earlier(*by, "__block").orderBy("__v")), F.lit(0))
    )
    medians = ranked.groupBy(*by).agg(
        ((F.max(F.when(holds(lower), v)) + F.max(F.when(holds(upper), v))) / 2).alias("p50")
    )
    return beside(stats, medians, by, "left").select(*by, "n", "mean", "min", "p50", "max")


def expected_for_groups(expected: DataFrame, groups: DataFrame, sources: Sequence[str]) -> DataFrame:
    """the expected matrix of each report group, by the group's inferred source.

    ``expected`` carries ``source``; ``groups`` has group columns and ``source``. A group without
    a source takes the packs of all ``sources``. An equi-join on ``source``.
    """
    own = F.when(F.col("source").isNull(), lit_list(list(sources))).otherwise(F.array("source"))
    wide = groups.withColumn("source", F.explode(own))
    return wide.join(expected, "source").drop("source").distinct()


GROUP = ["score_bucket", "evaluator_kind", "judge_model"]


def score_rollup(rows: DataFrame) -> DataFrame:
    """rows, successes and scores per mode at three levels, from one shuffle.

    ``rows`` carry ``path`` and the ``GROUP`` columns. ``level`` is ``file`` (path), ``evaluator`` (path and
    evaluator) or ``group`` (bucket, evaluator and judge over all files); columns that a level leaves
    out are null. Partial counts per finest key come first, so no level sees the rows again.
    """
    finest = ["path", *GROUP, "mode"]
    good = F.coalesce(F.col("status") == SUCCESS, F.lit(False))
    score = F.when(good & is_finite("overall_score"), F.col("overall_score"))
    base = normalise_cells(rows).groupBy(*finest).agg(
        F.count("*").alias("rows"), count_where(good).alias("successes"), F.count(score).alias("scored"), F.sum(score).alias("total")
    )
    levels = {"file": ["path", "mode"], "evaluator": ["path", "evaluator_kind", "mode"], "group": [*GROUP, "mode"]}
    out = base.groupingSets([[F.col(c) for c in cols] for cols in levels.values()], *[F.col(c) for c in finest]).agg(
        *[F.sum(c).alias(c) for c in ("rows", "successes", "scored", "total")],
        F.grouping("path").alias("no_path"), F.grouping("evaluator_kind").alias("no_kind"),
    )
    level = F.when(F.col("no_path") == 1, "group").when(F.col("no_kind") == 1, "file").otherwise("evaluator")
    return out.select(level.alias("level"), *finest, "rows", "successes", "scored", F.try_divide("total", "scored").alias("mean_score"))


@dataclass(frozen=True)
class GroupMatrix:
    """the expected matrix of every report group, by reference: groups do not repeat its cells.

    ``cells`` carry ``source`` and the cell columns; ``groups`` the ``GROUP`` columns and ``source``, null
    where a group takes the cells of all ``sources``.
    """

    cells: DataFrame
    groups: DataFrame
    sources: Sequence[str]

    def rows(self) -> DataFrame:
        """The matrix of each group, written out."""
        return expected_for_groups(self.cells, self.groups, self.sources)


def grouped_paired_deltas(rows: DataFrame, matrix: GroupMatrix, *, baseline_mode: str) -> DataFrame:
    """``paired_deltas`` per group against its matrix, without a row per group and expected cell.

    A cell of the matrix carries the list of its sources. Cells that were seen look theirs up; the number
    of expected pairs comes from counts of cells per mode and lists of sources, which are few.
    """
    task = ["pack_id", "task_id"]
    own = F.when(F.col("source").isNull(), lit_list(list(matrix.sources))).otherwise(F.array("source"))
    groups = matrix.groups.select(*[label(c).alias(c) for c in GROUP], F.explode(own).alias("source"))
    groups = groups.groupBy(*GROUP).agg(F.collect_set("source").alias("own"))
    want = matrix.cells.groupBy(*CELL).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    base = F.col("mode") == baseline_mode
    base_sources = lambda *keys: F.max(F.when(base, F.col("sources"))).over(W.partitionBy(*keys, *task))

    counts = want.withColumn("base_sources", base_sources()).groupBy("mode", "sources", "base_sources").agg(F.count("*").alias("n"))
    met = groups.withColumn("source", F.explode("own")).join(counts.withColumn("source", F.explode("sources")), "source").drop("source").distinct()
    both = F.coalesce(F.arrays_overlap("own", "base_sources"), F.lit(False))
    per_group = met.groupBy(*GROUP, "mode").agg(F.sum(F.when(both, F.col("n")).otherwise(0)).alias("expected_pairs"))

    # A pair has a delta only where its baseline was seen, so the baseline's sources stand beside it.
    cells = cell_table(rows, by=GROUP).join(want, CELL, "left")
    cells = cells.withColumns({
        "baseline_score": F.max(F.when(base, F.col("score"))).over(W.partitionBy(*GROUP, *task)), "base_sources": base_sources(*GROUP),
    }).join(groups, GROUP, "left")
    is_pair = F.arrays_overlap("own", "sources") & F.arrays_overlap("own", "base_sources")
    pairs = cells.select(
        *GROUP, "mode", F.col("score").alias("mode_score"), (F.col("score") - F.col("baseline_score")).alias("delta"),
        F.coalesce(is_pair, F.lit(False)).alias("is_pair"),
    )
    per_mode = _pair_statistics(pairs, GROUP).join(per_group, [*GROUP, "mode"], "full_outer")
    seen = per_mode.filter((F.col("n_scored") > 0) | F.col("expected_pairs").isNotNull())
    return _deltas(seen.na.fill(0, ["expected_pairs", "pairs", "wins", "losses", "ties"]), baseline_mode, GROUP)


def group_report(rows: DataFrame, *, baseline_mode: str, expected: DataFrame | GroupMatrix | None = None) -> dict[str, DataFrame]:
    """reports over groups of (bucket, evaluator, judge) that span result files.

    ``rows`` carry ``path`` and the ``GROUP`` columns; ``expected`` carries these and the cells, the
    matrix of each group (``expected_for_groups``), or is a ``GroupMatrix``. ``groups`` has one row per group with its files
    and rows; ``duplicates`` are cells that a group holds more than once, which forbid its report
    (hand them to ``fail_if_any``).
    """
    rows = rows.withColumns({c: label(c) for c in GROUP})
    if isinstance(expected, GroupMatrix):
        deltas = grouped_paired_deltas(rows, expected, baseline_mode=baseline_mode)
        expected = expected.rows()
    else:
        deltas = paired_deltas(rows, baseline_mode=baseline_mode, expected=expected, by=GROUP)
    out = {
        # Counted per file first: the list holds file names, not rows.
        "groups": rows.groupBy(*GROUP, "path").agg(F.count("*").alias("n")).groupBy(*GROUP).agg(
            F.array_sort(F.collect_list("path")).alias("paths"), F.sum("n").alias("row_count")
        ),
        "duplicates": duplicate_cells(rows, by=GROUP),
        "mode_scores": mode_scores(rows, by=GROUP),
        "paired_deltas": deltas,
        "negative_transfer": negative_transfer(deltas, by=GROUP),
    }
    if expected is not None:
        out["coverage"] = coverage_summary(coverage_cells(rows, expected, by=GROUP), by=GROUP)
    return out


def score_summary(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """per mode, coverage of the expected matrix, and count and mean of finite success scores."""
    covered = coverage_summary(coverage_cells(rows, expected), by=["mode"])
    return covered.join(mode_scores(rows), "mode", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def file_report(rows: DataFrame, *, baseline_mode: str, expected: DataFrame | None = None) -> dict[str, DataFrame]:
    """the reports of F5-F8 per file and evaluator, and of F13 per file, as one table each.

    ``rows`` carry ``path``, and for the token report the usage columns of F13; ``expected`` carries ``path, evaluator_kind`` and the cell columns.
    """
    by = ["path", "evaluator_kind"]
    rows = rows.withColumn("evaluator_kind", label("evaluator_kind"))
    deltas = paired_deltas(rows, baseline_mode=baseline_mode, expected=expected, by=by)
    out = {
        "status_counts": status_counts(rows, by=["path"]),
        "mode_scores": mode_scores(rows, by=by),
        "paired_deltas": deltas,
        "negative_transfer": negative_transfer(deltas, by=by),
    }
    if expected is not None:
        per_file = expected.select("path", *CELL).distinct()
        cells = coverage_cells(rows, per_file, require_finite=False, by=["path"])
        out["coverage"] = coverage_summary(cells, by=["path"])
    if "judge_call_usages" in rows.columns:
        out["tokens"] = token_usage(rows, by=["path"])
    return out
