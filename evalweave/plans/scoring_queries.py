"""Registered queries of the scoring family, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.operators import scoring as S
from evalweave.plans import bindings as B
from evalweave.plans.oracle_tables import with_tables
from evalweave.plans.shape import tidy

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def _expected(spark, sf):
    return S.expected_cells(B.heldout(spark, sf), B.MODES)


@query("F1_expected_cells", with_tables("expected", "SELECT pack_id, task_id, mode FROM expected WHERE task_id < '2'"))
def _(spark, sf):
    return S.expected_cells(B.heldout(spark, sf), B.MODES, limit_heldout=2)


@query("F2_row_status", """
    WITH r AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
    s AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'length' ELSE 'stop' END AS g,
        CASE WHEN k % 11 = 0 THEN 'safety' WHEN k % 11 = 1 THEN 'length' ELSE 'stop' END AS j,
        CASE WHEN k % 13 = 0 THEN 'bad' END AS e, CASE WHEN k % 17 <> 0 THEN value / 10 END AS score FROM r)
    SELECT event_id,
      CASE WHEN g <> 'stop' THEN 'generation_incomplete' WHEN j = 'safety' THEN 'judge_refusal'
        WHEN j <> 'stop' THEN 'judge_incomplete' WHEN e IS NOT NULL OR score IS NULL THEN 'judge_parse_error'
        WHEN score < 1 OR score > 10 THEN 'judge_invalid_score' ELSE 'success' END AS score_status,
      CASE WHEN j = 'safety' THEN 'judge_refusal' WHEN j <> 'stop' THEN 'judge_incomplete'
        WHEN e IS NOT NULL OR score IS NULL THEN 'judge_parse_error'
        WHEN score < 1 OR score > 10 THEN 'judge_invalid_score' ELSE 'success' END AS audit_status,
      CASE WHEN j <> 'stop' THEN 'judge_incomplete' WHEN e IS NOT NULL THEN 'judge_parse_error'
        ELSE 'success' END AS report_status
    FROM s""")
def _(spark, sf):
    r = B.table(spark, sf, "events").select("event_id", "value", B._k().alias("k"))
    k = F.col("k")
    g = F.when(k % 7 == 0, "length").otherwise("stop")
    j = F.when(k % 11 == 0, "safety").when(k % 11 == 1, "length").otherwise("stop")
    e = F.when(k % 13 == 0, "bad")
    s = F.when(k % 17 != 0, F.col("value") / 10)
    return r.select(
        "event_id",
        S.score_row_status(g, j, e, s).alias("score_status"),
        S.audit_row_status(j, e, s).alias("audit_status"),
        S.report_row_status(j, e).alias("report_status"),
    )


def _calls(spark, sf):
    """Criterion calls: one per event, its place in the cell given by the event id."""
    e = B.eval_row(spark, sf)
    k = F.col("k")
    return e.select(
        "pack_id", "task_id", "mode", F.col("seq").alias("pos"),
        F.when(k == 3, "safety").when(k == 4, "length").otherwise("stop").alias("finish_reason"),
        F.when(k == 5, "bad json").alias("parse_error"),
        F.when(k % 9 != 0, k % 10 + 1).alias("score"),
    )


@query("F4_cell_scores", with_tables("eval_row", """,
    c AS (SELECT pack_id, task_id, mode, seq AS pos, CASE WHEN k = 3 THEN 'judge_refusal'
        WHEN k = 4 THEN 'judge_incomplete' WHEN k = 5 THEN 'judge_parse_error' ELSE 'success' END AS st,
        CASE WHEN k % 9 <> 0 THEN k % 10 + 1 END AS score FROM eval_row)
    SELECT pack_id, task_id, mode,
      coalesce(arg_min(st, pos) FILTER (st <> 'success'), 'success') AS status,
      CASE WHEN bool_and(st = 'success') THEN round(avg(score), 6) END AS overall_score,
      min(pos) FILTER (st <> 'success') AS first_bad_pos, count(*) AS n_calls
    FROM c GROUP BY ALL"""))
def _(spark, sf):
    return tidy(S.cell_scores_from_calls(_calls(spark, sf)))


@query("F5_status_counts", with_tables("eval_row", """
    SELECT grouping(mode) = 1 AS all_modes, mode, status, count(*) AS n
    FROM eval_row GROUP BY GROUPING SETS ((mode, status), (status))"""))
def _(spark, sf):
    return tidy(S.status_counts(B.eval_row(spark, sf)))


@query("F5_mode_scores", with_tables("eval_row", """
    SELECT mode, count(*) AS n, round(avg(overall_score), 6) AS mean_score
    FROM eval_row WHERE status = 'success' GROUP BY mode"""))
def _(spark, sf):
    return tidy(S.mode_scores(B.eval_row(spark, sf)))


_PAIR_COLS = """
      count(delta) AS pairs, {exp} - count(delta) AS missing_pairs, round(avg(delta), 6) AS mean_delta,
      round(min(delta), 6) AS min_delta, round(max(delta), 6) AS max_delta,
      count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses,
      count(*) FILTER (delta = 0) AS ties, round(avg(-delta) FILTER (delta < 0), 6) AS mean_loss_magnitude"""


@query("F6_paired_deltas", with_tables("cells expected", """,
    d AS (SELECT e.mode, c.score - b.score AS delta FROM expected e
        LEFT JOIN cells c ON (c.pack_id, c.task_id, c.mode) = (e.pack_id, e.task_id, e.mode)
        LEFT JOIN cells b ON b.pack_id = e.pack_id AND b.task_id = e.task_id AND b.mode = 'prompt_only'
        WHERE e.mode <> 'prompt_only')
    SELECT mode, 'prompt_only' AS baseline_mode, count(*) AS expected_pairs,""" + _PAIR_COLS.format(exp="count(*)") + """
    FROM d GROUP BY mode
    UNION ALL
    SELECT DISTINCT mode, 'prompt_only', 0, 0, 0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
      CAST(NULL AS DOUBLE), 0, 0, 0, CAST(NULL AS DOUBLE)
    FROM cells WHERE score IS NOT NULL AND mode NOT IN (SELECT mode FROM expected)"""))
def _(spark, sf):
    return tidy(S.paired_deltas(B.eval_row(spark, sf), baseline_mode=B.BASELINE, expected=_expected(spark, sf)))


@query("F6_paired_deltas_observed", with_tables("cells", """,
    ok AS (SELECT * FROM cells WHERE score IS NOT NULL),
    u AS (SELECT count(*) AS n FROM (SELECT DISTINCT pack_id, task_id FROM ok)),
    d AS (SELECT c.mode, c.score - b.score AS delta FROM ok c
        LEFT JOIN ok b ON b.pack_id = c.pack_id AND b.task_id = c.task_id AND b.mode = 'prompt_only'
        WHERE c.mode <> 'prompt_only')
    SELECT mode, 'prompt_only' AS baseline_mode, any_value(u.n) AS expected_pairs,""" + _PAIR_COLS.format(exp="any_value(u.n)") + """
    FROM d, u GROUP BY mode"""))
def _(spark, sf):
    return tidy(S.paired_deltas(B.eval_row(spark, sf), baseline_mode=B.BASELINE))


@query("F6_missing_pairs", with_tables("cells expected", """,
    st AS (SELECT pack_id, task_id, mode, string_agg(s || ':' || n, ',' ORDER BY s || ':' || n) AS statuses FROM
        (SELECT pack_id, task_id, mode, status AS s, count(*) AS n FROM eval_row GROUP BY ALL) GROUP BY ALL)
    SELECT e.pack_id, e.task_id, e.mode, coalesce(bs.statuses, 'missing') AS baseline_statuses,
      coalesce(ms.statuses, 'missing') AS mode_statuses
    FROM expected e
      LEFT JOIN cells c ON (c.pack_id, c.task_id, c.mode) = (e.pack_id, e.task_id, e.mode)
      LEFT JOIN cells b ON b.pack_id = e.pack_id AND b.task_id = e.task_id AND b.mode = 'prompt_only'
      LEFT JOIN st ms ON (ms.pack_id, ms.task_id, ms.mode) = (e.pack_id, e.task_id, e.mode)
      LEFT JOIN st bs ON bs.pack_id = e.pack_id AND bs.task_id = e.task_id AND bs.mode = 'prompt_only'
    WHERE e.mode <> 'prompt_only' AND (c.score IS NULL OR b.score IS NULL)"""))
def _(spark, sf):
    return S.missing_pairs(B.eval_row(spark, sf), baseline_mode=B.BASELINE, expected=_expected(spark, sf))


@query("F6_missing_pairs_observed", with_tables("cells", """,
    ok AS (SELECT * FROM cells WHERE score IS NOT NULL),
    st AS (SELECT pack_id, task_id, mode, string_agg(s || ':' || n, ',' ORDER BY s || ':' || n) AS statuses FROM
        (SELECT pack_id, task_id, mode, status AS s, count(*) AS n FROM eval_row GROUP BY ALL) GROUP BY ALL)
    SELECT t.pack_id, t.task_id, m.mode, coalesce(bs.statuses, 'missing') AS baseline_statuses,
      coalesce(ms.statuses, 'missing') AS mode_statuses
    FROM (SELECT DISTINCT pack_id, task_id FROM ok) t CROSS JOIN (SELECT DISTINCT mode FROM ok WHERE mode <> 'prompt_only') m
      LEFT JOIN ok c ON (c.pack_id, c.task_id, c.mode) = (t.pack_id, t.task_id, m.mode)
      LEFT JOIN ok b ON b.pack_id = t.pack_id AND b.task_id = t.task_id AND b.mode = 'prompt_only'
      LEFT JOIN st ms ON (ms.pack_id, ms.task_id, ms.mode) = (t.pack_id, t.task_id, m.mode)
      LEFT JOIN st bs ON bs.pack_id = t.pack_id AND bs.task_id = t.task_id AND bs.mode = 'prompt_only'
    WHERE c.score IS NULL OR b.score IS NULL"""))
def _(spark, sf):
    return S.missing_pairs(B.eval_row(spark, sf), baseline_mode=B.BASELINE)


@query("F6_negative_examples", with_tables("cells", """
    SELECT c.pack_id, c.task_id, c.mode, round(b.score, 6) AS baseline_score, round(c.score, 6) AS mode_score,
      round(c.score - b.score, 6) AS delta
    FROM cells c JOIN cells b ON b.pack_id = c.pack_id AND b.task_id = c.task_id AND b.mode = 'prompt_only'
    WHERE c.mode <> 'prompt_only' AND c.score < b.score"""))
def _(spark, sf):
    return tidy(S.negative_examples(B.eval_row(spark, sf), baseline_mode=B.BASELINE))


_COVERAGE = """,
    seen AS (SELECT pack_id, task_id, mode, {good} AS good FROM cells),
    st AS (SELECT coalesce(e.pack_id, s.pack_id) AS pack_id, coalesce(e.task_id, s.task_id) AS task_id,
        coalesce(e.mode, s.mode) AS mode,
        CASE WHEN e.mode IS NULL THEN 'unexpected' WHEN s.mode IS NULL THEN 'missing'
          WHEN NOT s.good THEN 'non_success' ELSE 'ok' END AS state
      FROM expected e FULL JOIN seen s ON (s.pack_id, s.task_id, s.mode) = (e.pack_id, e.task_id, e.mode))"""


@query("F7_coverage_cells", with_tables("cells expected", _COVERAGE.format(good="score IS NOT NULL") + " SELECT * FROM st"))
def _(spark, sf):
    return S.coverage_cells(B.eval_row(spark, sf), _expected(spark, sf))


@query("F7_coverage_summary", with_tables("cells expected", _COVERAGE.format(good="has_success") + """
    SELECT count(*) FILTER (state <> 'unexpected') AS expected_cells,
      count(*) FILTER (state IN ('ok', 'non_success')) AS observed_cells,
      count(*) FILTER (state = 'ok') AS successful_cells, count(*) FILTER (state = 'missing') AS missing_cells,
      count(*) FILTER (state = 'non_success') AS non_success_cells,
      count(*) FILTER (state = 'unexpected') AS unexpected_cells,
      count(*) FILTER (state IN ('missing', 'non_success')) = 0 AS complete
    FROM st"""))
def _(spark, sf):
    cells = S.coverage_cells(B.eval_row(spark, sf), _expected(spark, sf), require_finite=False)
    return tidy(S.coverage_summary(cells))


@query("F8_negative_transfer", with_tables("cells expected", """,
    d AS (SELECT e.mode, c.score - b.score AS delta FROM expected e
        LEFT JOIN cells c ON (c.pack_id, c.task_id, c.mode) = (e.pack_id, e.task_id, e.mode)
        LEFT JOIN cells b ON b.pack_id = e.pack_id AND b.task_id = e.task_id AND b.mode = 'prompt_only'
        WHERE e.mode <> 'prompt_only'),
    a AS (SELECT mode, count(*) AS e, count(delta) AS p, count(*) FILTER (delta < 0) AS l,
        avg(-delta) FILTER (delta < 0) AS m FROM d GROUP BY mode
      UNION ALL SELECT DISTINCT mode, 0, 0, 0, CAST(NULL AS DOUBLE) FROM cells
        WHERE score IS NOT NULL AND mode NOT IN (SELECT mode FROM expected))
    SELECT mode, 'prompt_only' AS baseline_mode, e AS expected_pair_count, p AS paired_count,
      e - p AS missing_pair_count, round((e - p) / nullif(e, 0), 6) AS missing_pair_rate,
      round(p / nullif(e, 0), 6) AS paired_success_rate, l AS negative_count,
      round(l / nullif(p, 0), 6) AS rate_on_pairs, round(l / nullif(e, 0), 6) AS rate_on_expected,
      round(m, 6) AS mean_loss_magnitude FROM a"""))
def negative_transfer_query(spark, sf):
    deltas = S.paired_deltas(B.eval_row(spark, sf), baseline_mode=B.BASELINE, expected=_expected(spark, sf))
    return tidy(S.negative_transfer(deltas))


@query("F9_duplicate_cells", with_tables("eval_row", """
    SELECT judge_model, pack_id, task_id, mode, count(*) AS n FROM eval_row
    GROUP BY ALL HAVING count(*) > 1"""))
def _(spark, sf):
    return S.duplicate_cells(B.eval_row(spark, sf), by=["judge_model"])


@query("F12_numeric_summary", with_tables("eval_row", """
    SELECT mode, count(overall_score) AS n, round(avg(overall_score), 6) AS mean,
      min(overall_score) AS min, round(quantile_cont(overall_score, 0.5), 6) AS p50, max(overall_score) AS max
    FROM eval_row GROUP BY mode"""))
def _(spark, sf):
    return tidy(S.numeric_summary(B.eval_row(spark, sf), "overall_score", by=["mode"]))
