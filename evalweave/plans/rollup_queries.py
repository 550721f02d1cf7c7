"""Registered queries: worklists, tokens, artifacts, disagreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.operators import artifacts as A
from evalweave.operators import disagreement as D
from evalweave.operators import scoring as S
from evalweave.operators import tokens as T
from evalweave.operators import worklists as L
from evalweave.plans import bindings as B
from evalweave.plans.oracle_tables import with_tables
from evalweave.plans.shape import tidy
from evalweave.plans.text_queries import SECTION_SQL, SKILL_MD_SQL, skill_md

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


# -- F3, F9, F10, F11 ---------------------------------------------------------------------------


@query("F3_criteria", """
    SELECT doc_id, CAST(p AS BIGINT) AS pos, g AS "group", CAST(i AS BIGINT) AS "index", r AS requirement FROM (
      SELECT doc_id, unnest([0, 1]) AS p, CAST(NULL AS VARCHAR) AS g, CAST(NULL AS INT) AS i, unnest(['"q' || quality || '"', '{"t":' || toxic || '}']) AS r
        FROM labels WHERE doc_id % 3 = 0
      UNION ALL SELECT doc_id, unnest([0, 1, 2]), unnest(['a', 'b', 'b']), unnest([1, 1, 2]), unnest(['"z"', '"x"', '"y' || toxic || '"'])
        FROM labels WHERE doc_id % 3 = 1)""")
def _(spark, sf):
    n, q, t = F.col("doc_id"), F.col("quality").cast("string"), F.col("toxic").cast("string")
    sup = (
        F.when(n % 3 == 0, F.concat(F.lit('{"items":["q'), q, F.lit('",{"t":'), t, F.lit('}],"checklists":{}}')))
        .when(n % 3 == 1, F.concat(F.lit('{"items":[],"checklists":{"b":["x","y'), t, F.lit('"],"a":["z"],"c":1}}')))
        .otherwise("{}")
    )
    p = B.table(spark, sf, "labels").select("doc_id", sup.alias("supervision"))
    return tidy(L.criteria(p, keys=["doc_id"]))


def filed_rows(spark, sf):
    """Evaluation rows spread over result files and evaluators."""
    n = F.col("seq")
    kinds = F.when(n % 2 == 0, "official").otherwise("surrogate")
    path = F.concat(F.lit("runs/f"), (n % 5).cast("string"), F.when(n % 5 == 3, "_pattern_similarity").otherwise(""), F.lit(".jsonl"))
    return B.eval_row(spark, sf).withColumn("path", path).withColumn(
        "evaluator_kind", F.when(n % 5 == 4, "judge").when(n % 5 == 0, "official").otherwise(kinds)
    ).withColumn("source", F.when(n % 5 < 3, F.concat(F.lit("s"), F.when(n % 5 == 2, n % 2).otherwise(n * 0).cast("string"))))


_FILED = """,
    fr AS (SELECT *, 'runs/f' || (seq % 5) || CASE WHEN seq % 5 = 3 THEN '_pattern_similarity' ELSE '' END || '.jsonl' AS path,
        CASE WHEN seq % 5 = 4 THEN 'judge' WHEN seq % 5 = 0 THEN 'official' WHEN seq % 2 = 0 THEN 'official' ELSE 'surrogate' END AS kind,
        CASE WHEN seq % 5 < 3 THEN 's' || CASE WHEN seq % 5 = 2 THEN seq % 2 ELSE 0 END END AS source FROM eval_row)"""


@query("F9_paired_by_judge", with_tables("eval_row", """,
    c AS (SELECT judge_model, pack_id, task_id, mode, arg_max(overall_score, seq) FILTER (status = 'success') AS score FROM eval_row GROUP BY ALL),
    ok AS (SELECT * FROM c WHERE score IS NOT NULL),
    u AS (SELECT judge_model, count(DISTINCT (pack_id, task_id)) AS n FROM ok GROUP BY 1),
    d AS (SELECT c.judge_model, c.mode, c.score - b.score AS delta FROM ok c LEFT JOIN ok b ON b.judge_model = c.judge_model
        AND b.pack_id = c.pack_id AND b.task_id = c.task_id AND b.mode = 'prompt_only' WHERE c.mode <> 'prompt_only')
    SELECT judge_model, mode, any_value(u.n) AS expected_pairs, count(delta) AS pairs, round(avg(delta), 6) AS mean_delta,
      count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses FROM d JOIN u USING (judge_model) GROUP BY ALL"""))
def _(spark, sf):
    out = S.paired_deltas(B.eval_row(spark, sf), baseline_mode=B.BASELINE, by=["judge_model"])
    return tidy(out.select("judge_model", "mode", "expected_pairs", "pairs", "mean_delta", "wins", "losses"))


@query("F10_file_buckets", with_tables("eval_row", _FILED + """
    SELECT path, CASE WHEN contains(t, 'pattern_similarity') THEN 'debug_scores' WHEN contains(t, 'surrogate') THEN 'surrogate_debug_scores'
      WHEN contains(t, 'official') THEN 'official_benchmark_scores' ELSE 'debug_scores' END AS score_bucket
    FROM (SELECT path, lower(path || ' ' || string_agg(DISTINCT kind, ' ')) AS t FROM fr GROUP BY path)"""))
def _(spark, sf):
    return L.file_buckets(filed_rows(spark, sf))


@query("F10_inferred_source", with_tables("eval_row", _FILED + """
    SELECT path, CASE WHEN count(DISTINCT source) = 1 THEN min(source) WHEN contains(path, 'pattern') THEN 'P'
      WHEN bool_or(kind = 'official' AND r <= 20) THEN 'O' END AS source
    FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) AS r FROM fr) GROUP BY path"""))
def _(spark, sf):
    return L.inferred_source(filed_rows(spark, sf), {"pattern": "P", "official": "O"})


@query("F10_row_models", with_tables("eval_row", """
    SELECT seq, CASE WHEN k % 4 = 0 THEN 'j' || judge_model WHEN k % 4 = 1 THEN 'nested' WHEN k % 4 = 2 THEN 'call' ELSE 'unknown' END AS judge,
      CASE WHEN k % 3 = 0 THEN 's' WHEN k % 3 = 1 THEN 'g' END AS solver,
      CASE mode WHEN 'click' THEN 'one_shot' WHEN 'signup' THEN 'feature' END AS skill_mode FROM eval_row"""))
def _(spark, sf):
    k = F.col("k")
    judge = L.row_judge_model(
        F.when(k % 4 == 0, F.concat(F.lit("j"), F.col("judge_model"))),
        F.when(k % 4 == 1, "nested").otherwise(""),
        F.when(k % 4 == 2, F.array(F.lit(""), F.lit("call"), F.lit("later"))).otherwise(F.array().cast("array<string>")),
    )
    solver = L.solver_model(F.when(k % 3 == 0, "s").otherwise(""), F.when(k % 3 == 1, "g"))
    return B.eval_row(spark, sf).select(
        "seq", judge.alias("judge"), solver.alias("solver"),
        L.mapped(F.col("mode"), {"click": "one_shot", "signup": "feature"}).alias("skill_mode"),
    )


@query("F11_file_report", with_tables("eval_row", _FILED + """,
    c AS (SELECT path, kind, pack_id, task_id, mode, arg_max(overall_score, seq) FILTER (status = 'success') AS score FROM fr GROUP BY ALL),
    ok AS (SELECT * FROM c WHERE score IS NOT NULL),
    u AS (SELECT path, kind, count(DISTINCT (pack_id, task_id)) AS n FROM ok GROUP BY 1, 2),
    d AS (SELECT c.path, c.kind, c.mode, c.score - b.score AS delta FROM ok c LEFT JOIN ok b ON b.path = c.path AND b.kind = c.kind
        AND b.pack_id = c.pack_id AND b.task_id = c.task_id AND b.mode = 'prompt_only' WHERE c.mode <> 'prompt_only')
    SELECT path, kind AS evaluator_kind, mode, any_value(u.n) AS expected_pair_count, count(delta) AS paired_count,
      count(*) FILTER (delta < 0) AS negative_count, round(count(*) FILTER (delta < 0) / nullif(count(delta), 0), 6) AS rate_on_pairs,
      round(avg(-delta) FILTER (delta < 0), 6) AS mean_loss_magnitude FROM d JOIN u USING (path, kind) GROUP BY path, kind, mode"""))
def _(spark, sf):
    report = S.file_report(filed_rows(spark, sf), baseline_mode=B.BASELINE)["negative_transfer"]
    return tidy(report.select(
        "path", "evaluator_kind", "mode", "expected_pair_count", "paired_count", "negative_count", "rate_on_pairs", "mean_loss_magnitude"
    ))


_BUCKETED = _FILED + """,
    bk AS (SELECT path, CASE WHEN contains(t, 'pattern_similarity') THEN 'debug_scores' WHEN contains(t, 'surrogate') THEN 'surrogate_debug_scores'
        WHEN contains(t, 'official') THEN 'official_benchmark_scores' ELSE 'debug_scores' END AS score_bucket
      FROM (SELECT path, lower(path || ' ' || string_agg(DISTINCT kind, ' ')) AS t FROM fr GROUP BY path)),
    g AS (SELECT * FROM fr JOIN bk USING (path))"""


def grouped_rows(spark, sf):
    rows = filed_rows(spark, sf).drop("source")
    return rows.join(L.file_buckets(rows), "path")


def group_expected(spark, sf, rows):
    """The matrix of each group: judge 0 saw the packs of one source, the others those of both."""
    source = F.concat(F.lit("s"), (F.col("pack_id").cast("int") % 2).cast("string"))
    groups = rows.select(*S.GROUP, F.when(F.col("judge_model") == "0", "s0").alias("source")).distinct()
    return S.GroupMatrix(_expected(spark, sf).withColumn("source", source), groups, ["s0", "s1"])


@query("F9_group_report", with_tables("expected eval_row", _BUCKETED + """,
    k AS (SELECT score_bucket, kind, judge_model, count(DISTINCT path) AS n_paths, count(*) AS row_count FROM g GROUP BY ALL),
    ex AS (SELECT k.*, e.* FROM k JOIN expected e ON k.judge_model <> '0' OR CAST(e.pack_id AS INT) % 2 = 0),
    c AS (SELECT score_bucket, kind, judge_model, pack_id, task_id, mode, arg_max(overall_score, seq) FILTER (status = 'success') AS score FROM g GROUP BY ALL),
    d AS (SELECT ex.*, c.score - b.score AS delta FROM ex LEFT JOIN c USING (score_bucket, kind, judge_model, pack_id, task_id, mode)
        LEFT JOIN c b ON b.score_bucket = ex.score_bucket AND b.kind = ex.kind AND b.judge_model = ex.judge_model
          AND b.pack_id = ex.pack_id AND b.task_id = ex.task_id AND b.mode = 'prompt_only' WHERE ex.mode <> 'prompt_only')
    SELECT score_bucket, kind AS evaluator_kind, judge_model, mode, any_value(n_paths) AS n_paths, any_value(row_count) AS row_count,
      count(*) AS expected_pairs, count(delta) AS pairs, count(*) - count(delta) AS missing_pairs, round(avg(delta), 6) AS mean_delta,
      count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses FROM d GROUP BY score_bucket, kind, judge_model, mode"""))
def _(spark, sf):
    rows = grouped_rows(spark, sf)
    report = S.group_report(rows, baseline_mode=B.BASELINE, expected=group_expected(spark, sf, rows))
    out = report["paired_deltas"].filter("expected_pairs > 0").join(report["groups"], S.GROUP)
    return tidy(out.select(
        *S.GROUP, "mode", F.size("paths").cast("bigint").alias("n_paths"), "row_count", "expected_pairs", "pairs", "missing_pairs", "mean_delta", "wins", "losses"
    ))


@query("F9_group_duplicates", with_tables("eval_row", _BUCKETED + """
    SELECT score_bucket, kind AS evaluator_kind, judge_model, pack_id, task_id, mode, count(*) AS n FROM g GROUP BY ALL HAVING count(*) > 1"""))
def _(spark, sf):
    return S.group_report(grouped_rows(spark, sf), baseline_mode=B.BASELINE)["duplicates"]


@query("F11_score_rollup", with_tables("eval_row", _BUCKETED + """
    SELECT CASE WHEN grouping(path) = 1 THEN 'group' WHEN grouping(kind) = 1 THEN 'file' ELSE 'evaluator' END AS level,
      path, score_bucket, kind AS evaluator_kind, judge_model, mode, count(*) AS rows, count(*) FILTER (status = 'success') AS successes,
      count(overall_score) FILTER (status = 'success') AS scored, round(avg(overall_score) FILTER (status = 'success'), 6) AS mean_score
    FROM g GROUP BY GROUPING SETS ((path, mode), (path, kind, mode), (score_bucket, kind, judge_model, mode))"""))
def _(spark, sf):
    return tidy(S.score_rollup(grouped_rows(spark, sf)))


@query("F11_coverage", with_tables("expected eval_row", _FILED + """,
    ex AS (SELECT DISTINCT p.path, e.pack_id, e.task_id, e.mode FROM (SELECT DISTINCT path, pack_id FROM fr) p JOIN expected e USING (pack_id)),
    seen AS (SELECT path, pack_id, task_id, mode, bool_or(status = 'success') AS good FROM fr GROUP BY ALL),
    s AS (SELECT coalesce(ex.path, seen.path) AS path, CASE WHEN ex.path IS NULL THEN 'unexpected' WHEN seen.path IS NULL THEN 'missing'
        WHEN NOT good THEN 'non_success' ELSE 'ok' END AS state FROM ex FULL JOIN seen USING (path, pack_id, task_id, mode))
    SELECT path, count(*) FILTER (state <> 'unexpected') AS expected_cells, count(*) FILTER (state IN ('ok', 'non_success')) AS observed_cells,
      count(*) FILTER (state = 'ok') AS successful_cells, count(*) FILTER (state = 'missing') AS missing_cells,
      count(*) FILTER (state = 'non_success') AS non_success_cells, count(*) FILTER (state = 'unexpected') AS unexpected_cells,
      count(*) FILTER (state IN ('missing', 'non_success')) = 0 AS complete FROM s GROUP BY path"""))
def _(spark, sf):
    rows = filed_rows(spark, sf).drop("source")
    expected = rows.select("path", "evaluator_kind", "pack_id").distinct().join(_expected(spark, sf), "pack_id")
    return S.file_report(rows, baseline_mode=B.BASELINE, expected=expected)["coverage"]


# -- F13, F14 -----------------------------------------------------------------------------------

_USAGE = "struct<prompt_tokens:bigint,input_tokens:bigint,completion_tokens:bigint,output_tokens:bigint,total_tokens:bigint>"


def _usage(p=None, i=None, c=None, o=None, t=None):
    names = ["prompt_tokens", "input_tokens", "completion_tokens", "output_tokens", "total_tokens"]
    return F.struct(*[(F.lit(None) if v is None else v).cast("bigint").alias(n) for n, v in zip(names, (p, i, c, o, t), strict=True)])


def usage_rows(spark, sf):
    """Each conversation turn as an evaluation row; its role says which call used tokens."""
    c = B.table(spark, sf, "conversations")
    tok = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("bigint")
    none = F.lit(None).cast(_USAGE)
    role = F.col("role")
    return c.select(
        F.concat(F.lit("m"), (F.col("conv_id") % 5).cast("string")).alias("mode"),
        F.when(F.col("turn") % 3 == 0, "model_error").otherwise("success").alias("status"),
        F.when(role == "system", _usage(p=tok, c=F.lit(2))).otherwise(none).alias("layout_plan_usage"),
        F.when(role == "assistant", _usage(i=tok, o=F.lit(3), t=tok * 2)).otherwise(none).alias("generation_usage"),
        F.when((role == "user") & (F.col("turn") == 0), _usage(p=tok)).otherwise(none).alias("judge_usage"),
        F.when(role == "user", F.array(_usage(p=tok), _usage(c=F.lit(1), t=F.lit(7)))).otherwise(F.array().cast(f"array<{_USAGE}>")).alias("judge_call_usages"),
        role.alias("stage"), tok.alias("tok"), "conv_id", "turn",
    )


_USAGE_SQL = """
    WITH r AS (SELECT 'm' || (conv_id % 5) AS mode, turn % 3 <> 0 AS ok, role, turn, greatest(1, length(text) // 4) AS tok FROM conversations),
    l AS (SELECT mode, 'layout_plan' AS bucket, tok AS i, 2 AS o, tok + 2 AS t FROM r WHERE role = 'system'
      UNION ALL SELECT mode, 'generation', tok, 3, tok * 2 FROM r WHERE role = 'assistant'
      UNION ALL SELECT mode, 'judge', tok, 0, tok FROM r WHERE role = 'user' AND turn = 0
      UNION ALL SELECT mode, 'judge', tok, 0, tok FROM r WHERE role = 'user'
      UNION ALL SELECT mode, 'judge', 0, 1, 7 FROM r WHERE role = 'user'),
    a AS (SELECT mode, count(*) AS n, count(*) FILTER (ok) AS s FROM r GROUP BY mode),
    b AS (SELECT mode, bucket, sum(i) AS i, sum(o) AS o, sum(t) AS t FROM l GROUP BY ALL
      UNION ALL SELECT mode, 'combined', sum(i), sum(o), sum(t) FROM l GROUP BY mode),
    f AS (SELECT a.mode, a.n, a.s, k.bucket, coalesce(b.i, 0) AS i, coalesce(b.o, 0) AS o, coalesce(b.t, 0) AS t
      FROM a CROSS JOIN (VALUES ('layout_plan'), ('generation'), ('judge'), ('combined')) k(bucket)
        LEFT JOIN b ON b.mode = a.mode AND b.bucket = k.bucket)"""


@query("F13_token_usage", _USAGE_SQL + """
    SELECT mode, bucket, n AS attempted_rows, s AS successful_rows, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens,
      CAST(t AS BIGINT) AS total_tokens, round(i / nullif(s, 0), 6) AS input_tokens_per_success, round(o / nullif(s, 0), 6) AS output_tokens_per_success,
      round(t / nullif(s, 0), 6) AS total_tokens_per_success, round(i / n, 6) AS input_tokens_per_attempt,
      round(o / n, 6) AS output_tokens_per_attempt, round(t / n, 6) AS total_tokens_per_attempt FROM f""")
def _(spark, sf):
    return tidy(T.token_usage(usage_rows(spark, sf)))


@query("F11_tokens", """
    WITH r AS (SELECT 'runs/u' || (conv_id % 3) AS path, 'm' || (conv_id % 5) AS mode, turn % 3 <> 0 AS ok, role, turn, greatest(1, length(text) // 4) AS tok FROM conversations),
    l AS (SELECT path, mode, 'layout_plan' AS bucket, tok + 2 AS t FROM r WHERE role = 'system'
      UNION ALL SELECT path, mode, 'generation', tok * 2 FROM r WHERE role = 'assistant'
      UNION ALL SELECT path, mode, 'judge', tok + 7 + CASE WHEN turn = 0 THEN tok ELSE 0 END FROM r WHERE role = 'user'),
    a AS (SELECT path, mode, count(*) AS n, count(*) FILTER (ok) AS s FROM r GROUP BY ALL),
    b AS (SELECT path, mode, bucket, sum(t) AS t FROM l GROUP BY ALL UNION ALL SELECT path, mode, 'combined', sum(t) FROM l GROUP BY path, mode)
    SELECT a.path, a.mode, k.bucket, n AS attempted_rows, s AS successful_rows, CAST(coalesce(t, 0) AS BIGINT) AS total_tokens,
      round(coalesce(t, 0) / nullif(s, 0), 6) AS total_tokens_per_success
    FROM a CROSS JOIN (VALUES ('layout_plan'), ('generation'), ('judge'), ('combined')) k(bucket)
      LEFT JOIN b ON b.path = a.path AND b.mode = a.mode AND b.bucket = k.bucket""")
def _(spark, sf):
    n = F.col("conv_id")
    rows = usage_rows(spark, sf).select(
        "*", F.concat(F.lit("runs/u"), (n % 3).cast("string")).alias("path"), F.lit("e").alias("evaluator_kind"), n.cast("string").alias("pack_id"),
        F.col("turn").cast("string").alias("task_id"), (n * 1000 + F.col("turn")).alias("seq"), F.lit(None).cast("double").alias("overall_score"),
    )
    out = S.file_report(rows, baseline_mode="m0")["tokens"]
    return tidy(out.select("path", "mode", "bucket", "attempted_rows", "successful_rows", "total_tokens", "total_tokens_per_success"))


@query("F13_generation_comparison", _USAGE_SQL + """,
    g AS (SELECT mode, unnest(['input_tokens', 'output_tokens', 'total_tokens']) AS field, unnest([i / s, o / s, t / s]) AS v FROM f WHERE bucket = 'generation')
    SELECT g.mode, g.field, round(b.v, 6) AS examples_only_avg, round(g.v, 6) AS mode_avg, round(g.v - b.v, 6) AS delta,
      round(g.v / nullif(b.v, 0), 6) AS ratio FROM g JOIN g b ON b.field = g.field AND b.mode = 'm0' WHERE g.mode <> 'm0'""")
def _(spark, sf):
    return tidy(T.generation_comparison(T.token_usage(usage_rows(spark, sf)), examples_only_mode="m0"))


@query("F14_induction_usage", """
    WITH r AS (SELECT 'm' || (conv_id % 5) AS mode, turn % 3 <> 0 AS ok, role, greatest(1, length(text) // 4) AS tok FROM conversations),
    c AS (SELECT mode, role AS stage, tok AS i, 1 AS o, tok + 1 AS t FROM r UNION ALL SELECT mode, 'final', 5, 0, 5 FROM r),
    a AS (SELECT mode, count(*) AS n, count(*) FILTER (ok) AS s FROM r GROUP BY mode)
    SELECT mode, '*' AS stage, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(t) AS BIGINT) AS total_tokens,
      round(sum(t) / any_value(s), 6) AS total_per_success FROM c JOIN a USING (mode) GROUP BY mode
    UNION ALL SELECT mode, stage, CAST(sum(i) AS BIGINT), CAST(sum(o) AS BIGINT), CAST(sum(t) AS BIGINT), CAST(NULL AS DOUBLE) FROM c GROUP BY mode, stage""")
def _(spark, sf):
    call = lambda s, u: F.struct(s.alias("stage"), u.alias("usage"))
    rows = usage_rows(spark, sf).withColumn(
        "model_calls", F.array(call(F.col("stage"), _usage(p=F.col("tok"), c=F.lit(1))), call(F.lit("final"), _usage(p=F.lit(5))))
    )
    by_mode, by_stage = T.induction_usage(rows)
    cols = T.FIELDS
    top = by_mode.select("mode", F.lit("*").alias("stage"), *cols, F.col("total_tokens_per_success").alias("total_per_success"))
    return tidy(top.unionByName(by_stage.select("mode", "stage", *cols, F.lit(None).cast("double").alias("total_per_success"))))


# -- F15, F16 -----------------------------------------------------------------------------------


def skill_rows(spark, sf):
    n = F.col("doc_id")
    rule = F.when(n % 2 == 0, F.concat(F.lit('{"rule":"r","support_count":'), (n % 5).cast("string"), F.lit("}"))).otherwise(
        '{"rule":"r","supporting_examples":["a","b","a"]}'
    )
    report = F.concat(
        F.lit('{"conflicts":'), F.to_json(F.array_repeat(F.lit("c"), (n % 4).cast("int"))),
        F.lit(',"outliers":'), F.to_json(F.array_repeat(F.lit("o"), (n % 2).cast("int"))),
        F.lit(',"candidate_rules":['), rule, F.when(n % 3 == 0, ',{"rule":"x"}').otherwise(""), F.lit("]}"),
    )
    return B.wide_table(spark, sf, "documents").select(
        F.floor(n / 3).cast("string").alias("pack_id"), F.concat(F.lit("m"), (n % 3).cast("string")).alias("mode"),
        F.when(n % 11 == 0, "induction_error").otherwise("success").alias("status"), n.alias("seq"), "doc_id",
        skill_md().alias("skill_md"), report.alias("report"),
    )


_ART = f"""WITH {SECTION_SQL},
    am AS (SELECT doc_id, CAST(doc_id // 3 AS VARCHAR) AS pack_id, 'm' || (doc_id % 3) AS mode, length({SKILL_MD_SQL}) AS skill_char_length,
        s.required_rules, s.optional_rules, s.do_not_generalize_rules, doc_id % 4 AS conflicts_count, doc_id % 2 AS outliers_count,
        1 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS candidate_rules_count,
        CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 ELSE 2 END AS rule_support
      FROM documents JOIN sections s USING (doc_id) WHERE doc_id % 11 <> 0),
    lg AS (UNPIVOT (SELECT pack_id, mode, CAST(skill_char_length AS BIGINT) AS skill_char_length, CAST(required_rules AS BIGINT) AS required_rules,
        CAST(optional_rules AS BIGINT) AS optional_rules, CAST(do_not_generalize_rules AS BIGINT) AS do_not_generalize_rules,
        CAST(conflicts_count AS BIGINT) AS conflicts_count, CAST(outliers_count AS BIGINT) AS outliers_count,
        CAST(candidate_rules_count AS BIGINT) AS candidate_rules_count, CAST(rule_support AS BIGINT) AS rule_support FROM am)
      ON COLUMNS(* EXCLUDE (pack_id, mode)) INTO NAME field VALUE value)"""


@query("F15_artifact_summary", _ART + """
    SELECT mode, field, count(*) AS n, round(avg(value), 6) AS mean, CAST(min(value) AS DOUBLE) AS min,
      round(quantile_cont(value, 0.5), 6) AS p50, CAST(max(value) AS DOUBLE) AS max FROM lg GROUP BY ALL""")
def _(spark, sf):
    return tidy(A.artifact_summary(A.artifact_metrics(skill_rows(spark, sf))))


@query("F15_artifact_deltas", _ART + """
    SELECT l.field, count(*) AS paired_packs, round(avg(r.value - l.value), 6) AS mean_delta
    FROM lg l JOIN lg r ON r.pack_id = l.pack_id AND r.field = l.field AND r.mode = 'm1' WHERE l.mode = 'm0' AND l.field <> 'rule_support' GROUP BY l.field""")
def _(spark, sf):
    deltas = A.artifact_deltas(A.artifact_metrics(skill_rows(spark, sf)), left_mode="m0", right_mode="m1")
    return tidy(A.mean_artifact_deltas(deltas))


def consistency_input(spark, sf):
    e = B.eval_row(spark, sf, wide=True)
    k = F.col("k")
    first = F.when(k % 7 == 0, "12").when(k % 7 == 1, "true").otherwise((k % 11).cast("string"))
    rest = F.concat(*[F.concat(F.lit(f',"{f}":'), ((k + i) % 11).cast("string")) for i, f in enumerate(A.CONSISTENCY_SCORES[1:])])
    report = F.concat(
        F.lit('{"stable_feature_recall":'), first, rest,
        F.when(k % 13 == 0, "").otherwise(',"matched_constraints":[]'), F.lit(',"missing_or_distorted_constraints":["a"],"rationale":"r"}'),
    )
    return e.select(
        "pack_id", "mode", "status", "seq", report.alias("judge_report"), (k % 3).cast("bigint").alias("matched_literal_count"),
        (k % 3 > 0).alias("has_literal_leakage"),
    )


_CONS = """,
    cr AS (SELECT *, list_filter([CASE WHEN k % 13 = 0 THEN 'matched_constraints_must_be_list' END,
        CASE WHEN k % 7 < 2 THEN 'stable_feature_recall_must_be_number_0_to_10' END], lambda x: x IS NOT NULL) AS errors
      FROM eval_row WHERE status = 'success'),
    ok AS (SELECT * FROM cr WHERE len(errors) = 0)"""


@query("F16_invalid_rows", with_tables("eval_row", _CONS + """
    SELECT pack_id, mode, seq, array_to_string(errors, ',') AS errors FROM cr WHERE len(errors) > 0"""))
def _(spark, sf):
    bad = A.invalid_consistency_rows(A.consistency_rows(consistency_input(spark, sf)))
    return bad.withColumn("errors", F.array_join("errors", ","))


@query("F16_consistency_summary", with_tables("eval_row", _CONS + """,
    v AS (SELECT mode, 'stable_feature_recall' AS field, k % 11 AS v FROM ok
      UNION ALL SELECT mode, f, (k + i) % 11 FROM ok, (VALUES ('constraint_recall', 0), ('structure_recall', 1), ('style_signature', 2),
        ('leakage_penalty', 3), ('unsupported_specificity_penalty', 4), ('overall_self_consistency', 5)) x(f, i))
    SELECT mode, field, count(*) AS n, round(avg(v), 6) AS mean, CAST(min(v) AS DOUBLE) AS min, round(quantile_cont(v, 0.5), 6) AS p50,
      CAST(max(v) AS DOUBLE) AS max FROM v GROUP BY ALL"""))
def _(spark, sf):
    return tidy(A.consistency_summary(A.consistency_rows(consistency_input(spark, sf))))


@query("F16_leakage_by_mode", with_tables("eval_row", _CONS + """
    SELECT mode, count(*) AS successful_rows, count(*) FILTER (k % 3 > 0) AS leak_rows, CAST(sum(k % 3) AS BIGINT) AS matched_literals,
      round(count(*) FILTER (k % 3 > 0) / count(*), 6) AS leak_rate FROM ok GROUP BY mode"""))
def _(spark, sf):
    return tidy(A.leakage_by_mode(A.consistency_rows(consistency_input(spark, sf))))


@query("F16_warnings", with_tables("eval_row", _CONS + """
    SELECT pack_id, mode, seq, CAST((k + 5) % 11 AS DOUBLE) AS overall_self_consistency, CAST(k % 3 AS BIGINT) AS matched_literal_count
    FROM ok WHERE k % 3 > 0 AND (k + 5) % 11 >= 8"""))
def _(spark, sf):
    return A.consistency_warnings(A.consistency_rows(consistency_input(spark, sf)))


# -- F17, F18, F24 ------------------------------------------------------------------------------


def texted_rows(spark, sf):
    """Evaluation rows with an output text; some blank, some null."""
    n = F.col("seq")
    text = F.when(n % 9 == 0, "  ").when(n % 9 != 1, F.concat(F.lit("out "), n.cast("string")))
    return B.eval_row(spark, sf).withColumn("text", text)


_TEXTED = ", tx AS (SELECT *, CASE WHEN seq % 9 = 0 THEN '  ' WHEN seq % 9 <> 1 THEN 'out ' || seq END AS text FROM eval_row)"


@query("F17_grounding_worklist", with_tables("eval_row heldout", _TEXTED + """
    SELECT seq, pack_id, task_id, mode, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty_generation'
      WHEN CAST(pack_id AS INT) % 7 = 0 THEN 'missing_pack' WHEN task_id = '3' THEN 'missing_heldout_task' END AS skip_reason
    FROM tx WHERE status = 'success' AND mode IN ('click', 'signup', 'prompt_only')"""))
def _(spark, sf):
    held = B.heldout(spark, sf)
    packs = held.select("pack_id").distinct().filter(F.col("pack_id").cast("int") % 7 != 0)
    out = L.grounding_worklist(texted_rows(spark, sf), packs, held.filter("task_id < '3'"), modes=["click", "signup", "prompt_only"])
    return out.select("seq", "pack_id", "task_id", "mode", "skip_reason")


@query("F17_heldout_evidence", """
    WITH m AS (SELECT conv_id, string_agg('Material ' || i || ': ' || p || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS t FROM
        (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
          CASE WHEN turn % 2 = 0 THEN 'p' || turn ELSE 'material-' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) END AS p
        FROM conversations WHERE turn > 0) GROUP BY conv_id),
    e AS (SELECT 'c' || c.conv_id AS pack_id, '0' AS task_id, 'Task input:' || chr(10) || c.text || coalesce(chr(10) || chr(10) || m.t, '') AS t
      FROM conversations c LEFT JOIN m USING (conv_id) WHERE c.turn = 0)
    SELECT pack_id, task_id, CASE WHEN length(t) > 900 THEN substr(t, 1, 900) || chr(10) || chr(10) || '[TRUNCATED after 900 chars]' ELSE t END AS evidence FROM e""")
def _(spark, sf):
    c = B.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("pack_id"), F.lit("0").alias("task_id"), F.col("turn").alias("pos"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("p"), F.col("turn").cast("string"))).alias("path"), "text",
    )
    tasks = c.filter("pos = 0").select("pack_id", "task_id", F.col("text").alias("task_input"))
    return L.heldout_evidence(tasks, c.filter("pos > 0"), max_chars=900)


@query("F17_grounding_summary", with_tables("eval_row", """
    SELECT mode, count(*) AS n, count(*) FILTER (status = 'success') AS success,
      round(avg(k % 10) FILTER (status = 'success'), 6) AS mean_grounding_score,
      round(avg(k % 7) FILTER (status = 'success'), 6) AS mean_hallucination_risk,
      round(avg(k % 5) FILTER (status = 'success'), 6) AS mean_unsupported_claim_count FROM eval_row GROUP BY mode"""))
def _(spark, sf):
    k = F.col("k")
    rows = B.eval_row(spark, sf).select(
        "mode", "status", (k % 10).alias("grounding_score"), (k % 7).alias("hallucination_risk"), (k % 5).alias("unsupported_claim_count")
    )
    return tidy(L.grounding_summary(rows))


@query("F18_pattern_worklist", with_tables("expected eval_row", _TEXTED + """,
    la AS (SELECT pack_id, task_id, mode, max(seq) AS seq FROM tx WHERE status = 'success' AND text IS NOT NULL GROUP BY ALL)
    SELECT e.pack_id, e.task_id, e.mode, la.seq AS candidate_seq, 'out ' || la.seq AS text_or_blank,
      CASE WHEN la.seq IS NULL THEN 'missing_candidate_output' ELSE 'job' END AS state FROM expected e LEFT JOIN la USING (pack_id, task_id, mode)"""))
def _(spark, sf):
    out = L.pattern_worklist(_expected(spark, sf), L.latest_candidates(texted_rows(spark, sf)))
    text = F.when(F.trim("text") != "", F.col("text")).when(F.col("text").isNotNull(), F.concat(F.lit("out "), F.col("candidate_seq").cast("string")))
    return out.select("pack_id", "task_id", "mode", "candidate_seq", text.alias("text_or_blank"), "state")


@query("F18_pattern_summary", with_tables("expected eval_row", _TEXTED + """,
    la AS (SELECT DISTINCT pack_id, task_id, mode FROM tx WHERE status = 'success' AND text IS NOT NULL),
    j AS (SELECT * FROM eval_row SEMI JOIN la USING (pack_id, task_id, mode) SEMI JOIN expected USING (pack_id, task_id, mode)),
    c AS (SELECT pack_id, task_id, mode, bool_or(status = 'success' AND overall_score IS NOT NULL) AS good FROM j GROUP BY ALL),
    m AS (SELECT mode, count(*) FILTER (status = 'success' AND overall_score IS NOT NULL) AS n,
        avg(overall_score) FILTER (status = 'success') AS mean FROM j GROUP BY mode)
    SELECT e.mode, count(*) AS expected_cells, count(*) AS observed_cells, count(*) FILTER (good) AS successful_cells, CAST(0 AS BIGINT) AS missing_cells,
      count(*) - count(*) FILTER (good) AS non_success_cells, CAST(0 AS BIGINT) AS unexpected_cells, count(*) = count(*) FILTER (good) AS complete,
      coalesce(any_value(m.n), 0) AS n, round(any_value(m.mean), 6) AS mean_score
    FROM expected e LEFT JOIN c USING (pack_id, task_id, mode) LEFT JOIN m ON m.mode = e.mode GROUP BY e.mode"""))
def _(spark, sf):
    expected = _expected(spark, sf)
    work = L.pattern_worklist(expected, L.latest_candidates(texted_rows(spark, sf)))
    return tidy(S.score_summary(L.pattern_rows(work, B.eval_row(spark, sf)), expected))


@query("F24_judge_swap", with_tables("expected eval_row", _TEXTED + """,
    la AS (SELECT pack_id, task_id, mode, max(seq) AS seq, arg_max(status = 'success' AND text IS NOT NULL, seq) AS usable FROM tx GROUP BY ALL)
    SELECT e.pack_id, e.task_id, e.mode, la.seq AS candidate_seq,
      CASE WHEN coalesce(usable, false) THEN 'job' ELSE 'missing_reused_candidate' END AS state FROM expected e LEFT JOIN la USING (pack_id, task_id, mode)"""))
def _(spark, sf):
    out = L.judge_swap(_expected(spark, sf), texted_rows(spark, sf))
    return out.select("pack_id", "task_id", "mode", "candidate_seq", "state")


# -- F19, F20 -----------------------------------------------------------------------------------


def rater(spark, sf, which: int):
    """Last score per pack and mode of one rater; a few outputs differ between the raters."""
    e = B.eval_row(spark, sf).filter(F.floor(F.col("seq") / 4) % 2 == which)
    last = e.groupBy("pack_id", "mode").agg(
        F.max_by(F.struct("status", "overall_score", "seq", "judge_model"), "seq").alias("r")
    ).select("pack_id", F.lit("0").alias("task_id"), "mode", "r.*")
    odd = (F.col("pack_id").cast("int") % 13 == 0) & F.lit(which == 1)
    text = F.concat(F.lit("answer of "), F.col("pack_id"), F.lit(" in "), F.col("mode"), F.when(odd, " changed").otherwise(""))
    return last.withColumn("text", text)


def _rater_sql(which: int) -> str:
    return f"""SELECT pack_id, mode, arg_max(overall_score, seq) AS score, arg_max(status, seq) AS status, max(seq) AS seq FROM eval_row
      WHERE (seq // 4) % 2 = {which} GROUP BY ALL"""


_DIS = f""",
    l AS (SELECT * FROM ({_rater_sql(0)}) WHERE status = 'success'), r AS (SELECT * FROM ({_rater_sql(1)}) WHERE status = 'success'),
    b AS (SELECT pack_id, mode, l.score AS ls, r.score AS rs, l.seq AS lq, r.seq AS rq FROM l JOIN r USING (pack_id, mode)),
    d AS (SELECT x.pack_id, x.mode, x.ls, x.rs, y.ls AS lb, y.rs AS rb, x.ls - y.ls AS ld, x.rs - y.rs AS rd, x.lq, x.rq, y.lq AS lbq, y.rq AS rbq
      FROM b x JOIN b y ON y.pack_id = x.pack_id AND y.mode = 'prompt_only' WHERE x.mode <> 'prompt_only'),
    s AS (SELECT *, CASE WHEN ld > 1e-9 THEN 'positive' WHEN ld < -1e-9 THEN 'negative' ELSE 'tie' END AS lsig,
      CASE WHEN rd > 1e-9 THEN 'positive' WHEN rd < -1e-9 THEN 'negative' ELSE 'tie' END AS rsig FROM d),
    k AS (SELECT *, pack_id % 13 <> 0 AS same FROM (SELECT * REPLACE (CAST(pack_id AS INT) AS pack_id) FROM s WHERE lsig <> rsig))"""


@query("F19_disagreements", with_tables("eval_row", _DIS + """
    SELECT CAST(pack_id AS VARCHAR) AS pack_id, '0' AS task_id, mode, round(ld, 6) AS left_delta, round(rd, 6) AS right_delta, lsig AS left_sign, rsig AS right_sign,
      CASE WHEN 'tie' IN (lsig, rsig) THEN 'sign_or_tie_disagreement' ELSE 'sign_flip' END AS disagreement_kind,
      same AS same_candidate_output, same AS same_baseline_output, sha256('answer of ' || pack_id || ' in ' || mode) AS candidate_sha256,
      sha256('answer of ' || pack_id || ' in prompt_only') AS baseline_sha256, 's' || CAST(pack_id % 2 AS VARCHAR) AS source,
      CASE WHEN mode = 'click' THEN CASE WHEN pack_id % 3 = 0 THEN 'found' ELSE 'missing' END END AS skill_status FROM k"""))
def disagreement_query(spark, sf):
    packets = D.disagreements(rater(spark, sf, 0), rater(spark, sf, 1), baseline_mode=B.BASELINE)
    packs = B.heldout(spark, sf).filter("task_id = '0'")
    num = F.col("pack_id").cast("int")
    tasks = packs.select("pack_id", "task_id", F.concat(F.lit("s"), (num % 2).cast("string")).alias("source"), F.lit("do").alias("task_input"))
    skills = packs.filter(num % 3 == 0).select(
        "pack_id", F.lit("one").alias("mode"), F.lit("success").alias("status"), F.lit(1).alias("seq"), F.lit("# S").alias("skill_md")
    )
    out = D.with_context(packets, tasks=tasks, skills=skills, skill_mode=L.mapped(F.col("mode"), {"click": "one"}))
    return tidy(out.select(
        "pack_id", "task_id", "mode", "left_delta", "right_delta", "left_sign", "right_sign", "disagreement_kind",
        "same_candidate_output", "same_baseline_output", F.col("candidate_stats.sha256").alias("candidate_sha256"),
        F.col("baseline_stats.sha256").alias("baseline_sha256"), "source", "skill_status",
    ))


def _criteria_sql(seq: str) -> str:
    return f"'accuracy=' || CAST({seq} % 10 AS VARCHAR) || ';style=' || CAST({seq} % 7 AS VARCHAR) || ',' || CAST({seq} % 3 AS VARCHAR)"


@query("F19_context", with_tables("eval_row", _DIS + f""",
    m AS (SELECT conv_id AS pack_id, string_agg('p' || turn || ':' || length(text), ',' ORDER BY turn) AS materials FROM conversations GROUP BY conv_id)
    SELECT CAST(pack_id AS VARCHAR) AS pack_id, mode, {_criteria_sql("lq")} AS left_scores, {_criteria_sql("rq")} AS right_scores,
      {_criteria_sql("lbq")} AS left_baseline_scores, {_criteria_sql("rbq")} AS right_baseline_scores, coalesce(materials, '') AS materials,
      CASE WHEN mode = 'click' AND pack_id % 3 = 0 THEN 'solver' || CAST(pack_id % 2 AS VARCHAR) END AS solver_model
    FROM k LEFT JOIN m USING (pack_id)"""))
def _(spark, sf):
    one = lambda n: F.struct((F.col("seq") % n).cast("double").alias("score"), F.lit("r").alias("reason"), F.lit(None).cast("string").alias("parse_error"))
    scores = F.create_map(F.lit("style"), F.array(one(7), one(3)), F.lit("accuracy"), F.array(one(10)))
    packets = D.disagreements(*[rater(spark, sf, w).withColumn("scores", scores) for w in (0, 1)], baseline_mode=B.BASELINE)
    packs = B.heldout(spark, sf).filter("task_id = '0' and cast(pack_id as int) % 3 = 0")
    skills = packs.select(
        "pack_id", F.lit("one").alias("mode"), F.lit("success").alias("status"), F.lit(1).alias("seq"), F.lit("# S").alias("skill_md"),
        F.concat(F.lit("solver"), (F.col("pack_id").cast("int") % 2).cast("string")).alias("solver_model"),
    )
    materials = B.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("pack_id"), F.lit("0").alias("task_id"), F.col("turn").alias("pos"),
        F.concat(F.lit("p"), F.col("turn").cast("string")).alias("path"), "text",
    )
    out = D.with_context(packets, skills=skills, skill_mode=L.mapped(F.col("mode"), {"click": "one"}), materials=materials)
    shown = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda v: v["score"].cast("int").cast("string")), ","))), ";").alias(c)
    texts = F.array_join(F.transform("materials", lambda x: F.concat(x["path"], F.lit(":"), F.length(x["text"]).cast("string"))), ",")
    return out.select(
        "pack_id", "mode", *[shown(f"{side}_scores") for side in ("left", "right", "left_baseline", "right_baseline")],
        F.coalesce(texts, F.lit("")).alias("materials"), "solver_model",
    )


@query("F19_output_mismatches", with_tables("eval_row", _DIS + """
    SELECT 'F19_output_mismatch' AS rule_id, 'error' AS severity, pack_id || '::0::' || mode AS entity_id,
      'left and right rows hold different outputs' AS detail FROM k WHERE NOT same"""))
def _(spark, sf):
    return D.output_mismatches(D.disagreements(rater(spark, sf, 0), rater(spark, sf, 1), baseline_mode=B.BASELINE))


@query("F19_duplicate_cells", with_tables("eval_row", """
    SELECT 'F19_duplicate_success_cell' AS rule_id, 'error' AS severity, pack_id || '::' || task_id || '::' || mode AS entity_id, 'left' AS detail
    FROM eval_row WHERE status = 'success' GROUP BY pack_id, task_id, mode HAVING count(*) > 1"""))
def _(spark, sf):
    return D.duplicate_success_cells(B.eval_row(spark, sf), "left")


def labelled(spark, sf):
    """Packets and annotations from line items and orders, with faults of every kind."""
    o = B.table(spark, sf, "orders")
    n = F.col("o_orderkey")
    cell = [n.cast("string").alias("pack_id"), F.lit("0").alias("task_id"), F.lit("m").alias("mode")]
    sha = F.sha2(n.cast("string"), 256)
    packets = o.filter(n % 31 != 0).select(*cell, sha.alias("candidate_sha256"), F.when(n % 41 == 0, "x").otherwise(sha).alias("baseline_sha256"))
    twice = F.explode(F.sequence(F.lit(1), F.when(n % 59 == 0, 2).otherwise(1)))
    notes = o.filter(n % 37 != 0).select(
        *cell, twice.alias("copy"), F.when(n % 43 == 0, F.sha2(F.lit("?"), 256)).otherwise(sha).alias("candidate_sha256"), sha.alias("baseline_sha256"),
        F.when(n % 47 == 0, "odd").otherwise(F.element_at(F.array(*[F.lit(x) for x in D.LABELS]), (n % 5 + 1).cast("int"))).alias("label"),
        F.when(n % 53 != 0, "left").alias("more_credible_signal"), F.when(n % 61 == 0, " ").otherwise("because").alias("rationale"),
    ).drop("copy")
    return packets, notes


_LAB = """
    WITH p AS (SELECT o_orderkey AS n FROM orders WHERE o_orderkey % 31 <> 0),
    a AS (SELECT o_orderkey AS n FROM orders, (VALUES (1), (2)) c(i) WHERE o_orderkey % 37 <> 0 AND (i = 1 OR o_orderkey % 59 = 0)),
    an AS (SELECT n, count(*) AS c FROM a GROUP BY n),
    v AS (SELECT 'F20_packet_hash' AS rule_id, n, 'baseline_sha256' AS detail FROM p WHERE n % 41 = 0
      UNION ALL SELECT 'F20_invalid_label', n, 'odd' FROM a WHERE n % 47 = 0
      UNION ALL SELECT 'F20_invalid_signal', n, '' FROM a WHERE n % 53 = 0
      UNION ALL SELECT 'F20_rationale_missing', n, '' FROM a WHERE n % 61 = 0
      UNION ALL SELECT 'F20_annotation_count', p.n, CAST(coalesce(an.c, 0) AS VARCHAR) FROM p LEFT JOIN an USING (n) WHERE coalesce(an.c, 0) <> 1
      UNION ALL SELECT 'F20_hash_mismatch', p.n, '' FROM p JOIN an USING (n) WHERE an.c = 1 AND (n % 43 = 0 OR n % 41 = 0)
      UNION ALL SELECT 'F20_orphan_annotation', n, '' FROM an WHERE n % 31 = 0)"""


@query("F20_taxonomy_violations", _LAB + " SELECT rule_id, 'error' AS severity, n || '::0::m' AS entity_id, detail FROM v")
def _(spark, sf):
    return D.taxonomy_violations(*labelled(spark, sf))


@query("F20_label_counts", _LAB + """
    SELECT CASE WHEN n % 47 = 0 THEN 'odd' ELSE ['judge_error', 'candidate_error', 'baseline_error', 'small_delta_noise', 'ambiguous'][n % 5 + 1] END AS label,
      count(*) AS n FROM a GROUP BY 1""")
def _(spark, sf):
    return D.label_counts(labelled(spark, sf)[1])


# -- F21, F22, F23, F25, F26 --------------------------------------------------------------------

SCORED = {"src1": "missing_src1_criteria", "src2": "missing_benchmark_criteria", "src3": "missing_benchmark_criteria"}


def audit_inputs(spark, sf):
    n = F.col("doc_id")
    ex = B.table(spark, sf, "documents").select(
        (n % 10).cast("string").alias("pack_id"), n.cast("string").alias("example_id"), "source",
        F.when(n % 17 == 0, None).when(n % 13 == 0, "needs_generation").otherwise("generated").alias("output_status"),
        F.when(n % 19 == 0, " ").otherwise(F.col("text")).alias("output"),
    )
    private = B.table(spark, sf, "labels").select(
        (n % 10).cast("string").alias("pack_id"), n.cast("string").alias("task_ref"), (n % 4).alias("n_criteria")
    )
    return ex, private


_AUDIT = """
    WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS example_id, source, CASE WHEN doc_id % 17 = 0 THEN 'missing_desired_output'
        WHEN doc_id % 13 = 0 THEN 'desired_output_not_generated' WHEN doc_id % 19 = 0 OR trim(text, ' ' || chr(10)) = '' THEN 'empty_desired_output'
        WHEN l.doc_id IS NULL THEN 'missing_private_eval'
        WHEN d.doc_id % 4 = 0 THEN CASE WHEN source = 'src1' THEN 'missing_src1_criteria' ELSE 'missing_benchmark_criteria' END
        WHEN source NOT IN ('src1', 'src2', 'src3') THEN 'unsupported_source_for_audit' ELSE 'job' END AS state
      FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query("F21_audit_worklist", _AUDIT + " SELECT example_id, source, state FROM w")
def _(spark, sf):
    return L.audit_worklist(*audit_inputs(spark, sf), scored_sources=SCORED).select("example_id", "source", "state")


@query("F21_status_by_source", _AUDIT + " SELECT source, state AS status, count(*) AS n FROM w GROUP BY ALL")
def _(spark, sf):
    out = L.audit_worklist(*audit_inputs(spark, sf), scored_sources=SCORED)
    return L.audit_status_by_source(out.select("source", F.col("state").alias("status")))


@query("F22_official_scores", with_tables("expected eval_row", """,
    a AS (SELECT pack_id, task_id, mode, max(seq) AS s FROM eval_row GROUP BY ALL)
    SELECT e.pack_id, e.task_id, e.mode, CASE WHEN a.s IS NULL OR s % 7 = 0 THEN 'missing_official_eval_artifacts'
      WHEN s % 5 = 0 THEN 'ambiguous_score_artifacts' WHEN s % 5 = 1 THEN 'missing_score_artifact'
      WHEN s % 5 = 2 THEN 'score_parse_error' ELSE 'success' END AS status,
      CASE WHEN s % 7 <> 0 AND s % 5 > 2 THEN CAST(s % 100 AS DOUBLE) END AS overall_score
    FROM expected e LEFT JOIN a USING (pack_id, task_id, mode)"""))
def _(spark, sf):
    s = F.col("s")
    art = B.eval_row(spark, sf).groupBy(*S.CELL).agg(F.max("seq").alias("s")).select(
        *S.CELL, (s % 7 != 0).alias("has_slides"), F.lit(False).alias("has_failure_flag"),
        F.when(s % 5 == 0, "ambiguous").when(s % 5 == 1, "none").otherwise("found").alias("pick"),
        F.when(s % 5 > 2, (s % 100).cast("double")).alias("score_percent"),
    )
    return L.official_scores(_expected(spark, sf), art).select(*S.CELL, "status", "overall_score")


def result_listing(spark, sf):
    """Files of result directories, one directory per cell, and the score files that can be read."""
    s = F.col("seq")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    score = F.concat(F.when(s % 13 == 0, "j1_2026-01-").otherwise("j0_2026-01-"), two(s % 28 + 1), F.lit("_00-00-"), two(s % 60), F.lit("_score.yaml"))
    name = F.when(s % 5 == 0, "slides.pdf").when(s % 5 == 1, "slides_generation_failed.txt").otherwise(score)
    files = B.eval_row(spark, sf).select(*S.CELL, F.concat_ws("/", *S.CELL).alias("result_dir"), name.alias("name"), "seq")
    scores = files.filter((s % 5 > 1) & (s % 3 != 0)).select("result_dir", "name", (s % 100).cast("double").alias("score_percent"))
    return files.drop("seq"), scores


_LISTED = """,
    f AS (SELECT pack_id, task_id, mode, seq, seq % 5 > 1 AS score, CASE seq % 5 WHEN 0 THEN 'slides.pdf' WHEN 1 THEN 'slides_generation_failed.txt'
        ELSE CASE WHEN seq % 13 = 0 THEN 'j1' ELSE 'j0' END || '_2026-01-' || lpad(CAST(seq % 28 + 1 AS VARCHAR), 2, '0') || '_00-00-' || lpad(CAST(seq % 60 AS VARCHAR), 2, '0') || '_score.yaml' END AS name
      FROM eval_row),
    a AS (SELECT pack_id, task_id, mode, bool_or(seq % 5 < 2) AS present, count(*) FILTER (score) AS n, count(DISTINCT name[1:2]) FILTER (score) AS js,
        max(name[4:22] || '|' || name) FILTER (score) AS top FROM f GROUP BY ALL),
    sc AS (SELECT pack_id, task_id, mode, name, max(seq % 100) AS v FROM f WHERE score AND seq % 3 <> 0 GROUP BY ALL),
    o AS (SELECT e.pack_id, e.task_id, e.mode, CASE WHEN NOT coalesce(present, false) THEN 'missing_official_eval_artifacts' WHEN js > 1 THEN 'ambiguous_score_artifacts'
        WHEN n = 0 THEN 'missing_score_artifact' WHEN v IS NULL THEN 'score_parse_error' ELSE 'success' END AS status, CAST(v AS DOUBLE) AS v
      FROM expected e LEFT JOIN a USING (pack_id, task_id, mode)
        LEFT JOIN sc ON sc.pack_id = e.pack_id AND sc.task_id = e.task_id AND sc.mode = e.mode AND sc.name = split_part(a.top, '|', 2))"""


@query("F22_from_listing", with_tables("expected eval_row", _LISTED + """
    SELECT pack_id, task_id, mode, status, CASE WHEN status = 'success' THEN v END AS overall_score FROM o"""))
def _(spark, sf):
    out = L.official_scores(_expected(spark, sf), L.artifacts_from_listing(*result_listing(spark, sf)))
    return out.select(*S.CELL, "status", "overall_score")


@query("F22_score_summary", with_tables("expected eval_row", _LISTED + """
    SELECT mode, count(*) AS expected_cells, count(*) AS observed_cells, count(*) FILTER (status = 'success') AS successful_cells, CAST(0 AS BIGINT) AS missing_cells,
      count(*) FILTER (status <> 'success') AS non_success_cells, CAST(0 AS BIGINT) AS unexpected_cells, count(*) = count(*) FILTER (status = 'success') AS complete,
      count(*) FILTER (status = 'success') AS n, round(avg(v) FILTER (status = 'success'), 6) AS mean_score FROM o GROUP BY mode"""))
def _(spark, sf):
    expected = _expected(spark, sf)
    scores = L.official_scores(expected, L.artifacts_from_listing(*result_listing(spark, sf)))
    return tidy(S.score_summary(scores.withColumn("seq", F.lit(0).cast("long")), expected))


def runtime_rows(spark, sf):
    k = F.col("k")
    meta = F.concat(
        F.lit('{"max_tokens":'), F.when(k % 5 == 0, "100").otherwise("200"), F.when(k % 7 == 0, "").otherwise(',"budget":null'),
        F.lit(',"version":"v1","thinking":'), F.when(k % 3 == 0, "1").otherwise("true"), F.lit("}"),
    )
    return B.eval_row(spark, sf).withColumn("metadata_json", meta)


@query("F23_compatible_rows", with_tables("expected eval_row", """
    SELECT seq, pack_id, task_id, mode FROM eval_row SEMI JOIN expected USING (pack_id, task_id, mode)
    WHERE status = 'success' AND judge_model = '1' AND k % 5 <> 0 AND k % 7 <> 0 AND k % 3 <> 0"""))
def _(spark, sf):
    meta = {"max_tokens": 200, "budget": None, "version": "v1", "thinking": True}
    out = L.compatible_success(runtime_rows(spark, sf), _expected(spark, sf), judge_model="1", metadata=meta)
    return out.select("seq", "pack_id", "task_id", "mode")


@query("F23_stray_cells", with_tables("expected eval_row", """
    SELECT DISTINCT pack_id, task_id, mode FROM eval_row ANTI JOIN expected USING (pack_id, task_id, mode)"""))
def _(spark, sf):
    return L.stray_cells(B.eval_row(spark, sf), _expected(spark, sf))


def preflight(spark, sf, order, status):
    num = F.col("pack_id").cast("int")
    held = B.heldout(spark, sf)
    done = B.eval_row(spark, sf).filter("status = 'success' and seq % 3 = 0")
    private = held.filter(num % 11 != 0).withColumn("n_criteria", num % 4)
    skills = held.select("pack_id").distinct().filter(num % 3 == 0).withColumn("skill_mode", F.lit("one"))
    return L.eval_worklist(
        _expected(spark, sf), done, private, skills, skill_of_mode={"click": "one", "signup": "full"},
        missing_names={"signup": "missing_full_skill"}, order=order, criteria_status=status,
    )


def _preflight_sql(first: str, second: str) -> str:
    return with_tables("expected eval_row", f"""
    SELECT pack_id, task_id, mode, CASE mode WHEN 'click' THEN 'one' WHEN 'signup' THEN 'full' END AS skill_mode,
      CASE {first} {second} ELSE 'job' END AS state
    FROM (SELECT *, CAST(pack_id AS INT) AS p FROM expected) ANTI JOIN (SELECT * FROM eval_row WHERE status = 'success' AND seq % 3 = 0) USING (pack_id, task_id, mode)""")


_CRIT = "WHEN p % 11 = 0 OR p % 4 = 0 THEN 'no_criteria'"
_SKILL = "WHEN mode = 'signup' THEN 'missing_full_skill' WHEN mode = 'click' AND p % 3 <> 0 THEN 'missing_skill'"


@query("F25_worklist", _preflight_sql("WHEN p % 11 = 0 THEN 'missing_private_eval' " + _CRIT, _SKILL))
def _(spark, sf):
    return preflight(spark, sf, ("private", "criteria", "skill"), "no_criteria")


@query("F25_worklist_skill_first", _preflight_sql(_SKILL, _CRIT))
def _(spark, sf):
    return preflight(spark, sf, ("skill", "criteria"), "no_criteria")


@query("F26_skill_selection", with_tables("eval_row", """,
    s AS (SELECT * FROM eval_row WHERE status = 'success' AND mode IN ('click', 'signup'))
    SELECT seq, pack_id, mode FROM s WHERE pack_id IN (SELECT pack_id FROM s GROUP BY 1 ORDER BY min(seq) LIMIT 25)"""))
def _(spark, sf):
    out = L.selected_skill_rows(B.eval_row(spark, sf), modes=["click", "signup"], limit_packs=25)
    return out.select("seq", "pack_id", "mode")
