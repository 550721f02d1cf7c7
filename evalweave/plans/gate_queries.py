"""Registered queries of the governance gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.operators import flow_audit as X
from evalweave.operators import readiness as R
from evalweave.operators import schema_rules as H
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


# -- H1 -----------------------------------------------------------------------------------------


def raw_eval_rows(spark, sf):
    e = B.wide_table(spark, sf, "events").withColumn("k", B._k())
    k = F.col("k")
    raw = F.concat(
        F.lit('{"schema_version":'), F.when(k % 31 == 0, '"old/v0"').otherwise('"heldout-eval/v1"'),
        F.lit(',"status":'), F.when(k % 5 == 0, '"model_error"').otherwise('"success"'),
        F.when(k % 29 == 0, "").otherwise(',"pack_id":"p"'), F.lit(',"task_id":'), F.when(k % 23 == 0, '" "').otherwise('"t"'),
        F.lit(',"mode":"m","evaluator_kind":"e","solver_model":'), F.when(k % 19 == 0, "7").otherwise("null"),
        F.when(k % 17 == 0, "").otherwise(F.concat(F.lit(',"overall_score":'), F.when(k % 13 == 0, "true").when(k % 5 == 0, "null").otherwise("3.5"))),
        F.lit("}"),
    )
    return e.select(F.col("event_id").alias("seq"), F.when(k % 37 == 1, F.lit("[1]")).otherwise(raw).alias("raw"))


_EVAL_FAULTS = """
    WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
    f AS (SELECT event_id, CASE WHEN k % 37 = 1 THEN ['row must be an object'] ELSE list_filter([
        CASE WHEN k % 31 = 0 THEN 'unsupported schema_version: old/v0' END,
        CASE WHEN k % 29 = 0 THEN 'missing required field: pack_id' END,
        CASE WHEN k % 23 = 0 THEN 'task_id must be a non-empty string' END,
        CASE WHEN k % 17 = 0 THEN 'missing required nullable field: overall_score' END,
        CASE WHEN k % 19 = 0 THEN 'solver_model must be a string or null' END,
        CASE WHEN k % 17 <> 0 AND k % 5 <> 0 AND k % 13 = 0 THEN 'success overall_score must be numeric' END,
        CASE WHEN k % 17 <> 0 AND k % 5 = 0 AND k % 13 = 0 THEN 'non-success overall_score must be null' END], lambda x: x IS NOT NULL) END AS fs FROM e)"""


@query("H1_eval_rows_first", _EVAL_FAULTS + """
    SELECT 'H1_eval' AS rule_id, 'error' AS severity, CAST(event_id AS VARCHAR) AS entity_id, fs[1] AS detail FROM f WHERE len(fs) > 0""")
def _(spark, sf):
    return H.schema_violations(raw_eval_rows(spark, sf), "eval")


@query("H1_eval_rows_all", _EVAL_FAULTS + """
    SELECT 'H1_eval' AS rule_id, 'error' AS severity, CAST(event_id AS VARCHAR) AS entity_id, unnest(fs) AS detail FROM f""")
def _(spark, sf):
    return H.schema_violations(raw_eval_rows(spark, sf), "eval", mode="all")


@query("H1_generated_rows", """
    WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
    SELECT 'H1_generated_outputs' AS rule_id, 'error' AS severity, CAST(event_id AS VARCHAR) AS entity_id, d AS detail FROM
      (SELECT event_id, CASE WHEN k % 11 = 0 THEN 'missing required field: job_id'
        WHEN k % 5 = 0 AND k % 7 = 0 THEN 'success row finish_reason must be stop'
        WHEN k % 5 = 1 AND k % 7 = 0 THEN 'missing required field: error' WHEN k % 5 = 2 THEN 'missing required field: leak_matches'
        WHEN k % 5 = 4 THEN 'unsupported generated output status: odd' END AS d FROM e) WHERE d IS NOT NULL""")
def _(spark, sf):
    e = B.wide_table(spark, sf, "events").withColumn("k", B._k())
    k = F.col("k")
    five = [F.lit(x) for x in ("success", "error", "rejected_private_leak", "rejected_incomplete_generation", "odd")]
    raw = F.concat(
        F.lit('{"schema_version":"generated-desired-output/v1","status":"'), F.element_at(F.array(*five), (k % 5 + 1).cast("int")),
        F.lit('","pack_id":"p","example_id":"e","desired_output":"t","finish_reason":"'), F.when(k % 7 == 0, "length").otherwise("stop"),
        F.lit('"'), F.when(k % 11 == 0, "").otherwise(',"job_id":"j"'), F.when(k % 7 == 0, "").otherwise(',"error":null'), F.lit("}"),
    )
    return H.schema_violations(e.select(F.col("event_id").alias("seq"), raw.alias("raw")), "generated_outputs")


@query("H1_skill_rows", """
    WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
    f AS (SELECT event_id, list_filter([
        CASE WHEN k % 13 = 0 THEN 'unsupported schema_version: skill/v0' END, CASE WHEN k % 11 = 0 THEN 'mode must be a non-empty string' END,
        CASE WHEN k % 7 = 0 THEN 'missing required field: model_calls' WHEN k % 7 = 1 THEN 'model_calls must be a list' END,
        CASE WHEN k % 5 = 4 THEN 'solver_model must be a string or null' END,
        CASE WHEN k % 3 = 0 AND k % 4 = 1 THEN 'skill_md must be a non-empty string' END,
        CASE WHEN k % 3 = 1 AND k % 4 = 0 THEN 'missing required field: error' END,
        CASE WHEN k % 3 = 2 THEN 'unsupported skill row status: odd' END], lambda x: x IS NOT NULL) AS fs FROM e)
    SELECT 'H1_skills' AS rule_id, 'error' AS severity, CAST(event_id AS VARCHAR) AS entity_id, unnest(fs) AS detail FROM f""")
def _(spark, sf):
    e = B.wide_table(spark, sf, "events").withColumn("k", B._k())
    k = F.col("k")
    status = F.when(k % 3 == 0, "success").when(k % 3 == 1, "induction_error").otherwise("odd")
    raw = F.concat(
        F.lit('{"schema_version":"'), F.when(k % 13 == 0, "skill/v0").otherwise(H.SKILL_SCHEMA), F.lit('","status":"'), status, F.lit('","pack_id":"p","mode":"'),
        F.when(k % 11 == 0, " ").otherwise("m"), F.lit('","skill_md":'), F.when(k % 4 == 1, '""').otherwise('"# s"'),
        F.when(k % 7 == 0, "").when(k % 7 == 1, ',"model_calls":{}').otherwise(',"model_calls":[]'),
        F.when(k % 5 == 4, ',"solver_model":7').when(k % 5 == 3, ',"solver_model":null').otherwise(""), F.when(k % 4 == 0, "").otherwise(',"error":"e"'), F.lit("}"),
    )
    return H.schema_violations(e.select(F.col("event_id").alias("seq"), raw.alias("raw")), "skills", mode="all")


# -- H2 -----------------------------------------------------------------------------------------


def _src(c):
    return F.concat(F.lit("src"), (c % 2).cast("string"))


def flow_tables(spark, sf, *, with_payload: bool = True) -> X.FlowTables:
    """Orders as splits and packs, line items as tasks, with a fault of each kind spread over them."""
    o = B.table(spark, sf, "orders")
    n = F.col("o_orderkey")
    sid = lambda c: F.concat(F.lit("s"), c.cast("string"))
    pid = lambda c: F.concat(F.lit("p"), c.cast("string"))
    splits = o.select(sid(n).alias("split_id"), _src(n).alias("source"), (n % 3).cast("string").alias("domain"))
    allowed = [F.lit(x) for x in X.ALLOWED_FIELDS]
    packs = o.select(
        pid(n).alias("pack_id"), F.when(n % 97 == 0, "none").otherwise(sid(n)).alias("split_id"),
        F.when(n % 89 == 0, "other").otherwise(_src(n)).alias("source"), F.when(n % 83 == 0, "x").otherwise((n % 3).cast("string")).alias("domain"),
        F.when(n % 79 == 0, F.array(*allowed, F.lit("extra"))).when(n % 77 == 0, F.array(F.lit(X.ALLOWED_FIELDS[0]))).when(n % 73 != 0, F.array(*allowed)).alias("can_use"),
        F.when(n % 71 == 0, F.array().cast("array<string>")).when(n % 73 != 0, F.array(F.lit("heldout tasks"))).alias("must_not_use"),
        F.concat(F.lit('{"a":{"'), F.when(n % 67 == 0, "judge").otherwise("k"), F.lit('":1}}')).alias("payload"),
    )
    if not with_payload:
        packs = packs.drop("payload")
    li = B.table(spark, sf, "lineitem").withColumn("p", F.col("l_partkey")).withColumn(
        "e", F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    )
    p, k, train = F.col("p"), F.col("l_orderkey"), F.col("l_linenumber") <= 4
    task = F.concat_ws("-", p.cast("string"), F.col("l_suppkey").cast("string"))
    split_tasks = li.filter(p % 101 != 0).select(
        sid(k).alias("split_id"), F.when(train, "train").otherwise("heldout").alias("role"), _src(k).alias("source"), task.alias("source_id")
    )
    base = [pid(k).alias("pack_id"), p.alias("pos"), _src(k).alias("source"), task.alias("source_task_id")]
    lines = li.filter(train)
    output = F.when(p % 67 == 0, " ").when(p % 59 == 0, "see the hidden rubric").otherwise(F.concat(F.lit("text "), p.cast("string")))
    prompt = F.concat(F.lit("prompt "), F.col("e"))
    ids = [F.col("e").alias("example_id"), F.when(p % 71 != 0, F.concat(F.lit("j"), F.col("e"))).alias("job_id"), F.sha2(prompt, 256).alias("prompt_sha256")]
    examples = lines.select(
        *base, *ids, F.when(p % 61 == 0, "needs_generation").otherwise("generated").alias("output_status"), output.alias("output"),
        F.lit("v").alias("prompt_template_version"),
    )
    heldout = li.filter(~train).select(*base, F.col("e").alias("task_id"), (p % 43 == 0).alias("has_output"))
    private_rows = o.filter(n % 53 != 0).select(pid(n).alias("pack_id"), F.when(n % 47 == 0, "gone").otherwise(sid(n)).alias("split_id"), _src(n).alias("source"))
    private_tasks = li.filter(p % 103 != 0).select(
        pid(k).alias("pack_id"), p.alias("pos"), F.when(train, "train").otherwise("heldout").alias("role"), F.col("e").alias("task_ref"), _src(k).alias("source"),
        F.when(p % 109 == 0, "moved").otherwise(task).alias("source_task_id"), F.when(p % 107 != 0, "{}").alias("supervision"), F.lit("{}").alias("judge"),
    )
    jobs = lines.filter(p % 73 != 0).select(
        F.concat(F.lit("j"), F.col("e")).alias("job_id"), F.when(p % 79 == 0, "px").otherwise(pid(k)).alias("pack_id"), F.col("e").alias("example_id"),
        _src(k).alias("source"), task.alias("source_task_id"), F.when(p % 83 == 0, "bad").otherwise(F.sha2(prompt, 256)).alias("prompt_sha256"),
        F.when(p % 31 == 0, "old").otherwise("v").alias("prompt_template_version"), F.when(p % 37 == 0, " ").otherwise(prompt).alias("prompt"),
        F.when(p % 41 == 0, 0).otherwise(100).alias("material_budget_chars"),
    )
    log = lines.filter(p % 83 != 1).select(
        F.concat(F.lit("j"), F.col("e")).alias("job_id"), F.sha2(prompt, 256).alias("prompt_sha256"), pid(k).alias("pack_id"), F.col("e").alias("example_id"),
        _src(k).alias("source"), task.alias("source_task_id"), F.lit("v").alias("prompt_template_version"), F.lit(1).alias("seq"),
        F.when(p % 89 == 0, "error").otherwise("success").alias("status"), F.when(p % 29 == 0, "length").otherwise("stop").alias("finish_reason"),
        F.when(p % 97 == 0, "else").otherwise(output).alias("desired_output"),
    )
    replayed = lines.select(F.col("e").alias("example_id"), F.when(p % 23 == 0, "new prompt").otherwise(prompt).alias("prompt"))
    return X.FlowTables(
        splits=splits, split_tasks=split_tasks, packs=packs, examples=examples, heldout=heldout, private_rows=private_rows,
        private_tasks=private_tasks, jobs=jobs, log=log, replayed=replayed, required_sources=("src0", "src1", "src9"), template_version="v",
    )


_FLOW = """
    WITH o AS (SELECT o_orderkey AS n, 'p' || o_orderkey AS pk FROM orders),
    l AS (SELECT l_orderkey AS k, 'p' || l_orderkey AS pk, l_partkey AS p, l_linenumber <= 4 AS train, CASE WHEN l_linenumber <= 4 THEN 'train' ELSE 'heldout' END AS role,
        l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS e, l_partkey || '-' || l_suppkey AS task,
        'p' || l_orderkey || '/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS w FROM lineitem),
    pv AS (SELECT * FROM o WHERE n % 53 <> 0),
    fz AS (SELECT * FROM l WHERE train AND p % 61 <> 0 AND p % 67 <> 0),
    jb AS (SELECT *, p % 73 <> 0 AS jf, p % 101 <> 0 AND k % 97 <> 0 AS tf FROM fz WHERE p % 71 <> 0),
    cur AS (SELECT * FROM jb WHERE jf AND p % 37 <> 0 AND tf AND p % 31 <> 0)
"""

_FLOW_RULES = {
    "H2_missing_source": "SELECT 'src9', ''",
    "H2_split_missing": "SELECT pk, 'none' FROM o WHERE n % 97 = 0",
    "H2_source_differs": "SELECT pk, 's' || n FROM o WHERE n % 97 <> 0 AND n % 89 = 0",
    "H2_domain_differs": "SELECT pk, 's' || n FROM o WHERE n % 97 <> 0 AND n % 83 = 0",
    "H2_boundary_missing": "SELECT pk, '' FROM o WHERE n % 79 <> 0 AND n % 77 <> 0 AND n % 73 = 0 AND n % 71 <> 0",
    "H2_boundary_no_forbidden": "SELECT pk, '' FROM o WHERE n % 71 = 0 OR (n % 73 = 0 AND (n % 79 = 0 OR n % 77 = 0))",
    "H2_boundary_required": "SELECT pk, 'train_examples.desired_output.text' FROM o WHERE (n % 79 <> 0 AND n % 77 = 0) OR (n % 79 <> 0 AND n % 73 = 0 AND n % 71 = 0)",
    "H2_boundary_extra": "SELECT pk, 'extra' FROM o WHERE n % 79 = 0",
    "H2_private_row_missing": "SELECT pk, '' FROM o WHERE n % 53 = 0",
    "H2_private_split_differs": "SELECT pk, '' FROM pv WHERE (n % 47 = 0) OR (n % 97 = 0)",
    "H2_private_source_differs": "SELECT pk, '' FROM pv WHERE n % 89 = 0",
    "H2_private_key_in_pack": "SELECT pk, '$.a.judge' FROM o WHERE n % 67 = 0",
    "H2_source_tasks_overlap": "SELECT pk, ('src' || (k % 2)) || '/' || task FROM l GROUP BY pk, k, task HAVING bool_or(train) AND bool_or(NOT train)",
    "H2_split_tasks_differ": """SELECT DISTINCT pk, role FROM (SELECT pk, role, task FROM l WHERE k % 97 <> 0 AND k IN (SELECT n FROM o) GROUP BY pk, role, task HAVING bool_and(p % 101 = 0))""",
    "H2_private_refs_differ": "SELECT DISTINCT pk, role FROM l WHERE p % 103 = 0 AND k % 53 <> 0 AND k IN (SELECT n FROM o)",
    "H2_private_source_id": "SELECT pk, role || '.' || e FROM l WHERE p % 109 = 0 AND p % 103 <> 0 AND k % 53 <> 0 AND k IN (SELECT n FROM o)",
    "H2_not_frozen": "SELECT w, 'needs_generation' FROM l WHERE train AND p % 61 = 0",
    "H2_output_empty": "SELECT w, '' FROM l WHERE train AND p % 61 <> 0 AND p % 67 = 0",
    "H2_output_leaks": r"SELECT w, '\bhidden rubric\b' FROM fz WHERE p % 59 = 0",
    "H2_no_job_id": "SELECT w, '' FROM fz WHERE p % 71 = 0",
    "H2_job_missing": "SELECT w, 'j' || e FROM jb WHERE NOT jf",
    "H2_job_pack_id": "SELECT w, '' FROM jb WHERE jf AND p % 79 = 0",
    "H2_job_prompt_sha256": "SELECT w, '' FROM jb WHERE jf AND p % 83 = 0",
    "H2_job_template": "SELECT w, '' FROM jb WHERE jf AND p % 31 = 0",
    "H2_job_prompt_empty": "SELECT w, '' FROM jb WHERE jf AND p % 37 = 0",
    "H2_job_budget": "SELECT w, '' FROM cur WHERE p % 41 = 0",
    "H2_job_prompt_replay": "SELECT w, '' FROM cur WHERE p % 23 = 0",
    "H2_job_not_replayed": "SELECT w, 'old' FROM jb WHERE jf AND p % 37 <> 0 AND tf AND p % 31 = 0",
    "H2_job_sha_of_prompt": "SELECT w, '' FROM jb WHERE jf AND p % 37 <> 0 AND p % 83 = 0",
    "H2_orphan_job": "SELECT 'j' || e, '' FROM l WHERE train AND p % 73 <> 0 AND p % 71 = 0",
    "H2_log_missing": "SELECT w, 'j' || e FROM jb WHERE p % 83 = 1",
    "H2_log_status": "SELECT w, 'error' FROM jb WHERE p % 83 <> 1 AND p % 89 = 0",
    "H2_log_finish": "SELECT w, 'length' FROM jb WHERE p % 83 <> 1 AND p % 29 = 0",
    "H2_log_text": "SELECT w, '' FROM jb WHERE p % 83 <> 1 AND p % 97 = 0",
    "H2_heldout_has_output": "SELECT w, '' FROM l WHERE NOT train AND p % 43 = 0",
    "H2_private_split_missing": "SELECT pk, 'gone' FROM pv WHERE n % 47 = 0",
    "H2_private_content": "SELECT pk || '.' || role || '.' || p, '' FROM l WHERE p % 103 <> 0 AND p % 107 = 0",
}
_WARN = {"H2_job_not_replayed", "H2_orphan_job"}
FLOW_SQL = _FLOW + ", v AS (" + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule_id, '{'warning' if rule in _WARN else 'error'}' AS severity, a AS entity_id, b AS detail FROM ({sql}) t(a, b)"
    for rule, sql in _FLOW_RULES.items()
) + ")"


@query("H2_flow_audit", FLOW_SQL + " SELECT * FROM v")
def flow_audit_query(spark, sf):
    return X.audit_flow(flow_tables(spark, sf))


@query("H2_rule_counts", FLOW_SQL + " SELECT rule_id, severity, count(*) AS n FROM v GROUP BY ALL")
def _(spark, sf):
    return X.audit_flow(flow_tables(spark, sf)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


# -- H3, H4, H5, H6 -----------------------------------------------------------------------------


def pack_tables(spark, sf):
    t = flow_tables(spark, sf, with_payload=False)
    return t.packs, t.examples, t.heldout


@query("H3_example_status", _FLOW + """
    SELECT o.pk AS pack_id, count(l.e) AS train_examples, count(l.e) FILTER (p % 61 <> 0) AS generated,
      count(l.e) FILTER (p % 61 = 0) AS needs_generation, CAST(0 AS BIGINT) AS invalid
    FROM o LEFT JOIN l ON l.pk = o.pk AND l.train GROUP BY o.pk""")
def _(spark, sf):
    packs, examples, _ = pack_tables(spark, sf)
    return R.example_status_counts(packs, examples)


def skill_table(spark, sf):
    k = F.col("k")
    return B.eval_row(spark, sf).select(
        "pack_id", "mode", F.when(k % 41 == 0, "induction_error").otherwise("success").alias("status"),
        F.when(k % 3 == 0, " ").otherwise("# s").alias("skill_md"), "seq",
    )


@query("H4_skill_coverage", with_tables("eval_row", """
    SELECT pack_id, array_to_string(list_filter(['click', 'signup'], lambda m: NOT list_contains(have, m)), ',') AS missing_modes, f AS failures,
      f = 0 AND len(list_filter(['click', 'signup'], lambda m: NOT list_contains(have, m))) = 0 AS ready
    FROM (SELECT pack_id, coalesce(list(DISTINCT mode) FILTER (k % 41 <> 0 AND k % 3 <> 0), []) AS have, count(*) FILTER (k % 41 = 0) AS f FROM eval_row GROUP BY pack_id)"""))
def _(spark, sf):
    out = R.skill_coverage(skill_table(spark, sf), required=["click", "signup"])
    return out.withColumn("missing_modes", F.array_join("missing_modes", ","))


_H5 = """,
    m AS (SELECT pack_id, task_id, mode, count(*) AS n, string_agg(DISTINCT status, ',' ORDER BY status) AS st, bool_or(status <> 'success') AS bad FROM eval_row GROUP BY ALL),
    t AS (SELECT pack_id, task_id, CAST(sum(n) AS BIGINT) AS n_rows, list(mode) AS have,
        coalesce(string_agg(mode, ',' ORDER BY mode) FILTER (n > 1), '') AS duplicate_modes,
        coalesce(string_agg(mode || '=' || CASE WHEN n = 1 THEN st ELSE 'duplicate_statuses:' || st END, ' ' ORDER BY mode) FILTER (bad), '') AS non_success_modes FROM m GROUP BY ALL),
    h5 AS (SELECT pack_id, task_id, n_rows, array_to_string(list_filter(['click', 'prompt_only'], lambda x: NOT list_contains(have, x)), ',') AS missing_modes,
        duplicate_modes, non_success_modes FROM t)"""


@query("H5_eval_coverage", with_tables("eval_row", _H5 + " SELECT *, missing_modes = '' AND non_success_modes = '' AS ready FROM h5"))
def _(spark, sf):
    out = R.eval_coverage(B.eval_row(spark, sf), required=["click", "prompt_only"])
    return out.withColumns({
        "missing_modes": F.array_join("missing_modes", ","), "duplicate_modes": F.array_join("duplicate_modes", ","),
        "non_success_modes": F.array_join("non_success_modes", " "),
    })


def inventory(spark, sf):
    k = F.col("k")
    none = F.array().cast("array<string>")
    e = B.eval_row(spark, sf)
    skills = e.filter("mode = 'click'").select(
        R.row_models(F.array(F.when(k % 4 == 0, "a").otherwise("")), F.when(k % 6 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(none)).alias("solver_models")
    )
    evals = e.select(
        "status", R.row_models(F.array(F.when(k % 5 == 0, "s").otherwise(" "))).alias("solver_models"),
        R.row_models(F.array(F.concat(F.lit("j"), F.col("judge_model"))), F.when(k % 7 == 0, F.array(F.lit("x"))).otherwise(none)).alias("judge_models"),
    )
    return R.model_inventory(skills, evals)


_INV = """,
    r AS (SELECT 'skill_solver' AS role, true AS ok, list_distinct(CASE WHEN k % 4 = 0 THEN ['a'] ELSE [] END || CASE WHEN k % 6 = 0 THEN ['b', 'a'] ELSE [] END) AS ms
        FROM eval_row WHERE mode = 'click'
      UNION ALL SELECT 'eval_solver', status = 'success', CASE WHEN k % 5 = 0 THEN ['s'] ELSE [] END FROM eval_row
      UNION ALL SELECT 'eval_judge', status = 'success', ['j' || judge_model] || CASE WHEN k % 7 = 0 THEN ['x'] ELSE [] END FROM eval_row),
    u AS (SELECT 'all' AS scope, * FROM r UNION ALL SELECT 'scored', * FROM r WHERE ok),
    iv AS (SELECT scope, role, model, count(*) AS n FROM (SELECT scope, role, unnest(CASE WHEN len(ms) = 0 THEN [NULL] ELSE ms END) AS model FROM u) GROUP BY ALL)"""


@query("H6_model_inventory", with_tables("eval_row", _INV + " SELECT * FROM iv"))
def _(spark, sf):
    return inventory(spark, sf)


@query("H6_monoculture", with_tables("eval_row", _INV + """
    SELECT scope, count(DISTINCT model) AS n_models, CASE WHEN count(DISTINCT model) = 1 THEN min(model) END AS monoculture_model,
      CAST(coalesce(sum(n) FILTER (model IS NULL), 0) AS BIGINT) AS rows_without_model, count(DISTINCT model) = 1 AS monoculture,
      coalesce(sum(n) FILTER (model IS NULL), 0) = 0 AS identity_complete FROM iv GROUP BY scope"""))
def _(spark, sf):
    return R.monoculture(inventory(spark, sf))


# -- H7, H8 -------------------------------------------------------------------------------------


def eval_of_orders(spark, sf):
    """Evaluation rows of the order packs: most heldout lines in two modes, some failed or absent."""
    _, _, held = pack_tables(spark, sf)
    p = F.col("pos")
    modes = F.explode(F.when(p % 17 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))))
    return held.filter(p % 13 != 0).select("pack_id", "task_id", "pos", modes.alias("mode")).withColumn(
        "status", F.when((p % 19 == 0) & (F.col("mode") == "b"), "model_error").otherwise("success")
    )


@query("H7_readiness", _FLOW + """,
    c AS (SELECT o.pk, count(l.e) AS t, count(l.e) FILTER (p % 61 <> 0) AS g FROM o LEFT JOIN l ON l.pk = o.pk AND l.train GROUP BY 1),
    us AS (SELECT DISTINCT pk FROM fz),
    hl AS (SELECT * FROM l WHERE NOT train),
    v AS (SELECT 'H7_no_train_examples' AS rule_id, pk AS entity_id, '' AS detail FROM c WHERE t = 0
      UNION ALL SELECT 'H7_few_outputs', pk, CAST(g AS VARCHAR) FROM c WHERE g < 2
      UNION ALL SELECT 'H7_not_frozen', pk, '' FROM c WHERE g < t
      UNION ALL SELECT 'H7_no_skill_rows', pk, '' FROM o WHERE n % 10 = 0
      UNION ALL SELECT 'H7_missing_skill_modes', pk, 's2' FROM o WHERE n % 10 = 1
      UNION ALL SELECT 'H7_main_missing', pk || '::' || e, '' FROM hl WHERE p % 13 = 0 AND pk IN (SELECT pk FROM us) AND k IN (SELECT n FROM o WHERE n % 89 <> 0 AND n % 2 = 0)
      UNION ALL SELECT 'H7_main_incomplete', pk || '::' || e, '' FROM hl WHERE p % 13 <> 0 AND (p % 17 = 0 OR p % 19 = 0))
    SELECT rule_id, 'error' AS severity, entity_id, detail FROM v""")
def _(spark, sf):
    packs, examples, held = pack_tables(spark, sf)
    num = F.substring("pack_id", 2, 20).cast("bigint")
    modes = F.explode(F.when(num % 10 == 1, F.array(F.lit("s1"))).otherwise(F.array(F.lit("s1"), F.lit("s2"))))
    skills = packs.filter(num % 10 != 0).select("pack_id", modes.alias("mode"), F.lit("success").alias("status"), F.lit("# s").alias("skill_md"))
    profile = R.Profile(skill_modes=("s1", "s2"), eval_modes=("a", "b"))
    return R.readiness(
        profile, packs=packs, examples=examples, heldout=held, skills=skills, evals={"main": (eval_of_orders(spark, sf), "src0")}
    )


@query("H7_readiness_smoke", _FLOW + """,
    c AS (SELECT o.pk, count(l.e) AS t, count(l.e) FILTER (p % 61 <> 0) AS g FROM o LEFT JOIN l ON l.pk = o.pk AND l.train GROUP BY 1),
    hl AS (SELECT * FROM l WHERE NOT train),
    v AS (SELECT 'H7_no_train_examples' AS rule_id, 'error' AS severity, pk AS entity_id, '' AS detail FROM c WHERE t = 0
      UNION ALL SELECT 'H7_few_outputs', 'error', pk, CAST(g AS VARCHAR) FROM c WHERE g < 2
      UNION ALL SELECT 'H7_not_frozen', 'error', pk, '' FROM c WHERE g < t
      UNION ALL SELECT 'H7_' || name || '_incomplete', severity, pk || '::' || e, '' FROM hl, (VALUES ('main', 'error'), ('extra', 'warning')) n(name, severity)
        WHERE p % 13 <> 0 AND (p % 17 = 0 OR p % 19 = 0)
      UNION ALL SELECT 'H7_official_absent', 'warning', '', '' WHERE EXISTS (SELECT 1 FROM hl)
      UNION ALL SELECT 'H7_model_monoculture', 'warning', 'm1', 'some rows lack model identity'
      UNION ALL SELECT 'H1_eval', 'error', CAST(event_id AS VARCHAR), 'row must be an object' FROM events WHERE event_id % 997 = 0)
    SELECT rule_id, severity, entity_id, detail FROM v""")
def _(spark, sf):
    packs, examples, held = pack_tables(spark, sf)
    evals = eval_of_orders(spark, sf)
    e = B.table(spark, sf, "events")
    faults = H.schema_violations(e.filter("event_id % 997 = 0").select(F.col("event_id").alias("seq"), F.lit("[]").alias("raw")), "eval")
    one, none = F.array(F.lit("m1")), F.array().cast("array<string>")
    status = F.lit("success").alias("status")
    inventory = R.model_inventory(
        packs.select(F.when(F.substring("pack_id", 2, 20).cast("bigint") % 2 == 0, one).otherwise(none).alias("solver_models")),
        e.select(status, one.alias("solver_models"), none.alias("judge_models")),
    )
    return R.readiness(
        R.Profile(skill_modes=("s1",), eval_modes=("a", "b"), complete=False), packs=packs, examples=examples, heldout=held,
        skills=packs.limit(0).select("pack_id", F.lit("s1").alias("mode"), status, F.lit("# s").alias("skill_md")),
        evals={"main": (evals, "src0"), "extra": (evals, None)}, surrogate="extra", official=(evals.limit(0), None), inventory=inventory, schema_faults=[faults],
    )


@query("H8_source_coverage", """
    WITH d AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'unknown' ELSE source END AS source, lang, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 4 AS VARCHAR) END AS p, doc_id % 3 AS s FROM documents)
    SELECT source, 'source' AS facet, '' AS value, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT source, 'primary', p, count(*) FROM d WHERE p IS NOT NULL GROUP BY ALL
    UNION ALL SELECT source, 'secondary', CAST(s AS VARCHAR), count(*) FROM d GROUP BY ALL UNION ALL SELECT source, 'language', lang, count(*) FROM d GROUP BY ALL""")
def _(spark, sf):
    n = F.col("doc_id")
    rows = B.table(spark, sf, "documents").select(
        F.when(n % 50 == 0, "").otherwise(F.col("source")).alias("source"), F.when(n % 4 != 0, (n % 4).cast("string")).alias("primary"),
        (n % 3).cast("string").alias("secondary"), F.col("lang").alias("language"),
    )
    return R.source_domain_coverage(rows)


@query("H8_job_log_differences", with_tables("job generation_log", """,
    la AS (SELECT job_id, prompt_sha256, arg_max(status, seq) AS status FROM generation_log WHERE CAST(job_id AS INT) % 7 <> 0 GROUP BY ALL),
    jo AS (SELECT DISTINCT job_id, prompt_sha256 FROM job WHERE CAST(job_id AS INT) % 5 <> 0),
    b AS (SELECT coalesce(j.job_id, l.job_id) || '/' || coalesce(j.prompt_sha256, l.prompt_sha256) AS w, j.job_id IS NULL AS nj, l.job_id IS NULL AS nl, l.status
      FROM jo j FULL JOIN la l ON l.job_id = j.job_id AND l.prompt_sha256 = j.prompt_sha256)
    SELECT 'H8_job_without_log' AS rule_id, 'error' AS severity, w AS entity_id, '' AS detail FROM b WHERE nl
    UNION ALL SELECT 'H8_log_without_job', 'error', w, '' FROM b WHERE nj
    UNION ALL SELECT 'H8_latest_not_success', 'error', w, status FROM b WHERE NOT nl AND status <> 'success'"""))
def _(spark, sf):
    num = F.col("job_id").cast("int")
    return R.job_log_differences(B.job(spark, sf).filter(num % 5 != 0), B.generation_log(spark, sf).filter(num % 7 != 0))


@query("H8_cleaning_status", FLOW_SQL + """,
    s AS (SELECT (SELECT count(*) FROM o) AS packs, (SELECT count(*) FROM l WHERE train) AS t, (SELECT count(*) FROM fz) AS f,
        (SELECT count(*) FROM l WHERE train AND p % 73 <> 0) AS j),
    lf AS (SELECT 'j' || e || '/' || sha256('prompt ' || e) AS w, p % 73 <> 0 AND p % 83 <> 0 AS in_job, p % 83 <> 1 AS in_log, p % 89 = 0 AS bad FROM l WHERE train),
    all_v AS (SELECT * FROM v
      UNION ALL SELECT 'H8_expected_packs', 'error', '', 'expected 7, got ' || packs FROM s
      UNION ALL SELECT 'H8_expected_generation_jobs', 'error', '', 'expected 1, got ' || j FROM s
      UNION ALL SELECT 'H8_not_all_frozen', 'error', '', f || '/' || t FROM s
      UNION ALL SELECT 'H8_job_without_log', 'error', w, '' FROM lf WHERE in_job AND NOT in_log
      UNION ALL SELECT 'H8_job_without_log', 'error', 'j' || e || '/bad', '' FROM l WHERE train AND p % 73 <> 0 AND p % 83 = 0
      UNION ALL SELECT 'H8_log_without_job', 'error', w, '' FROM lf WHERE NOT in_job AND in_log
      UNION ALL SELECT 'H8_latest_not_success', 'error', w, 'error' FROM lf WHERE in_log AND bad
      UNION ALL SELECT 'H8_audit_source', 'error', source, 'src1' FROM (SELECT DISTINCT source FROM documents) WHERE source IN ('src2', 'src3')
      UNION ALL SELECT 'H8_audit_few_success', 'error', source, count(*) FILTER (doc_id % 3 > 0) || ' < ' || 1000000 FROM documents WHERE source = 'src3' GROUP BY source
      UNION ALL SELECT 'H8_audit_non_success', 'error', source, '' FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 3 = 0) WHERE source IN ('src1', 'src2', 'src3'))
    SELECT rule_id, severity, count(*) AS n, min(entity_id) AS first_entity, max(detail) AS last_detail FROM all_v GROUP BY ALL""")
def _(spark, sf):
    t = flow_tables(spark, sf)
    audits = B.table(spark, sf, "documents").select(
        F.col("source").alias("path"), "source", F.when(F.col("doc_id") % 3 == 0, "model_error").otherwise("success").alias("status")
    )
    specs = B.table(spark, sf, "documents").select(F.col("source").alias("path")).distinct().filter("path in ('src1', 'src2', 'src3')").select(
        "path", F.lit("src1").alias("source"), F.when(F.col("path") == "src3", 1000000).otherwise(1).alias("min_success")
    )
    faults = R.cleaning_status(
        flow=X.audit_flow(t), packs=t.packs, examples=t.examples, heldout=t.heldout, jobs=t.jobs, log=t.log,
        expected={"packs": 7, "generation_jobs": 1}, required_audits=(audits, specs),
    )
    return tidy(faults.groupBy("rule_id", "severity").agg(
        F.count("*").alias("n"), F.min("entity_id").alias("first_entity"), F.max("detail").alias("last_detail")
    ))
