"""Registered queries: review threads and skill-induction steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.operators import induction as G
from evalweave.operators import threads as T
from evalweave.plans import bindings as B
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


# -- threads ------------------------------------------------------------------------------------


def review_inputs(spark, sf):
    c = B.table(spark, sf, "conversations")
    pr, t = F.col("conv_id"), F.col("turn")
    path = F.concat(F.lit("src/"), (t % 4).cast("string"), F.when(t % 3 == 0, "_test.py").otherwise(".py"))
    repo = F.concat(F.lit("org/r"), (pr % 3).cast("string"))
    comments = c.select(
        repo.alias("repo"), pr.alias("pr_number"), t.alias("comment_id"), path.alias("path"),
        F.when(t % 5 == 4, "LGTM, thanks").when(t % 7 == 3, "short").otherwise(F.col("text")).alias("body"),
        F.lit("@@").alias("diff_hunk"),
        F.when(pr % 29 != 0, F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), pr.cast("int")), "yyyy-MM-dd")).alias("merged_at"),
    )
    names = comments.filter("comment_id % 6 <> 5").select("repo", "pr_number", "path").distinct()
    n = B.table(spark, sf, "pages").count()
    pages = B.table(spark, sf, "pages").select(F.col("page_id").alias("p"), "html")
    num = F.regexp_extract("path", r"src/(\d)", 1).cast("int")
    files = names.withColumn("p", F.col("pr_number") % n).join(pages, "p").select(
        "repo", "pr_number", num.alias("pos"),
        F.when(F.col("pr_number") % 3 == 0, F.concat(F.lit("new/"), F.col("path"))).otherwise(F.col("path")).alias("filename"),
        F.when(F.col("pr_number") % 3 == 0, F.col("path")).alias("previous_filename"),
        F.when(F.col("pr_number") % 11 == 0, "").otherwise(
            F.concat(F.lit("@@ -1 +"), (F.col("pr_number") + 1).cast("string"), F.when(num % 2 == 0, ",3").otherwise(""), F.lit(" @@\n"), F.col("html"))
        ).alias("patch"),
    )
    # The same number can stand for a plain and a test file: keep positions distinct.
    files = files.withColumn("pos", F.col("pos") * 2 + F.when(F.coalesce("previous_filename", "filename").endswith("_test.py"), 1).otherwise(0))
    return comments, files


_TH = r"""
    WITH c AS (SELECT 'org/r' || (conv_id % 3) AS repo, conv_id AS pr, turn,
        'src/' || (turn % 4) || CASE WHEN turn % 3 = 0 THEN '_test.py' ELSE '.py' END AS path,
        CASE WHEN turn % 5 = 4 THEN 'LGTM, thanks' WHEN turn % 7 = 3 THEN 'short' ELSE text END AS body,
        CASE WHEN conv_id % 29 <> 0 THEN strftime(DATE '2020-01-01' + CAST(conv_id AS INT), '%Y-%m-%d') END AS merged_at FROM conversations),
    fl AS (SELECT DISTINCT repo, pr, path, CAST(regexp_extract(path, 'src/(\d)', 1) AS INT) AS num,
        CASE WHEN pr % 11 = 0 THEN '' ELSE '@@ -1 +' || (pr + 1) || CASE WHEN num % 2 = 0 THEN ',3' ELSE '' END || ' @@' || chr(10) || p.html END AS patch
      FROM c JOIN pages p ON p.page_id = c.pr % (SELECT count(*) FROM pages) WHERE turn % 6 <> 5),
    th AS (SELECT c.*, repo || '#' || pr || '/review_' || turn AS thread_id, fl.patch,
        CASE WHEN patch <> '' THEN pr + 1 END AS line_start, CASE WHEN patch <> '' THEN pr + 1 + CASE WHEN num % 2 = 0 THEN 3 ELSE 1 END END AS line_end
      FROM c JOIN fl USING (repo, pr, path)),
    cl AS (SELECT *, CASE WHEN contains(path, 'test') THEN 'tests' ELSE 'general' END AS cluster,
        CASE WHEN contains(lower(body), 'suggestion') THEN 'suggestion_block'
          WHEN contains(lower(body), 'rename') OR contains(lower(body), 'format') OR contains(lower(body), 'import') THEN 'mechanical_followup'
          WHEN contains(body, '?') OR len(list_filter(string_split_regex(body, '\s+'), lambda w: w <> '')) > 30 THEN 'discussion_resolution'
          ELSE 'code_owner_review' END AS kind,
        CASE WHEN contains(lower(body), 'internal') OR contains(lower(body), 'private') THEN 'private_or_ci'
          WHEN contains(lower(body), 'thanks') OR contains(lower(body), 'lgtm') THEN 'social' WHEN length(trim(body, ' ' || chr(10))) < 10 THEN 'short'
          WHEN length(patch) - length(replace(patch, chr(10), '')) > 200 THEN 'patch_too_large' WHEN trim(patch) = '' THEN 'no_patch' END AS drop_reason
      FROM th),
    ke AS (SELECT * FROM cl WHERE drop_reason IS NULL AND merged_at IS NOT NULL),
    pk AS (SELECT 'code_' || replace(repo, '/', '_') || '_' || cluster AS pack_id, CASE WHEN merged_at < '2020-02-15' THEN 'train' ELSE 'heldout' END AS role,
        replace(repo, '/', '_') AS safe, * FROM ke WHERE (repo, cluster) IN (SELECT (repo, cluster) FROM ke GROUP BY repo, cluster HAVING count(*) >= 3)),
    ex AS (SELECT pack_id, safe || '::' || role || '::' || thread_id AS example_id, role, repo || '#' || pr AS source_task_id,
        'Repository: ' || repo || chr(10) || 'File: ' || path || chr(10) || 'Review Comment:' || chr(10) || body || chr(10) || chr(10) ||
        'Original Code Context:' || chr(10) || '@@' || chr(10) AS task_input,
        CASE WHEN role = 'train' THEN substr(sha256(patch), 1, 16) END AS patch_sha256 FROM pk)"""


def _threads(spark, sf):
    return T.slice_threads(*review_inputs(spark, sf))


@query("I1_slice_threads", _TH + " SELECT thread_id, path, merged_at, line_start, line_end, md5(patch) AS patch_md5, md5(body) AS body_md5 FROM th")
def _(spark, sf):
    return _threads(spark, sf).select(
        "thread_id", "path", "merged_at", "line_start", "line_end", F.md5("accepted_change").alias("patch_md5"), F.md5("review_signal").alias("body_md5")
    )


@query("I2_classify_threads", _TH + """
    SELECT thread_id, CASE WHEN turn % 4 = 1 THEN 'human' ELSE kind END AS thread_kind, CASE WHEN turn % 4 = 1 THEN 'general' ELSE cluster END AS path_cluster,
      CASE WHEN turn % 4 = 1 THEN 0.9e0 ELSE 0.3e0 END AS confidence FROM cl""")
def _(spark, sf):
    t = _threads(spark, sf)
    labels = t.filter(F.regexp_extract("thread_id", r"_(\d+)$", 1).cast("int") % 4 == 1).select(
        "thread_id", F.lit("human").alias("thread_kind"), F.lit(None).cast("string").alias("path_cluster"), F.lit(0.9).alias("confidence")
    )
    return T.classify_threads(t, labels).select("thread_id", "thread_kind", "path_cluster", "confidence")


@query("I3_filter_threads", _TH + " SELECT thread_id, drop_reason FROM cl")
def _(spark, sf):
    return T.thread_drop_reason(_threads(spark, sf)).select("thread_id", "drop_reason")


def _examples(spark, sf):
    return T.temporal_examples(T.keep_threads(T.classify_threads(_threads(spark, sf))), cutoff="2020-02-15")


@query("I4_temporal_packs", _TH + " SELECT pack_id, example_id, role, source_task_id, md5(task_input) AS input_md5, patch_sha256 FROM ex")
def _(spark, sf):
    return _examples(spark, sf).select("pack_id", "example_id", "role", "source_task_id", F.md5("task_input").alias("input_md5"), "patch_sha256")


@query("I4_undated_threads", _TH + """
    SELECT 'I4_no_merged_at' AS rule_id, 'error' AS severity, thread_id AS entity_id, '' AS detail FROM th WHERE merged_at IS NULL""")
def _(spark, sf):
    return T.undated_threads(_threads(spark, sf))


@query("I5_pack_audit", _TH + """
    SELECT pack_id, count(*) FILTER (role = 'train') AS train, count(*) FILTER (role = 'heldout') AS heldout,
      count(*) FILTER (role = 'heldout') AS heldout_null, count(DISTINCT patch_sha256) AS distinct_patches FROM ex GROUP BY pack_id""")
def _(spark, sf):
    return T.temporal_audit(_examples(spark, sf))


# -- induction ----------------------------------------------------------------------------------


def votes(spark, sf):
    li = B.table(spark, sf, "lineitem")
    rule, who = F.col("l_partkey").alias("rule"), F.col("l_suppkey").alias("example_id")
    made = F.array_compact(F.array(F.when(F.col("l_quantity") > 10, "supported"), F.when(F.col("l_quantity") > 45, "contradicted")))
    return li.select(rule, who, F.explode_outer(made).alias("vote"))


@query("G1_rule_support", """
    WITH a AS (SELECT l_partkey AS rule, count(DISTINCT l_suppkey) FILTER (l_quantity > 10) AS s,
        count(DISTINCT l_suppkey) FILTER (l_quantity > 45) AS c, count(DISTINCT l_suppkey) AS t FROM lineitem GROUP BY 1)
    SELECT rule, s AS supporters, c AS contradictors, t AS total, greatest(0, s - c) AS effective, round(greatest(0, s - c) / t, 6) AS share,
      CASE WHEN greatest(0, s - c) / t >= 0.8 THEN 'required' WHEN greatest(0, s - c) / t >= 0.5 THEN 'optional' ELSE 'reject' END AS verdict
    FROM a WHERE s + c > 0""")
def _(spark, sf):
    return tidy(G.classify_rules(G.rule_support(votes(spark, sf))))


@query("G2_leave_one_out", """
    WITH e AS (SELECT CAST(conv_id AS VARCHAR) AS pack_id, conv_id || '-' || turn AS example_id, turn AS pos FROM conversations),
    p AS (SELECT pack_id, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 3)
    SELECT e.pack_id, v.example_id AS validation_example_id, e.pos, e.example_id
    FROM e JOIN p USING (pack_id) JOIN e v USING (pack_id) WHERE v.example_id <> e.example_id""")
def _(spark, sf):
    c = B.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("pack_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("example_id"), F.col("turn").alias("pos"),
    )
    return G.leave_one_out(c)


def lesson_rows(spark, sf):
    """Conversation turns as skill rows whose reports hold the turn text in several item shapes."""
    c = B.table(spark, sf, "conversations")
    t = F.col("turn")
    text = G.json_string(F.col("text"))
    ids = F.concat(F.lit('["e'), t.cast("string"), F.lit('","e'), (t - 1).cast("string"), F.lit('","e'), t.cast("string"), F.lit('"]'))
    item = (
        F.when(t % 4 == 0, text)
        .when(t % 4 == 1, F.concat(F.lit('{"rule":'), text, F.lit(',"supported_examples":'), ids, F.lit("}")))
        .when(t % 4 == 2, F.concat(F.lit('{"feature":"f","description":'), text, F.lit(',"example_id":"one"}')))
        .otherwise(F.concat(F.lit('{"z":1,"a":['), text, F.lit(",2]}")))
    )
    report = F.concat(F.lit('{"stable_features":['), item, F.lit('],"conflicts":['), item, F.lit(","), item, F.lit('],"outliers":null}'))
    features = F.concat(F.lit('[{"example_id":"x'), t.cast("string"), F.lit('","must_not_generalize":['), text, F.lit("]}]"))
    return c.select(
        F.col("conv_id").cast("string").alias("pack_id"), F.col("role").alias("mode"),
        F.when(t == 5, "induction_error").otherwise("success").alias("status"), report.alias("report"), features.alias("feature_reports"),
    )


_LESSON = r"""
    WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS pack_id, role AS mode, turn AS t, text, CAST(to_json(text) AS VARCHAR) AS j FROM conversations WHERE turn <> 5),
    it AS (SELECT *, CASE t % 4 WHEN 0 THEN trim(text, ' ' || chr(10)) WHEN 1 THEN trim(text, ' ' || chr(10))
          WHEN 2 THEN 'f: ' || trim(text, ' ' || chr(10)) ELSE '{"a": [' || j || ', 2], "z": 1}' END AS lesson,
        CASE t % 4 WHEN 1 THEN list_sort(['e' || t, 'e' || (t - 1)]) WHEN 2 THEN ['one'] ELSE ['x' || t] END AS ev FROM c),
    al AS (SELECT pack_id, mode, k AS lesson_kind, lesson, ev FROM it, (VALUES ('stable_feature'), ('conflict')) v(k)
      UNION ALL SELECT pack_id, mode, 'do_not_generalize', trim(text, ' ' || chr(10)), ['x' || t] FROM c),
    me AS (SELECT DISTINCT substr(sha256('{"evidence_examples": [' || array_to_string(list_transform(ev, lambda e: '"' || e || '"'), ', ') || '], "lesson": ' ||
        CAST(to_json(lesson) AS VARCHAR) || ', "lesson_kind": "' || lesson_kind || '", "mode": "' || mode || '", "pack_id": "' || pack_id || '"}'), 1, 24) AS memory_id,
      pack_id, mode, lesson_kind, lesson, array_to_string(ev, ',') AS evidence FROM al WHERE lesson <> '')"""


@query("G3_lessons", _LESSON + " SELECT memory_id, pack_id, mode, lesson_kind, md5(lesson) AS lesson_md5, evidence FROM me")
def _(spark, sf):
    out = G.lessons_from_skills(lesson_rows(spark, sf))
    return out.select("memory_id", "pack_id", "mode", "lesson_kind", F.md5("lesson").alias("lesson_md5"), F.array_join("evidence_examples", ",").alias("evidence"))


@query("G4_lesson_summary", _LESSON + " SELECT lesson_kind, pack_id, count(*) AS n FROM me GROUP BY GROUPING SETS ((lesson_kind), (pack_id))")
def _(spark, sf):
    return G.lesson_summary(G.lessons_from_skills(lesson_rows(spark, sf)))


def context_rows(spark, sf):
    n = F.col("doc_id")
    s = n.cast("string")
    rule = F.when(n % 3 == 0, F.concat(F.lit('{"rule":"r  '), s, F.lit('","support_count":4}'))).when(
        n % 3 == 1, F.concat(F.lit('{"rule":"r'), s, F.lit('","supporting_examples":["a","b"]}'))
    ).otherwise('"plain"')
    report = F.concat(
        F.lit('{"stable_features":'), F.to_json(F.transform(F.sequence(F.lit(1), (n % 11 + 1).cast("int")), lambda i: F.concat(F.lit("f"), i.cast("string")))),
        F.lit(',"candidate_rules":['), rule, F.lit(', {"x":1}],"conflicts":[{"feature":"g","reason":"why '), s, F.lit('"}],"outliers":[" "]}'),
    )
    reports = F.concat(
        F.lit('[{"basic_attributes":{"Main_topic":1,"b-c":2},"style_features":{"tone":1},"must_not_generalize":['),
        F.when(n % 2 == 0, '"x"').otherwise(""), F.lit(']},{"content_features":{"main topic":1,"k'), (n % 7).cast("string"), F.lit('":2}}]'),
    )
    return B.table(spark, sf, "documents").select(
        (n % 100).cast("string").alias("pack_id"), F.lit("m").alias("mode"), n.alias("seq"),
        F.when(n % 5 != 0, report).alias("report"), F.when(n % 4 != 0, reports).alias("feature_reports"),
    )


@query("G5_signature_items", """
    WITH l AS (SELECT doc_id % 100 AS p, max(doc_id) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1)
    SELECT CAST(p AS VARCHAR) AS pack_id, 'm' AS mode, 'stable_features' AS part, i AS rank, 'f' || i AS line FROM l, range(1, 9) r(i) WHERE i <= n % 11 + 1
    UNION ALL SELECT CAST(p AS VARCHAR), 'm', 'candidate_rules', 1, CASE n % 3 WHEN 0 THEN 'r ' || n || ' (support=4)' WHEN 1 THEN 'r' || n || ' (support=2)' ELSE 'plain' END FROM l
    UNION ALL SELECT CAST(p AS VARCHAR), 'm', 'conflicts', 1, 'g: why ' || n FROM l""")
def _(spark, sf):
    return tidy(G.signature_items(context_rows(spark, sf), limits={"stable_features": 8, "candidate_rules": 8, "conflicts": 4}))


@query("G5_anchor_context", """
    WITH l AS (SELECT doc_id % 100 AS p, max(doc_id) AS n FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1)
    SELECT CAST(p AS VARCHAR) AS pack_id, 'm' AS mode, '# Anchors' || chr(10) || chr(10) || '## Slots' || chr(10) || '- Main topic' || chr(10) || '- b c' ||
      CASE WHEN n % 2 = 0 THEN chr(10) || '- example-specific preservation constraints' ELSE '' END || chr(10) || '- k' || (n % 7) ||
      chr(10) || chr(10) || '## Styles' || chr(10) || '- tone' AS context FROM l""")
def _(spark, sf):
    items = G.anchor_slots(context_rows(spark, sf))
    return G.bullet_context(items, keys=["pack_id", "mode"], part="kind", line="value", titles={"slot": "Slots", "style": "Styles"}, header="# Anchors")


@query("G6_missing_modes", """
    WITH u AS (SELECT CAST(conv_id AS VARCHAR) AS pack_id, count(*) AS n FROM conversations GROUP BY 1),
    w AS (SELECT pack_id, unnest(['system', 'user']) AS mode FROM u UNION ALL SELECT pack_id, 'assistant' FROM u WHERE n >= 3)
    SELECT pack_id, mode FROM w ANTI JOIN (SELECT CAST(conv_id AS VARCHAR) AS pack_id, role AS mode FROM conversations WHERE turn % 3 <> 1 AND turn <> 2) USING (pack_id, mode)""")
def _(spark, sf):
    c = B.table(spark, sf, "conversations")
    rows = c.select(
        F.col("conv_id").cast("string").alias("pack_id"), F.col("role").alias("mode"),
        F.when(F.col("turn") % 3 == 1, "induction_error").otherwise("success").alias("status"),
        F.when(F.col("turn") == 2, "  ").otherwise(F.col("text")).alias("skill_md"),
    )
    return G.missing_modes(rows.groupBy("pack_id").agg(F.count("*").alias("n")), rows, modes=["system", "user"], deep_modes=["assistant"])


@query("G7_ledger_lookup", """
    WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
    l AS (SELECT CAST(user_id AS VARCHAR) AS pack_id, event_type AS stage, CASE WHEN k % 2 = 0 THEN CAST(k % 3 AS VARCHAR) ELSE '' END AS example_id,
        max(event_id) AS seq FROM e WHERE k % 5 <> 0 GROUP BY ALL)
    SELECT c.pack_id, c.stage, c.example_id, l.seq AS reused_seq, 'j' || l.seq AS reused FROM
      (SELECT DISTINCT CAST(user_id AS VARCHAR) AS pack_id, event_type AS stage, '1' AS example_id FROM e
       UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), event_type, '' FROM e) c LEFT JOIN l USING (pack_id, stage, example_id)""")
def _(spark, sf):
    e = B.table(spark, sf, "events").withColumn("k", B._k())
    none = F.lit(None).cast("string")
    key = [F.col("user_id").cast("string").alias("pack_id"), F.col("event_type").alias("stage")]
    rest = [none.alias("validation_example_id"), F.lit("p").alias("prompt_sha256"), F.lit("c").alias("config_sha256")]
    ledger = e.select(
        *key, F.when(F.col("k") % 2 == 0, (F.col("k") % 3).cast("string")).alias("example_id"), *rest, F.col("event_id").alias("seq"),
        F.when(F.col("k") % 5 == 0, "error").otherwise("success").alias("status"), F.concat(F.lit("j"), F.col("event_id").cast("string")).alias("parsed_json"),
    )
    calls = e.select(*key).distinct().select("*", F.explode(F.array(F.lit("1"), none)).alias("example_id"), *rest)
    return G.ledger_lookup(calls, ledger).select("pack_id", "stage", "example_id", "reused_seq", "reused")


@query("G8_solver_model", """
    SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN 'late' END AS solver_model FROM conversations""")
def _(spark, sf):
    t = F.col("turn")
    calls = F.when(t % 3 == 0, F.array(F.lit(None).cast("string"), F.lit(" "), F.col("role"), F.lit("late"))).when(
        t % 3 == 1, F.array(F.lit(""), F.lit("late"))
    ).otherwise(F.array(F.lit("  ")))
    return B.table(spark, sf, "conversations").select("conv_id", "turn", G.first_call_model(calls).alias("solver_model"))
