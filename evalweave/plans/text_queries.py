"""Registered queries of the text and contamination family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions.patterns import PRIVATE_LEAK_PATTERNS, pattern_hits, text_content_grams
from evalweave.operators import contamination as C
from evalweave.operators import responses as R
from evalweave.operators import text as T
from evalweave.plans import bindings as B
from evalweave.plans.log_queries import leak_sql
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


_NAMED = ", ".join(f"CASE WHEN {found} THEN 'p{i}' END" for i, found in enumerate(leak_sql("t")))


@query("E1_private_leaks", f"""
    SELECT * FROM (SELECT doc_id, concat_ws(' && ', {_NAMED}) AS hits
      FROM (SELECT doc_id, {B.planted_sql("text", "doc_id")} AS t FROM documents)) WHERE hits <> ''""")
def _(spark, sf):
    text = B.planted(F.col("text"), F.col("doc_id"))
    docs = B.wide_table(spark, sf, "documents").select("doc_id", pattern_hits(text).alias("found"))
    names = F.create_map(*[F.lit(x) for i, p in enumerate(PRIVATE_LEAK_PATTERNS) for x in (p, f"p{i}")])
    return docs.filter(F.size("found") > 0).select("doc_id", F.array_join(F.transform("found", lambda p: names[p]), " && ").alias("hits"))


_PAYLOAD = """'{"id":' || event_id || ',"note":{"judge_hint":1,"items":[{"k":1},{"private_k":' || props || '}]},"' ||
      CASE WHEN event_id % 3 = 0 THEN 'judge' ELSE 'grade' END || '":{"statistics":[' || props || ']}}'"""


@query("E2_private_key_paths", f"""
    WITH p AS (SELECT event_id, CAST({_PAYLOAD} AS JSON) AS j FROM events)
    SELECT event_id, regexp_replace(t.path || '.' || t.key, '"', '', 'g') AS path
    FROM p, json_tree(p.j) t
    WHERE t.key IN ('supervision', 'judge', 'statistics') OR t.key LIKE 'private\\_%' ESCAPE '\\'""")
def _(spark, sf):
    e = B.wide_table(spark, sf, "events")
    name = F.when(F.col("event_id") % 3 == 0, "judge").otherwise("grade")
    payload = F.concat(
        F.lit('{"id":'), F.col("event_id").cast("string"),
        F.lit(',"note":{"judge_hint":1,"items":[{"k":1},{"private_k":'), F.col("props"),
        F.lit('}]},"'), name, F.lit('":{"statistics":['), F.col("props"), F.lit("]}}"),
    )
    return T.private_key_paths(e.select("event_id", payload.alias("payload")), "payload", ["event_id"])


TOK = r"'[A-Za-z][A-Za-z0-9_+-]*|[0-9]+(?:\.[0-9]+)?|[\x{4e00}-\x{9fff}]'"
STOP = "['a','an','and','are','as','be','by','for','from','in','is','it','of','on','or','that','the','this','to','with']"


# Tokens first, in a CTE of their own, so that they are computed once per text.
def grams_of(source: str, keys: str, text: str, n: int = 3) -> str:
    return f"""(SELECT {keys}, list_transform(list_filter(list_transform(range(1, len(toks) - {n - 2}),
        lambda i: toks[i:i + {n - 1}]), lambda g: len(list_filter(g, lambda t: NOT list_contains({STOP}, t))) > 0),
        lambda g: array_to_string(g, ' ')) AS grams
      FROM (SELECT {keys}, list_transform(regexp_extract_all({text}, {TOK}), lambda t: lower(t)) AS toks FROM {source}))"""


@query("E3_text_ngrams", f"""
    SELECT item_id, gram, count(*) AS n FROM
      (SELECT item_id, unnest(grams) AS gram FROM {grams_of('benchmark', 'item_id', 'text')}) GROUP BY ALL""")
def _(spark, sf):
    items = B.table(spark, sf, "benchmark")
    every = items.select("item_id", F.explode(text_content_grams(F.col("text"), 3)).alias("gram"))
    return every.groupBy("item_id", "gram").agg(F.count("*").alias("n"))


@query("E3_distinct_ngrams", f"""
    SELECT doc_id, count(DISTINCT gram) AS n FROM
      (SELECT doc_id, unnest(grams) AS gram FROM {grams_of('documents', 'doc_id', 'text')}) GROUP BY ALL""")
def _(spark, sf):
    docs = B.wide_table(spark, sf, "documents")
    return C.text_grams(docs, ["doc_id"], 3).groupBy("doc_id").agg(F.count("*").alias("n"))


def contamination_inputs(spark, sf):
    docs = B.wide_table(spark, sf, "documents").select(
        F.col("source").alias("pack_id"),
        (F.col("doc_id") % 5).cast("string").alias("task_id"),
        F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("mode"),
        F.col("doc_id").alias("seq"),
        F.when(F.col("doc_id") % 10 == 9, "model_error").otherwise("success").alias("status"),
        "text",
    )
    train = (
        B.table(spark, sf, "benchmark")
        .filter(F.col("item_id") % 20 < 18)
        .select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("pack_id"), F.col("item_id").alias("pos"), "text")
    )
    held = (
        B.table(spark, sf, "conversations")
        .filter(F.col("role") == "user")
        .select(
            F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("pack_id"),
            F.floor(F.col("conv_id") / 20).cast("long").alias("n"),
            (F.col("conv_id") * 100 + F.col("turn")).alias("pos"),
            "text",
        )
        .select("pack_id", (F.col("n") % 5).cast("string").alias("task_id"), "pos", "text")
    )
    return docs, train, held


_CONT = f"""
    WITH cand AS (SELECT source AS pack_id, CAST(doc_id % 5 AS VARCHAR) AS task_id, 'm' || (doc_id % 3) AS mode,
        doc_id AS seq, text FROM documents WHERE doc_id % 10 <> 9),
    tr AS (SELECT 'src' || (item_id % 20) AS pack_id, string_agg(text, chr(10) ORDER BY item_id) AS text
      FROM benchmark WHERE item_id % 20 < 18 GROUP BY 1),
    he AS (SELECT 'src' || (conv_id % 20) AS pack_id, CAST((conv_id // 20) % 5 AS VARCHAR) AS task_id,
        string_agg(text, chr(10) ORDER BY conv_id, turn) AS text
      FROM conversations WHERE role = 'user' GROUP BY 1, 2),
    known AS (SELECT * FROM cand WHERE pack_id IN (SELECT pack_id FROM tr)),
    cg AS (SELECT seq, pack_id, task_id, mode, gram, count(*) AS c FROM
      (SELECT seq, pack_id, task_id, mode, unnest(grams) AS gram FROM {grams_of('known', 'seq, pack_id, task_id, mode', 'text')}) GROUP BY ALL),
    tg AS (SELECT DISTINCT pack_id, unnest(grams) AS gram FROM {grams_of('tr', 'pack_id', 'text')}),
    hg AS (SELECT DISTINCT pack_id, task_id, unnest(grams) AS gram FROM {grams_of('he', 'pack_id, task_id', 'text')}),
    m AS (SELECT * FROM cg SEMI JOIN tg USING (pack_id, gram) ANTI JOIN hg USING (pack_id, task_id, gram)),
    r AS (SELECT k.seq, k.pack_id, k.task_id, k.mode,
        (SELECT count(*) FROM tg WHERE tg.pack_id = k.pack_id) AS train_grams,
        (SELECT count(*) FROM hg WHERE hg.pack_id = k.pack_id AND hg.task_id = k.task_id) AS heldout_grams,
        coalesce(cs.n, 0) AS candidate_grams, coalesce(ms.n, 0) AS suspicious,
        coalesce(coalesce(ms.n, 0) / cs.n, 0) AS rate
      FROM known k LEFT JOIN (SELECT seq, count(*) AS n FROM cg GROUP BY seq) cs USING (seq)
        LEFT JOIN (SELECT seq, count(*) AS n FROM m GROUP BY seq) ms USING (seq)),
    b AS (SELECT pack_id, task_id, arg_max(suspicious, seq) AS base FROM r WHERE mode = 'm0' GROUP BY ALL),
    x AS (SELECT r.*, b.base, r.suspicious - b.base AS excess FROM r LEFT JOIN b USING (pack_id, task_id))"""


@query("E4_contamination_rows", _CONT + """
    SELECT seq, pack_id, task_id, mode, train_grams, heldout_grams, candidate_grams, suspicious,
      round(rate, 6) AS suspicious_rate, base AS baseline_suspicious, excess FROM x""")
def contamination_query(spark, sf):
    rows, _ = C.contamination_rows(*contamination_inputs(spark, sf), baseline_mode="m0")
    return tidy(rows)


@query("E4_top_matches", _CONT + """
    SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY c DESC, gram) AS rank, gram AS phrase, c AS candidate_count
    FROM m QUALIFY rank <= 20""")
def _(spark, sf):
    _, matches = C.contamination_rows(*contamination_inputs(spark, sf), baseline_mode="m0")
    return tidy(C.top_matches(matches, top_k=20))


@query("E5_excess_vs_baseline", _CONT + " SELECT seq, mode, base AS baseline_suspicious, excess FROM x WHERE suspicious > 0 OR base > 0")
def _(spark, sf):
    rows, _ = C.contamination_rows(*contamination_inputs(spark, sf), baseline_mode="m0")
    return rows.filter("suspicious > 0 or baseline_suspicious > 0").select("seq", "mode", "baseline_suspicious", "excess")


@query("E6_contamination_summary", _CONT + """
    SELECT mode, count(*) AS n, round(avg(suspicious), 6) AS mean_suspicious, round(avg(rate), 6) AS mean_rate,
      round(avg(excess), 6) AS mean_excess FROM x GROUP BY mode""")
def _(spark, sf):
    rows, _ = C.contamination_rows(*contamination_inputs(spark, sf), baseline_mode="m0")
    return tidy(C.contamination_summary(rows))


# In RE2 a word border is ASCII: with accented letters read as `_`, a word character that no
# pattern matches, it agrees with the Unicode-aware border.
FLAT = r"regexp_replace({t}, '[\x{{00aa}}\x{{00b5}}\x{{00ba}}\x{{00c0}}-\x{{024f}}]', '_', 'g')"
LITERAL_SQL = [
    r"\b\d{4}[-/年]\d{1,2}(?:[-/月]\d{1,2}日?)?\b",
    r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b",
    r"\b\d+(?:\.\d+)?%\b",
    r"\b\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?){1,4}\b",
    r"\b\d+(?:\.\d+)?\s*(?:元|万元|亿元|USD|RMB|dollars?|slides?|pages?)\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"\b(?:[A-Z][A-Za-z0-9&.-]+(?:\s+|[-:])){2,}[A-Z][A-Za-z0-9&.-]+\b",
]


def literal_inputs(spark, sf):
    docs = B.wide_table(spark, sf, "documents")
    train = docs.filter(F.col("doc_id") % 3 == 0).select(
        F.col("source").alias("pack_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("example_id"),
        F.lit(None).cast("string").alias("source_task_id"),
        F.col("text").alias("task_input"),
        F.lit(None).cast("string").alias("output"),
        F.array(F.concat(F.lit("raw/"), F.col("lang"))).alias("material_paths"),
    )
    made = docs.filter(F.col("doc_id") % 3 != 0).select(
        F.col("source").alias("pack_id"), "doc_id", F.to_json(F.array("text")).alias("haystack")
    )
    return T.train_literals(train), made


_LIT = """
    WITH src AS (SELECT source AS pack_id, doc_id, lang, """ + FLAT.format(t="text") + """ AS flat FROM documents WHERE doc_id % 3 = 0),
    raw AS (""" + " UNION ALL ".join(
    f"SELECT pack_id, unnest(regexp_extract_all(flat, '{p}')) AS m FROM src" for p in LITERAL_SQL
) + r"""
      UNION ALL SELECT source, unnest(regexp_extract_all(text, 'https?://[^\s)]+')) FROM documents WHERE doc_id % 3 = 0
      UNION ALL SELECT source, unnest(regexp_extract_all(text, '(?:^|[\s"''`])(?:data|artifacts|runs|notes|docs|src|scripts|/Users)/[^\s"''`)]+')) FROM documents WHERE doc_id % 3 = 0),
    lit AS (SELECT DISTINCT pack_id, literal FROM (
        SELECT pack_id, trim(m, ' ' || chr(9) || chr(10) || '"''`.,;:()[]{}') AS literal FROM raw
        UNION ALL SELECT pack_id, 'doc-' || doc_id FROM src UNION ALL SELECT pack_id, 'raw/' || lang FROM src)
      WHERE length(literal) >= 3)"""


@query("E7_train_literals", _LIT + " SELECT pack_id, literal FROM lit")
def _(spark, sf):
    return literal_inputs(spark, sf)[0]


@query("E7_literal_leakage", _LIT + """,
    made AS (SELECT source AS pack_id, doc_id, CAST(to_json([text]) AS VARCHAR) AS haystack FROM documents WHERE doc_id % 3 <> 0),
    hit AS (SELECT m.pack_id, m.doc_id, l.literal FROM made m JOIN lit l ON l.pack_id = m.pack_id AND contains(m.haystack, l.literal))
    SELECT m.pack_id, m.doc_id, (SELECT count(*) FROM lit WHERE lit.pack_id = m.pack_id) AS candidate_literal_count,
      count(h.literal) AS matched_literal_count,
      coalesce(array_to_string(list_sort(list(h.literal) FILTER (h.literal IS NOT NULL)), ' | '), '') AS matched_literals,
      count(h.literal) > 0 AS has_literal_leakage
    FROM made m LEFT JOIN hit h ON h.doc_id = m.doc_id GROUP BY ALL""")
def _(spark, sf):
    train, made = literal_inputs(spark, sf)
    out = T.literal_leakage(made, train, keys=["doc_id"])
    return out.withColumn("matched_literals", F.array_join("matched_literals", " | "))


_KINDS = [
    ("number", FLAT.format(t="text"), r"\b\d+(?:[.,:/-]\d+)*(?:%|[A-Za-z]+)?\b", 0, 1),
    ("quoted", "text", r"[\"''“”‘’《》](.*?)[\"''“”‘’《》]", 1, 1),
    ("capitalised", FLAT.format(t="text"), r"\b(?:[A-Z][A-Za-z0-9&+.-]*)(?:\s+[A-Z][A-Za-z0-9&+.-]*){0,5}\b", 0, 2),
]


@query("E8_evidence_inventory", " UNION ALL ".join(
    f"""SELECT doc_id, '{kind}' AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS rank, v AS value FROM
      (SELECT doc_id, min(p) AS p, arg_min(v, p) AS v FROM
        (SELECT doc_id, generate_subscripts(ms, 1) AS p, trim(unnest(ms), ' ' || chr(10) || chr(9)) AS v FROM
          (SELECT doc_id, regexp_extract_all({text}, '{pattern}', {group}) AS ms FROM documents))
        WHERE length(v) >= {least} GROUP BY doc_id, lower(v)) """
    for kind, text, pattern, group, least in _KINDS
))
def _(spark, sf):
    docs = B.wide_table(spark, sf, "documents")
    return tidy(T.evidence_inventory(docs, keys=["doc_id"]))


@query("E9_text_stats", r"""
    SELECT doc_id, sha256(text) AS sha256, length(text) AS chars,
      len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS words,
      length(text) - length(regexp_replace(text, '[\x{4e00}-\x{9fff}]', '', 'g')) AS cjk_chars,
      md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '...[truncated]' ELSE text END) AS preview_md5,
      md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || chr(10) || '[TRUNCATED after 500 chars]' ELSE text END) AS evidence_md5
    FROM documents""")
def _(spark, sf):
    docs = B.wide_table(spark, sf, "documents").withColumn("s", T.text_stats("text"))
    return docs.select(
        "doc_id", "s.*",
        F.md5(T.truncate_preview("text", 500)).alias("preview_md5"),
        F.md5(T.truncate_evidence("text", 500)).alias("evidence_md5"),
    )


def skill_md(text: str = "text"):
    """Documents written as rule lists; the headings depend on ``doc_id % 3``."""
    head = (
        F.when(F.col("doc_id") % 3 == 0, "## Required rules")
        .when(F.col("doc_id") % 3 == 1, "### Optional Rules:")
        .otherwise("# Do not generalize")
    )
    body = F.replace(F.col(text), F.lit(". "), F.lit("\n- "))
    return F.concat(
        F.lit("# Title\n- stray\n"), head, F.lit("\n- "), body,
        F.when(F.col("doc_id") % 2 == 0, F.lit("\n## Optional rules\n1. one\n2) two\n* [x] three")).otherwise(F.lit("\n## Notes\n- x")),
    )


SKILL_MD_SQL = """('# Title' || chr(10) || '- stray' || chr(10) ||
    CASE doc_id % 3 WHEN 0 THEN '## Required rules' WHEN 1 THEN '### Optional Rules:' ELSE '# Do not generalize' END ||
    chr(10) || '- ' || replace(text, '. ', chr(10) || '- ') ||
    CASE WHEN doc_id % 2 = 0 THEN chr(10) || '## Optional rules' || chr(10) || '1. one' || chr(10) || '2) two' || chr(10) || '* [x] three'
      ELSE chr(10) || '## Notes' || chr(10) || '- x' END)"""

SECTION_SQL = f"""
    lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS p, rtrim(unnest(ls)) AS line FROM
      (SELECT doc_id, string_split({SKILL_MD_SQL}, chr(10)) AS ls FROM documents)),
    marked AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+') THEN
        CASE WHEN contains(lower(line), 'required') AND contains(lower(line), 'rule') THEN 'required_rules'
          WHEN contains(lower(line), 'optional') AND contains(lower(line), 'rule') THEN 'optional_rules'
          WHEN contains(lower(line), 'do not generalize') OR contains(lower(line), 'do-not-generalize') THEN 'do_not_generalize_rules'
          ELSE 'none' END END AS key FROM lines),
    carried AS (SELECT *, last_value(key IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p) AS cur,
        key IS NULL AND regexp_matches(trim(line), '^([-*+]|[0-9]+[.)])\\s+') AS rule FROM marked),
    sections AS (SELECT doc_id, count(*) FILTER (rule AND cur = 'required_rules') AS required_rules,
        count(*) FILTER (rule AND cur = 'optional_rules') AS optional_rules,
        count(*) FILTER (rule AND cur = 'do_not_generalize_rules') AS do_not_generalize_rules
      FROM carried GROUP BY doc_id)"""


@query("E10_section_rules", "WITH " + SECTION_SQL + " SELECT * FROM sections")
def _(spark, sf):
    docs = B.wide_table(spark, sf, "documents")
    return docs.select("doc_id", T.section_rule_counts(skill_md()).alias("s")).select("doc_id", "s.*")


@query("E11_strip_reasoning", """
    WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'plan' || '</think>' || chr(10) || chr(10) || text ELSE text END AS t FROM documents)
    SELECT doc_id, md5(CASE WHEN instr(t, '</think>' || chr(10) || chr(10)) > 0
      THEN substr(t, instr(t, '</think>' || chr(10) || chr(10)) + 10) ELSE t END) AS text_md5 FROM t""")
def _(spark, sf):
    docs = B.wide_table(spark, sf, "documents")
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("plan" + T.REASONING_END), F.col("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", F.md5(T.strip_reasoning(t)).alias("text_md5"))


def responses(spark, sf):
    """Judge answers written from the events: bare, fenced, wrapped in words, and broken ones."""
    e = B.wide_table(spark, sf, "events").withColumn("k", B._k())
    k = F.col("k")
    score = (
        F.when(k % 10 == 3, "true").when(k % 10 == 4, F.concat(F.lit('"'), (k % 12).cast("string"), F.lit('"')))
        .when(k % 10 == 5, "7.5").otherwise((k % 13).cast("string"))
    )
    reason = F.when(k % 11 == 0, "null").otherwise('"r"')
    obj = F.concat(F.lit('{"score": '), score, F.lit(', "reason": '), reason, F.lit("}"))
    wrapped = (
        F.when(k % 6 == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
        .when(k % 6 == 1, F.concat(F.lit("Score: "), obj, F.lit(" done")))
        .when(k % 6 == 2, F.concat(F.lit("["), obj, F.lit("]")))
        .when(k % 6 == 3, F.lit("no json here"))
        .otherwise(obj)
    )
    return e.select("event_id", wrapped.alias("text"))


@query("E12_criterion_scores", """
    WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
    s AS (SELECT *, CASE WHEN k % 10 IN (3, 5) THEN NULL WHEN k % 10 = 4 THEN k % 12 ELSE k % 13 END AS score FROM e)
    SELECT event_id, CASE WHEN k % 6 NOT IN (2, 3) THEN CAST(score AS BIGINT) END AS score,
      CASE WHEN k % 6 = 3 THEN 'no_json_object_found' WHEN k % 6 = 2 THEN 'json_root_is_not_object'
        WHEN k % 10 = 3 THEN 'score_must_be_integer_1_to_10' WHEN k % 11 = 0 THEN 'reason_must_be_string'
        WHEN score IS NULL OR score NOT BETWEEN 1 AND 10 THEN 'score_must_be_integer_1_to_10' END AS parse_error
    FROM s""")
def _(spark, sf):
    return R.criterion_scores(responses(spark, sf)).select("event_id", "score", "parse_error")


@query("E12_overall_scores", """
    WITH e AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
    SELECT event_id, CASE k % 4 WHEN 0 THEN CAST(k % 10 AS DOUBLE) WHEN 1 THEN CAST(k % 10 AS DOUBLE) + 0.5 END AS overall_score,
      CASE WHEN k % 5 = 4 AND k % 4 = 3 THEN 'no_json_object_found' END AS parse_error FROM e""")
def _(spark, sf):
    e = B.wide_table(spark, sf, "events").withColumn("k", B._k())
    k = F.col("k")
    n = (k % 10).cast("string")
    value = (
        F.when(k % 4 == 0, n).when(k % 4 == 1, F.concat(F.lit('"'), n, F.lit('.5"')))
        .when(k % 4 == 2, "true").otherwise('"high"')
    )
    obj = F.concat(F.lit('Result ```json {"overall_score": '), value, F.lit("} ``` end"))
    text = F.when((k % 5 == 4) & (k % 4 == 3), F.lit("{broken")).otherwise(obj)
    out = R.parse_object(e.select("event_id", text.alias("text")))
    return out.select("event_id", R.overall_score(F.col("report")).alias("overall_score"), "parse_error")


def reports(spark, sf, body):
    """Judge reports written from the events, every seventh of them no JSON at all."""
    e = B.wide_table(spark, sf, "events").withColumn("k", B._k())
    text = F.when(F.col("k") % 7 == 6, "no json here").otherwise(F.concat(F.lit("Report: "), body(F.col("k")), F.lit(" end")))
    return e.select("event_id", "k", text.alias("text"))


def _object(fields) -> F.Column:
    """A JSON object text from names and column expressions of JSON values."""
    parts = [F.concat(F.lit(f'"{name}": '), value if isinstance(value, F.Column) else F.lit(value)) for name, value in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


_E = "WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


@query("E12_pattern_reports", _E + """
    SELECT event_id, CASE WHEN k % 7 = 6 THEN 'no_json_object_found' WHEN k % 13 NOT BETWEEN 1 AND 10 THEN 'pattern_similarity_score_must_be_number_1_to_10'
        WHEN k % 11 = 0 THEN 'style_similarity_score_must_be_number_1_to_10' WHEN k % 5 = 3 THEN 'unsupported_pattern_risk_must_be_low_medium_or_high'
        WHEN k % 3 = 2 THEN 'missed_patterns_must_be_list' END AS parse_error,
      CASE WHEN k % 7 <> 6 THEN CAST(k % 13 AS DOUBLE) END AS pattern_similarity_score,
      CASE WHEN k % 7 <> 6 THEN CASE k % 5 WHEN 3 THEN 'none' ELSE 'medium' END END AS risk FROM e""")
def _(spark, sf):
    def body(k):
        scores = dict.fromkeys(R.PATTERN_SCORES, "5") | {"pattern_similarity_score": (k % 13).cast("string"), "style_similarity_score": F.when(k % 11 == 0, "true").otherwise("7.5")}
        risk = F.when(k % 5 == 3, '"none"').otherwise('"medium"')
        return _object(scores | {"unsupported_pattern_risk": risk} | dict.fromkeys(R.PATTERN_LISTS, "[]") | {"missed_patterns": F.when(k % 3 == 2, '"x"').otherwise('["x"]')})

    out = R.pattern_reports(reports(spark, sf, body))
    return out.select("event_id", "parse_error", "pattern_similarity_score", F.col("unsupported_pattern_risk").alias("risk"))


@query("E12_grounding_reports", _E + """
    SELECT event_id, CASE WHEN k % 7 = 6 THEN 'no_json_object_found' ELSE nullif(concat_ws(';',
        CASE WHEN k % 5 = 4 THEN 'grounding_score_not_numeric' WHEN k % 13 NOT BETWEEN 1 AND 10 THEN 'grounding_score_out_of_range' END,
        CASE WHEN k % 11 NOT BETWEEN 1 AND 10 THEN 'hallucination_risk_out_of_range' END,
        CASE WHEN k % 3 = 1 THEN 'unsupported_claim_count_not_integer' WHEN k % 6 = 0 THEN 'unsupported_claim_count_negative' END,
        CASE WHEN k % 2 = 1 THEN 'unsupported_claims_not_list' END), '') END AS parse_error,
      CASE WHEN k % 7 <> 6 AND k % 5 <> 4 THEN CAST(k % 13 AS DOUBLE) END AS grounding_score,
      CASE WHEN k % 7 <> 6 AND k % 3 <> 1 THEN CAST(CASE WHEN k % 6 = 0 THEN -1 ELSE k % 4 END AS BIGINT) END AS unsupported_claim_count FROM e""")
def _(spark, sf):
    def body(k):
        return _object({
            "grounding_score": F.when(k % 5 == 4, '"high"').otherwise((k % 13).cast("string")), "hallucination_risk": (k % 11).cast("string"),
            "unsupported_claim_count": F.when(k % 3 == 1, "1.5").when(k % 6 == 0, "-1").otherwise((k % 4).cast("string")),
            "unsupported_claims": F.when(k % 2 == 1, "{}").otherwise('["c"]'),
        })

    out = R.grounding_reports(reports(spark, sf, body))
    return out.select("event_id", "parse_error", "grounding_score", "unsupported_claim_count")


@query("E12_consistency_reports", _E + """,
    f AS (SELECT *, list_sort(list_filter([CASE WHEN k % 7 = 6 THEN 'no_json_object_found' END,
        CASE WHEN k % 13 > 10 THEN 'leakage_penalty_must_be_number_0_to_10' END, CASE WHEN k % 5 = 2 THEN 'matched_constraints_must_be_list' END,
        CASE WHEN k % 3 = 0 THEN 'rationale_must_be_string' END], lambda x: x IS NOT NULL)) AS errors FROM e)
    SELECT event_id, CASE WHEN k % 7 = 6 THEN 'no_json_object_found' WHEN k % 13 > 10 THEN 'leakage_penalty_must_be_number_0_to_10'
        WHEN k % 5 = 2 THEN 'matched_constraints_must_be_list' WHEN k % 3 = 0 THEN 'rationale_must_be_string' END AS parse_error,
      CASE WHEN k % 7 = 6 THEN 'judge_report_must_be_object' ELSE array_to_string(errors, ',') END AS errors,
      CASE WHEN k % 7 <> 6 THEN CAST(k % 13 AS DOUBLE) END AS leakage_penalty FROM f""")
def _(spark, sf):
    def body(k):
        scores = dict.fromkeys(R.CONSISTENCY_SCORES, "4") | {"leakage_penalty": (k % 13).cast("string")}
        lists = dict.fromkeys(R.CONSISTENCY_LISTS, "[]") | {"matched_constraints": F.when(k % 5 == 2, "null").otherwise('["m"]')}
        return _object(scores | lists | {"rationale": F.when(k % 3 == 0, "[]").otherwise('"why"')})

    out = R.consistency_reports(reports(spark, sf, body))
    return out.select("event_id", "parse_error", F.array_join("errors", ",").alias("errors"), "leakage_penalty")


@query("E12_plan_errors", _E + """
    SELECT event_id, concat_ws(',', CASE WHEN k % 7 = 6 OR k % 5 = 1 THEN 'grounded_facts_not_list' END,
        CASE WHEN k % 7 = 6 THEN 'generic_scaffolding_not_list' END, CASE WHEN k % 7 = 6 THEN 'missing_specifics_not_list' WHEN k % 3 = 1 THEN 'missing_specifics_contains_non_string' END,
        CASE WHEN k % 7 = 6 THEN 'generation_constraints_not_list' WHEN k % 11 = 0 THEN 'generation_constraints_contains_non_string' END) AS errors FROM e""")
def _(spark, sf):
    def body(k):
        return _object({
            "grounded_facts": F.when(k % 5 == 1, '"f"').otherwise('["f"]'), "generic_scaffolding": "[]",
            "missing_specifics": F.when(k % 3 == 1, '["s", 3]').otherwise('["s"]'), "generation_constraints": F.when(k % 11 == 0, '["c", " "]').otherwise('["c"]'),
        })

    out = R.plan_errors(reports(spark, sf, body))
    return out.select("event_id", F.array_join("errors", ",").alias("errors"))


@query("E12_abstract_signatures", _E + """
    SELECT event_id, p AS pos, '{"n":' || (k + p) || '}' AS signature
    FROM e, (VALUES (0), (1), (2)) v(p) WHERE k % 7 <> 6 AND p < k % 4""")
def _(spark, sf):
    def body(k):
        item = lambda i: F.when(k % 4 > i, F.concat(F.lit('{"n":'), (k + i).cast("string"), F.lit("}")))
        return _object({"abstract_example_signatures": F.concat(F.lit('["no object", '), F.concat_ws(", ", item(0), item(1), F.lit("7"), item(2)), F.lit("]"))})

    out = R.abstract_signatures(reports(spark, sf, body), ["event_id"])
    return out.select("event_id", "pos", F.to_json("signature").alias("signature"))


def slide_rows(spark, sf):
    docs = B.wide_table(spark, sf, "documents")
    n = F.col("doc_id")
    body = F.regexp_replace(F.col("text"), "\n", "\n\nSlide 2: **next**\n")
    return docs.select(
        n.alias("seq"), F.col("source").alias("pack_id"), (n % 7).cast("string").alias("task_id"),
        F.concat(F.lit("m"), (n % 3).cast("string")).alias("mode"),
        F.when(n % 10 == 9, "model_error").otherwise("success").alias("status"),
        F.concat(F.lit("# Slide 1 - start\n"), body).alias("text"),
    )


@query("E13_pages", r"""
    WITH r AS (SELECT doc_id AS seq, source AS pack_id, CAST(doc_id % 7 AS VARCHAR) AS task_id, 'm' || (doc_id % 3) AS mode,
        '# Slide 1 - start' || chr(10) || replace(text, chr(10), chr(10) || chr(10) || 'Slide 2: **next**' || chr(10)) AS text
      FROM documents WHERE doc_id % 10 <> 9 AND doc_id % 3 < 2 AND doc_id % 7 < 6),
    l AS (SELECT seq, pack_id, task_id, mode, generate_subscripts(ls, 1) AS p, trim(unnest(ls)) AS line FROM
      (SELECT *, string_split(text, chr(10)) AS ls FROM r)),
    c AS (SELECT *, regexp_matches(line, '(?i)^\s*(?:#{1,3}\s*)?Slide\s+\d+\s*[:.-]?\s*(.*)$') AS h,
        row_number() OVER (PARTITION BY seq ORDER BY p) AS i FROM l WHERE line <> ''),
    g AS (SELECT *, 1 + sum(CASE WHEN h AND i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY p) AS page FROM c)
    SELECT seq, pack_id, task_id, mode, CAST(page AS BIGINT) AS page,
      md5(string_agg(trim(regexp_replace(regexp_replace(line, '[*_`]+', '', 'g'), '\s+', ' ', 'g')), chr(10) ORDER BY p)) AS page_md5
    FROM g GROUP BY ALL""")
def _(spark, sf):
    tasks = B.wide_table(spark, sf, "documents").filter(F.col("doc_id") % 7 < 6).select(
        F.col("source").alias("pack_id"), (F.col("doc_id") % 7).cast("string").alias("task_id")
    )
    pages = T.export_pages(slide_rows(spark, sf), tasks, modes=["m0", "m1"])
    return tidy(pages.withColumn("page_md5", F.md5("page_text")).drop("page_text"))
