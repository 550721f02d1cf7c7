"""Registered queries of the split and pack family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions.expr import slug
from evalweave.operators import packs as P
from evalweave.operators import scoring as S
from evalweave.operators import splits as X
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


def task_raw(spark, sf):
    """Documents as source tasks: ``source`` and ``lang`` are the two domain levels."""
    d = B.table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("source_id"),
        F.when(F.col("doc_id") % 50 != 0, F.col("source")).alias("domain1"),
        F.col("lang").alias("domain2"),
        F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y").alias("lang"),
        F.col("text").alias("task_input"),
        F.array("lang").alias("checklist"),
    )


_RAW = """raw AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, CASE WHEN doc_id % 50 <> 0 THEN source END AS domain1,
      lang AS domain2, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE 'y' END AS lang, text AS task_input FROM documents)"""


@query("B1_source_profile", f"""
    WITH {_RAW}, d AS (SELECT coalesce(domain1, 'unknown') || ' / ' || domain2 AS domain, lang FROM raw)
    SELECT 'rows' AS section, '' AS key, count(*) AS n FROM d
    UNION ALL SELECT 'domains', '', count(DISTINCT domain) FROM d
    UNION ALL SELECT 'language', lang, count(*) FROM d GROUP BY lang
    UNION ALL (SELECT 'top_domain', domain, count(*) FROM d GROUP BY domain ORDER BY 3 DESC, 2 LIMIT 10)""")
def _(spark, sf):
    return X.source_profile(task_raw(spark, sf))


@query("B2_canonical_tasks", f"""
    WITH {_RAW} SELECT 'docs' AS source, source_id, domain1 AS d1, domain2 AS d2, lang AS d3, md5(task_input) AS input_md5,
      '{{"type":"instance_specific_rubric","items":["' || domain2 || '"]}}' AS supervision,
      '{{"type":"score_1_to_10"}}' AS judge FROM raw""")
def _(spark, sf):
    t = X.canonical_tasks(task_raw(spark, sf), source="docs")
    return t.select(
        "source", "source_id", F.col("domain.primary").alias("d1"), F.col("domain.secondary").alias("d2"),
        F.col("domain.language").alias("d3"), F.md5("task_input").alias("input_md5"), "supervision", "judge",
    )


def grouped(spark, sf):
    bad = B.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("source_id"))
    return X.grouped_tasks(task_raw(spark, sf), known_bad=bad)


_GROUPED = _RAW + """,
    g AS (SELECT source_id, coalesce(domain1, 'unknown') AS domain1, domain2, lang, task_input FROM raw
      WHERE source_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)),
    sz AS (SELECT domain1, domain2, lang, count(*) AS size FROM g GROUP BY ALL),
    sel AS (SELECT *, row_number() OVER (ORDER BY size DESC, domain1, domain2, lang) AS group_rank
      FROM (SELECT * FROM sz WHERE size >= 5 ORDER BY size DESC, domain1, domain2, lang LIMIT 12)),
    m AS (SELECT g.*, sel.group_rank, row_number() OVER (PARTITION BY domain1, domain2, lang
        ORDER BY md5('7:' || source_id), source_id) AS n FROM g JOIN sel USING (domain1, domain2, lang)),
    st AS (SELECT replace('tasks::' || domain1 || '::' || domain2 || '::' || lang, ' ', '_') AS split_id, group_rank,
        CASE WHEN n <= 3 THEN 'train' ELSE 'heldout' END AS role, CASE WHEN n <= 3 THEN n - 1 ELSE n - 4 END AS pos,
        source_id, domain1, domain2, lang, task_input FROM m WHERE n <= 5)"""


@query("B3_group_sizes", f"WITH {_GROUPED} SELECT * FROM sz")
def _(spark, sf):
    return X.group_sizes(grouped(spark, sf))


def split_tasks(spark, sf):
    return X.few_shot_split(grouped(spark, sf), train_size=3, heldout_size=2, max_groups=12)


@query("B4_few_shot_split", f"WITH {_GROUPED} SELECT split_id, group_rank, role, pos, source_id, domain1 FROM st")
def _(spark, sf):
    return tidy(split_tasks(spark, sf).select("split_id", "group_rank", "role", "pos", "source_id", "domain1"))


@query("B5_group_selection", f"""
    WITH {_GROUPED} SELECT count(*) AS total_groups, count(*) FILTER (size >= 5) AS eligible_groups,
      least(count(*) FILTER (size >= 5), 12) AS selected_groups, count(*) FILTER (size < 5) AS skipped_too_small,
      count(*) FILTER (size >= 5) - least(count(*) FILTER (size >= 5), 12) AS truncated_by_max_groups,
      CAST(5 AS BIGINT) AS minimum_group_size, CAST(12 AS BIGINT) AS max_groups,
      array_to_string(list_sort(list(size), 'DESC')[1:10], ',') AS largest_group_sizes FROM sz""")
def _(spark, sf):
    out = X.group_selection_summary(X.group_sizes(grouped(spark, sf)), train_size=3, heldout_size=2, max_groups=12)
    return tidy(out.withColumn("largest_group_sizes", F.array_join(F.col("largest_group_sizes").cast("array<string>"), ",")))


def faulty_splits(spark, sf):
    """Splits from orders and line items, with faults spread over them."""
    o = B.table(spark, sf, "orders")
    n = F.col("o_orderkey")
    splits = o.select(
        F.when(n % 97 == 0, "dup").otherwise(n.cast("string")).alias("split_id"),
        F.when(n % 89 != 0, "orders").alias("source"),
        F.lit("p").alias("learning_problem"),
        F.lit("{}").alias("domain"),
    )
    li = B.table(spark, sf, "lineitem")
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    tasks = li.select(
        k.cast("string").alias("split_id"),
        F.when(F.col("l_linenumber") <= 4, "train").otherwise("heldout").alias("role"),
        (p * 1000 + s).alias("pos"),
        F.lit("parts").alias("source"),
        F.concat_ws("-", p.cast("string"), (s % 7).cast("string")).alias("source_id"),
        F.when(p % 101 == 0, "[]").otherwise("{}").alias("domain"),
        F.when(p % 53 == 0, " ").otherwise("t").alias("task_input"),
        F.when(p % 67 != 0, '{"a":1}').alias("supervision"),
        F.when(p % 71 == 0, "1").otherwise("{}").alias("judge"),
    )
    return splits, tasks


_FAULTY = """
    s AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'dup' ELSE CAST(o_orderkey AS VARCHAR) END AS split_id,
        CASE WHEN o_orderkey % 89 <> 0 THEN 'orders' END AS source FROM orders),
    t AS (SELECT CAST(l_orderkey AS VARCHAR) AS split_id, CASE WHEN l_linenumber <= 4 THEN 'train' ELSE 'heldout' END AS role,
        l_partkey * 1000 + l_suppkey AS pos, 'parts' AS source, l_partkey || '-' || (l_suppkey % 7) AS source_id, l_partkey AS p
      FROM lineitem),
    tl AS (SELECT *, split_id || '.' || role || '[' || pos || ']' AS w FROM t)"""


@query("B6_split_violations", f"""
    WITH {_FAULTY}, v AS (
      SELECT 'B6_missing_split_field' AS rule_id, split_id AS entity_id, 'source' AS detail FROM s WHERE source IS NULL
      UNION ALL SELECT 'B6_missing_task_field', w, 'supervision' FROM tl WHERE p % 67 = 0
      UNION ALL SELECT 'B6_blank_task_input', w, '' FROM tl WHERE p % 53 = 0
      UNION ALL SELECT 'B6_not_an_object', w, 'domain' FROM tl WHERE p % 101 = 0
      UNION ALL SELECT 'B6_not_an_object', w, 'judge' FROM tl WHERE p % 71 = 0
      UNION ALL SELECT 'B6_empty_role', split_id, 'train' FROM s WHERE split_id NOT IN (SELECT split_id FROM t WHERE role = 'train')
      UNION ALL SELECT 'B6_empty_role', split_id, 'heldout' FROM s WHERE split_id NOT IN (SELECT split_id FROM t WHERE role = 'heldout')
      UNION ALL SELECT 'B6_duplicate_split_id', split_id, '' FROM s GROUP BY split_id HAVING count(*) > 1
      UNION ALL SELECT 'B6_duplicate_in_split', split_id, source || '/' || source_id FROM t GROUP BY split_id, source, source_id HAVING count(*) > 1
      UNION ALL SELECT 'B6_duplicate_across_splits', source || '/' || source_id, CAST(count(DISTINCT split_id) AS VARCHAR)
        FROM t GROUP BY source, source_id HAVING count(DISTINCT split_id) > 1)
    SELECT rule_id, 'error' AS severity, entity_id, detail FROM v""")
def _(spark, sf):
    return X.split_violations(*faulty_splits(spark, sf), partitions=B.many_tasks(spark, sf, "lineitem"))


@query("B7_split_totals", f"""
    WITH {_FAULTY}, c AS (SELECT split_id, count(*) FILTER (role = 'train') AS a, count(*) FILTER (role = 'heldout') AS b FROM t GROUP BY 1)
    SELECT coalesce(s.source, 'unknown') AS source, count(*) AS num_splits, CAST(coalesce(sum(a), 0) AS BIGINT) AS train_examples,
      CAST(coalesce(sum(b), 0) AS BIGINT) AS heldout_tasks FROM s LEFT JOIN c USING (split_id) GROUP BY 1""")
def _(spark, sf):
    return X.split_totals(*faulty_splits(spark, sf))


@query("C1_slug", r"""
    SELECT doc_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (
      SELECT doc_id, trim(regexp_replace(regexp_replace(trim(text, ' ' || chr(10)), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '_') AS s FROM documents)""")
def _(spark, sf):
    return B.wide_table(spark, sf, "documents").select("doc_id", slug("text").alias("slug"))


def materials(spark, sf):
    c = B.table(spark, sf, "conversations")
    return c.select(
        F.col("conv_id").alias("owner_id"), F.col("turn").alias("pos"),
        F.concat(F.lit("m"), F.col("turn").cast("string")).alias("path"),
        F.lit("extracted").alias("status"),
        F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "  ").otherwise(F.col("text")).alias("text"),
    )


BUDGET = 700
_CONTEXT = f"""RECURSIVE mt AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
        CASE WHEN (conv_id + turn) % 5 = 0 THEN '  ' ELSE text END AS text FROM conversations),
    fold AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST({BUDGET} AS BIGINT) AS rest, '' AS out FROM (SELECT DISTINCT conv_id FROM mt)
      UNION ALL
      SELECT conv_id, i, rest - length(x), out || CASE WHEN out = '' THEN '' ELSE chr(10) || chr(10) END ||
        '## Material: m' || turn || ' (extracted)' || CASE WHEN x <> '' THEN chr(10) || x ELSE '' END
      FROM (SELECT f.conv_id, m.i, m.turn, f.rest, f.out, trim(substr(m.text, 1, f.rest), ' ' || chr(10) || chr(9)) AS x
        FROM fold f JOIN mt m ON m.conv_id = f.conv_id AND m.i = f.i + 1 WHERE f.rest > 0)),
    ctx AS (SELECT conv_id, arg_max(out, i) AS context FROM fold GROUP BY conv_id)"""


@query("C2_material_context", f"WITH {_CONTEXT} SELECT conv_id AS owner_id, context FROM ctx")
def _(spark, sf):
    return P.material_context(materials(spark, sf), max_chars=BUDGET)


def pack_tasks(spark, sf):
    """Splits of all groups large enough; a thousand documents make groups of their own, so packs grow with the data."""
    tasks = grouped(spark, sf)
    block = F.floor(F.col("source_id").cast("bigint") / 1000).cast("string")
    tasks = tasks.withColumn("domain1", F.when(F.col("domain1") != "unknown", F.concat_ws(".", "domain1", block)).otherwise("unknown"))
    return X.few_shot_split(tasks, train_size=3, heldout_size=2, max_groups=None)


def split_inputs(spark, sf):
    """Split tasks with private columns, as packs need them."""
    return pack_tasks(spark, sf).select(
        "split_id", "role", "pos", F.lit("docs").alias("source"), "source_id",
        F.to_json(F.struct("domain1", "domain2")).alias("domain"), "task_input",
        F.to_json(F.struct(F.col("domain2").alias("items"))).alias("supervision"),
        F.lit('{"type":"t"}').alias("judge"), F.array(F.lit("text")).alias("expected_artifacts"),
    )


_ALL_GROUPS = _GROUPED.replace("source END AS domain1", "source || '.' || (doc_id // 1000) END AS domain1").replace(
    " ORDER BY size DESC, domain1, domain2, lang LIMIT 12", ""
)
_PACKS = _ALL_GROUPS + r""",
    pk AS (SELECT *, trim(regexp_replace(regexp_replace(split_id, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '_') AS pack_id FROM st),
    pt AS (SELECT *, pack_id || '::' || role || '::' || pos AS task_ref FROM pk)"""


@query("C3_public_examples", f"""
    WITH {_PACKS} SELECT pack_id, task_ref AS example_id, pos, source_id AS source_task_id, md5(task_input) AS input_md5,
      'needs_generation' AS output_status, task_ref || '::generate_desired_output' AS job_id FROM pt WHERE role = 'train'""")
def _(spark, sf):
    p = P.public_examples(split_inputs(spark, sf))
    return tidy(p.withColumn("input_md5", F.md5("task_input")).drop("task_input", "domain", "source"))


@query("C3_private_tasks", f"""
    WITH {_PACKS} SELECT pack_id, role, task_ref, source_id AS source_task_id, '{{"items":"' || domain2 || '"}}' AS supervision,
      '{{"type":"t"}}' AS judge, CAST(NULL AS VARCHAR) AS statistics FROM pt""")
def _(spark, sf):
    return P.private_tasks(split_inputs(spark, sf)).drop("source")


TEMPLATE = "Write for {example_id} ({artifacts}).\n\nTask input:\n{task_input}\n\nMaterial excerpts:\n{materials}\n"


def job_table(spark, sf):
    ctx = P.material_context(materials(spark, sf), max_chars=BUDGET)
    ctx = ctx.select(F.col("owner_id").cast("string").alias("source_id"), "context")
    return P.generation_jobs(split_inputs(spark, sf), template=TEMPLATE, contexts=ctx, budget=BUDGET, version="v1")


_JOBS = """,
    jb AS (SELECT pt.*, 'Write for ' || task_ref || ' (text).' || chr(10) || chr(10) || 'Task input:' || chr(10) || task_input ||
        chr(10) || chr(10) || 'Material excerpts:' || chr(10) || coalesce(ctx.context, 'No separate material files.') || chr(10) AS prompt
      FROM pt LEFT JOIN ctx ON CAST(ctx.conv_id AS VARCHAR) = pt.source_id WHERE role = 'train')"""


@query("C4_generation_jobs", f"""
    WITH {_CONTEXT}, {_PACKS} {_JOBS}
    SELECT task_ref || '::generate_desired_output' AS job_id, sha256(prompt) AS prompt_sha256, pack_id, task_ref AS example_id,
      'docs' AS source, source_id AS source_task_id, 'v1' AS prompt_template_version, CAST({BUDGET} AS BIGINT) AS material_budget_chars,
      length(prompt) AS chars FROM jb""")
def _(spark, sf):
    return tidy(job_table(spark, sf).withColumn("chars", F.length("prompt")).drop("prompt"))


@query("C5_pack_assembly", f"""
    WITH {_PACKS} SELECT pack_id, array_to_string(list(source_id ORDER BY pos) FILTER (role = 'train'), ',') AS train_ids,
      array_to_string(list(source_id ORDER BY pos) FILTER (role = 'heldout'), ',') AS heldout_ids FROM pt GROUP BY pack_id""")
def _(spark, sf):
    t = split_inputs(spark, sf)
    ids = lambda c: F.array_join(F.transform(c, lambda r: r["source_task_id"]), ",")
    train = P.nested_export(P.public_examples(t).select("pack_id", "pos", "source_task_id"), name="train")
    held = P.nested_export(P.public_heldout(t).select("pack_id", "pos", "source_task_id"), name="heldout")
    return train.join(held, "pack_id", "full_outer").select(
        "pack_id", ids("train").alias("train_ids"), ids("heldout").alias("heldout_ids")
    )


@query("C6_pack_summary", f"""
    WITH {_PACKS}, mc AS (SELECT CAST(conv_id AS VARCHAR) AS source_id, count(*) AS n FROM conversations GROUP BY 1)
    SELECT pack_id, 'docs' AS source, count(*) FILTER (role = 'train') AS train, count(*) FILTER (role = 'heldout') AS heldout,
      CAST(sum(greatest(1, length(task_input) // 4)) AS BIGINT) AS input_tokens_est, CAST(coalesce(sum(mc.n), 0) AS BIGINT) AS materials
    FROM pt LEFT JOIN mc USING (source_id) GROUP BY pack_id""")
def _(spark, sf):
    t = P.task_ids(split_inputs(spark, sf))
    per_owner = materials(spark, sf).groupBy(F.col("owner_id").cast("string").alias("source_id")).agg(F.count("*").alias("n"))
    counts = t.join(per_owner, "source_id").select("task_ref", "n")
    return P.pack_summary(t, counts)


def pack_examples(spark, sf):
    """Train rows of the packs with the document text as output, some not generated or blank."""
    p = P.public_examples(split_inputs(spark, sf))
    n = F.col("source_task_id").cast("bigint")
    return p.withColumn("output_status", F.when(n % 5 == 0, "needs_generation").otherwise("generated")).withColumn(
        "output", F.when(n % 7 == 0, " ").otherwise(F.col("task_input"))
    )


_EX = """,
    ex AS (SELECT *, CASE WHEN CAST(source_id AS BIGINT) % 7 = 0 THEN ' ' ELSE task_input END AS output FROM pt
      WHERE role = 'train'),
    us AS (SELECT * FROM ex WHERE CAST(source_id AS BIGINT) % 5 <> 0 AND trim(output, ' ' || chr(10)) <> '')"""


@query("C7_usable_examples", f"WITH {_PACKS} {_EX} SELECT pack_id, task_ref AS example_id, output FROM us")
def _(spark, sf):
    return P.usable_examples(pack_examples(spark, sf)).select("pack_id", "example_id", "output")


@query("C8_select_packs", f"""
    WITH {_PACKS} {_EX} SELECT pack_id, min(CAST(source_id AS BIGINT)) AS seq FROM pt
    WHERE pack_id IN (SELECT pack_id FROM us GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1 ORDER BY 2 LIMIT 6""")
def _(spark, sf):
    packs = pack_tasks(spark, sf).groupBy(slug("split_id").alias("pack_id")).agg(F.min(F.col("source_id").cast("bigint")).alias("seq"))
    return tidy(P.select_packs(packs, pack_examples(spark, sf), min_usable=2, limit=6))


@query("C9_eval_prompts", f"""
    WITH {_PACKS} {_EX},
    bl AS (SELECT pack_id, string_agg('### Example ' || task_ref || chr(10) || chr(10) || 'Task input:' || chr(10) || task_input ||
        chr(10) || chr(10) || 'Desired output:' || chr(10) || output || chr(10) || chr(10) || 'Materials:' || chr(10) || '- None' || chr(10),
        chr(10) ORDER BY pos) AS b FROM us GROUP BY pack_id),
    ce AS (SELECT pt.*, m.mode FROM pt, (VALUES ('prompt_only'), ('few_shot_examples_only'), ('ours')) m(mode) WHERE role = 'heldout'),
    pr AS (SELECT ce.pack_id, ce.task_ref AS task_id, ce.mode, 'T: ' || ce.task_input || chr(10) || 'E: ' ||
        CASE WHEN ce.mode = 'few_shot_examples_only' THEN coalesce(bl.b, '') ELSE '' END || chr(10) || 'S: ' ||
        CASE WHEN ce.mode = 'ours' THEN 'skill of ' || ce.pack_id ELSE '' END AS prompt
      FROM ce LEFT JOIN bl USING (pack_id))
    SELECT pack_id, task_id, mode, sha256(prompt) AS prompt_sha256 FROM pr""")
def _(spark, sf):
    held = P.public_heldout(split_inputs(spark, sf))
    cells = S.expected_cells(held, ["prompt_only", "few_shot_examples_only", "ours"])
    skills = held.select("pack_id").distinct().select(
        "pack_id", F.lit("ours").alias("mode"), F.concat(F.lit("skill of "), F.col("pack_id")).alias("skill_md")
    )
    out = P.eval_prompts(
        cells, held, pack_examples(spark, sf), skills, template="T: {task_input}\nE: {examples}\nS: {skill}"
    )
    return out.drop("prompt")
