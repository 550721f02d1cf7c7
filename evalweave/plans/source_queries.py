"""Registered queries of sources, sinks, batch inference and the streaming view.

Files are written by Spark from the given tables into a fresh folder under the cluster's shared
checkpoint directory, and read back through the source under test.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalweave.functions.session import checkpoint_dir
from evalweave.operators import batch_inference as I
from evalweave.operators import genlog as G
from evalweave.plans import bindings as B
from evalweave.plans.oracle_tables import with_tables
from evalweave.sources import jsonl as J
from evalweave.sources import listing as L
from evalweave.streaming import log_view as V

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def event_lines(spark, sf, *, tail: bool = False):
    """Events as JSON lines; some blank, some broken, some no objects."""
    e = B.table(spark, sf, "events")
    n = F.col("event_id")
    obj = F.to_json(F.struct("event_id", "event_type"))
    bad = F.when(n % 100 == 7, F.concat(F.lit("{bad "), n.cast("string"))).when(n % 100 == 8, F.concat(F.lit("["), n.cast("string"), F.lit("]")))
    return e.select(F.when(n % 50 == 3, "  ").when(bad.isNotNull() & F.lit(not tail), bad).otherwise(obj).alias("value"), n.alias("n"))


_STATE = "CASE WHEN event_id % 100 = 7 THEN 'bad_json' WHEN event_id % 100 = 8 THEN 'not_object' ELSE 'ok' END"


@query("A1_jsonl_scan", f"""
    SELECT CASE WHEN event_id % 100 IN (7, 8) THEN NULL ELSE event_id END AS event_id, {_STATE} AS state, count(*) AS n
    FROM events WHERE event_id % 50 <> 3 GROUP BY ALL""")
def _(spark, sf):
    path = scratch(spark, "a1")
    event_lines(spark, sf).select("value").write.text(path)
    scan = J.scan_lines(spark, path)
    good = J.good_rows(scan, "event_id bigint, event_type string").select("event_id", F.lit("ok").alias("state"))
    bad = J.strict_violations(scan).select(F.lit(None).cast("bigint").alias("event_id"), F.col("detail").alias("state"))
    return good.unionByName(bad).groupBy("event_id", "state").agg(F.count("*").alias("n"))


SEGMENT = 1000  # lines per log segment: more data makes more files, not larger ones


@query("A1_line_numbers", f"SELECT event_id, event_id % {SEGMENT} + 1 AS line FROM events WHERE event_id % 50 <> 3")
def _(spark, sf):
    path = scratch(spark, "a1n")
    lines = event_lines(spark, sf, tail=True).withColumn("f", F.floor(F.col("n") / SEGMENT))
    lines.repartition("f").sortWithinPartitions("f", "n").select("f", "value").write.partitionBy("f").text(path)
    return J.good_rows(J.scan_lines(spark, path), "event_id bigint").select("event_id", "line")


@query("A2_lenient_tail", f"""
    SELECT 'A2_ignored_tail' AS rule_id, 'warning' AS severity, 'bad_json' AS detail, count(DISTINCT event_id // {SEGMENT}) AS n FROM events
    UNION ALL SELECT 'A2_bad_row', 'error', 'bad_json', count(*) FILTER (event_id % 100 = 7) FROM events
    UNION ALL SELECT 'A2_bad_row', 'error', 'not_object', count(*) FILTER (event_id % 100 = 8) FROM events""")
def _(spark, sf):
    path = scratch(spark, "a2")
    lines = event_lines(spark, sf).withColumn("f", F.floor(F.col("n") / SEGMENT)).select("f", "n", "value")
    # Every segment ends in a cut-off line and a blank line.
    ends = lines.select("f").distinct().select("f", F.posexplode(F.array(F.lit('{"cut'), F.lit("  "))).alias("i", "value"))
    ends = ends.select("f", (F.col("f") * SEGMENT + SEGMENT + F.col("i")).alias("n"), "value")
    all_lines = lines.unionByName(ends)
    all_lines.repartition("f").sortWithinPartitions("f", "n").select("f", "value").write.partitionBy("f").text(path)
    found = J.lenient_violations(J.scan_lines(spark, path))
    return found.groupBy("rule_id", "severity", "detail").agg(F.count("*").alias("n"))


@query("A3_append_jsonl", """
    SELECT source, count(*) AS n, count(lang) AS with_lang FROM (SELECT 's' || (doc_id % 3) AS source, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM documents
      UNION ALL SELECT 's' || (doc_id % 3), NULL FROM labels) GROUP BY source""")
def _(spark, sf):
    path = scratch(spark, "a3")
    src = F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("source")
    J.write_jsonl(B.table(spark, sf, "documents").select(src, F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang")), path)
    J.write_jsonl(B.table(spark, sf, "labels").select(src, F.lit(None).cast("string").alias("lang")), path, append=True)
    rows = J.good_rows(J.scan_lines(spark, path), "source string, lang string")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"))


@query("A4_merge_files", """
    SELECT CAST(o AS BIGINT) AS file_ordinal, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT 0 AS o, event_id AS id FROM events WHERE event_id % 2 = 0
      UNION ALL SELECT 2, event_id FROM events WHERE event_id % 2 = 1) GROUP BY o
    UNION ALL SELECT -1, 1, 0""")
def _(spark, sf):
    paths = [scratch(spark, f"a4-{i}") for i in range(3)]
    e = B.table(spark, sf, "events").select("event_id")
    J.write_jsonl(e.filter("event_id % 2 = 0"), paths[0])
    J.write_jsonl(e.filter("event_id % 2 = 1"), paths[2])
    merged, missing = J.merge_files(spark, paths)
    rows = merged.select("file_ordinal", F.from_json("raw", "event_id bigint").alias("r")).groupBy(F.col("file_ordinal").cast("bigint").alias("file_ordinal")).agg(
        F.count("*").alias("n"), F.sum("r.event_id").alias("ids")
    )
    return rows.unionByName(missing.select(F.lit(-1).cast("bigint").alias("file_ordinal"), F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("ids")))


def listed_files(spark, sf):
    """A case tree as a listing: documents are cases, conversations their materials."""
    d = B.table(spark, sf, "documents")
    c = B.table(spark, sf, "conversations")
    case = lambda n: F.concat(F.lit("cat"), (n % 4).cast("string"), F.when(n % 3 == 0, "/").otherwise("/set/"), F.lit("case"), n.cast("string"))
    cases = d.select(F.concat(case(F.col("doc_id")), F.lit(L.CASE_MARK)).alias("rel"), F.col("n_chars").alias("bytes"), F.lit(False).alias("is_pointer"))
    mats = c.select(
        F.concat(case(F.col("conv_id")), F.when(F.col("turn") % 4 == 3, "/notes_").otherwise("/material_"), F.col("turn").cast("string"), F.lit(".md")).alias("rel"),
        F.length("text").cast("bigint").alias("bytes"), (F.col("turn") % 3 == 2).alias("is_pointer"),
    )
    return cases.unionByName(mats)


@query("A5_material_inventory", """
    SELECT 'cat' || (doc_id % 4) AS category, count(DISTINCT doc_id) AS cases, count(turn) AS material_files,
      CAST(coalesce(sum(length(c.text)), 0) AS BIGINT) AS material_bytes, count(*) FILTER (turn % 3 = 2) AS pointer_files
    FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id AND c.turn % 4 <> 3 GROUP BY 1""")
def _(spark, sf):
    return L.inventory_totals(L.case_materials(listed_files(spark, sf)))


def score_files(spark, sf):
    e = B.table(spark, sf, "events").withColumn("k", B._k())
    k, u = F.col("k"), F.col("user_id")
    stamp = F.date_format("ts", "yyyy-MM-dd_HH-mm-ss")
    name = (
        F.when(k % 10 == 0, F.concat(F.lit("x"), k.cast("string"), F.lit("_report.yaml")))
        .when(u % 7 == 0, F.concat(F.lit("r"), F.col("event_id").cast("string"), F.lit("_score.yaml")))
        .otherwise(F.concat(F.lit("j"), F.when(u % 3 == 0, k % 2).otherwise(0).cast("string"), F.lit("_"), stamp, F.lit("_score.yaml")))
    )
    return e.select(u.cast("string").alias("result_dir"), name.alias("name"))


_FILES = """
    WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
    f AS (SELECT CAST(user_id AS VARCHAR) AS result_dir, user_id % 7 = 0 AS bare, CASE WHEN user_id % 3 = 0 THEN k % 2 ELSE 0 END AS j, k % 10 <> 0 AS score,
        strftime(ts, '%Y-%m-%d_%H-%M-%S') AS st, 'r' || event_id || '_score.yaml' AS bare_name FROM e),
    g AS (SELECT *, CASE WHEN bare THEN bare_name ELSE 'j' || j || '_' || st || '_score.yaml' END AS name FROM f),
    a AS (SELECT result_dir, any_value(bare) AS bare, count(*) FILTER (score) AS n, count(DISTINCT j) FILTER (score) AS js,
        max(st || '|' || name) FILTER (score) AS top, min(name) FILTER (score) AS single,
        count(*) FILTER (score AND j = 1) AS n1, max(st || '|' || name) FILTER (score AND j = 1) AS top1 FROM g GROUP BY result_dir)"""


@query("A6_latest_score", _FILES + """,
    p AS (SELECT *, CASE WHEN n = 0 THEN 'none' WHEN bare THEN CASE WHEN n = 1 THEN 'found' ELSE 'ambiguous' END WHEN js > 1 THEN 'ambiguous' ELSE 'found' END AS pick FROM a)
    SELECT result_dir, pick, CASE WHEN pick = 'found' THEN CASE WHEN bare THEN single ELSE split_part(top, '|', 2) END END AS name, n AS n_files FROM p""")
def _(spark, sf):
    return L.latest_score_artifact(score_files(spark, sf))


@query("A6_latest_score_of_judge", _FILES + """
    SELECT result_dir, CASE WHEN bare OR n1 = 0 THEN 'none' ELSE 'found' END AS pick, CASE WHEN NOT bare AND n1 > 0 THEN split_part(top1, '|', 2) END AS name,
      CASE WHEN bare THEN 0 ELSE n1 END AS n_files FROM a""")
def _(spark, sf):
    return L.latest_score_artifact(score_files(spark, sf), judge_model="j1")


def stub_call(prompt: str) -> dict:
    """A deterministic stand-in for a model."""
    if prompt.endswith("click"):
        raise ValueError("no answer for clicks")
    return {"text": prompt.upper(), "finish_reason": "length" if prompt.endswith("view") else "stop", "model": "stub"}


@query("D5_batch_inference", with_tables("job", """
    SELECT job_id, prompt_sha256, CASE WHEN prompt = 'write click' THEN NULL ELSE upper(prompt) END AS text,
      CASE prompt WHEN 'write click' THEN NULL WHEN 'write view' THEN 'length' ELSE 'stop' END AS finish_reason,
      CASE WHEN prompt <> 'write click' THEN 'stub' END AS model, CASE WHEN prompt = 'write click' THEN 'ValueError: no answer for clicks' END AS error FROM job"""))
def _(spark, sf):
    return I.run_jobs(B.job(spark, sf), stub_call, concurrency=8).drop("duration_seconds")


@query("D10_stream_upsert", with_tables("generation_log", """
    SELECT job_id, prompt_sha256, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(finish_reason, seq) AS finish_reason
    FROM generation_log GROUP BY ALL"""))
def _(spark, sf):
    base = scratch(spark, "d10")
    log = B.generation_log(spark, sf).select(*G.KEY, "seq", "status", "finish_reason")
    for part in range(3):  # the log grows, and each run of the stream takes what is new
        log.filter(F.col("seq") % 3 == part).write.mode("append").parquet(f"{base}/log")
        stream = V.read_log_stream(spark, f"{base}/log", log.schema, fmt="parquet")
        V.upsert_stream(stream, f"{base}/view", f"{base}/chk", bucket_keys=50_000).awaitTermination()
    return V.current_view(spark, f"{base}/view", log.schema)
