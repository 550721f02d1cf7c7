"""Registered queries of the generation-log family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions.patterns import PRIVATE_LEAK_PATTERNS
from evalweave.operators import genlog as G
from evalweave.plans import bindings as B
from evalweave.plans.oracle_tables import with_tables
from evalweave.plans.shape import tidy
from evalweave.streaming.log_view import latest_view

QUERIES = {}
ORACLE = {}

def leak_sql(text: str) -> list[str]:
    """Whether each leak pattern is found."""
    return [f"regexp_matches({text}, '(?i){p}')" for p in PRIVATE_LEAK_PATTERNS]


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def _holes(jobs):
    """Jobs with some fields blanked, so that the validation has work."""
    return jobs.withColumn("prompt", F.when(F.col("seq") % 7 == 0, "").otherwise(F.col("prompt"))).withColumn(
        "example_id", F.when(F.col("seq") % 11 != 0, F.col("example_id"))
    )


@query("D1_job_violations", with_tables("job", """
    SELECT 'D1_missing_field' AS rule_id, 'error' AS severity, CAST(seq AS VARCHAR) AS entity_id, f AS detail
    FROM (SELECT seq, 'prompt' AS f FROM job WHERE seq % 7 = 0
      UNION ALL SELECT seq, 'example_id' FROM job WHERE seq % 11 = 0)"""))
def _(spark, sf):
    return G.job_violations(_holes(B.job(spark, sf)))


_DONE = "(SELECT DISTINCT job_id, prompt_sha256 FROM generation_log WHERE status = 'success' AND finish_reason = 'stop')"


@query("D2_pending_jobs", with_tables("job generation_log", f"""
    SELECT job_id, prompt_sha256, pack_id, source FROM job
    WHERE (job_id, prompt_sha256) NOT IN {_DONE}"""))
def _(spark, sf):
    return G.pending_jobs(B.job(spark, sf), B.generation_log(spark, sf)).select(
        "job_id", "prompt_sha256", "pack_id", "source"
    )


_LATEST = """,
    latest AS (SELECT * FROM generation_log QUALIFY
      row_number() OVER (PARTITION BY job_id, prompt_sha256 ORDER BY seq DESC) = 1)"""


@query("D3_retry_keys", with_tables("generation_log", _LATEST + """
    SELECT job_id, prompt_sha256, status FROM latest WHERE status <> 'success'"""))
def _(spark, sf):
    return G.failed_keys(B.generation_log(spark, sf))


@query("D2_retry_batch", with_tables("job generation_log", _LATEST + """
    SELECT job_id, prompt_sha256, seq FROM job SEMI JOIN
      (SELECT job_id, prompt_sha256 FROM latest WHERE status <> 'success') USING (job_id, prompt_sha256)
    WHERE source = 'src1' ORDER BY seq LIMIT 50"""))
def _(spark, sf):
    log = B.generation_log(spark, sf)
    return G.pending_jobs(
        B.job(spark, sf), log, source="src1", retry_keys=G.failed_keys(log), limit=50, resume=False
    ).select("job_id", "prompt_sha256", "seq")


@query("D4_response_status", with_tables("generation_log job", f""",
    r AS (SELECT g.*, CASE WHEN seq % 23 = 0 THEN 'timeout' END AS error, {B.planted_sql("d.text", "g.seq")} AS text
      FROM generation_log g LEFT JOIN documents d ON d.doc_id = g.seq % (SELECT count(*) FROM documents)),
    h AS (SELECT *, {" + ".join(f"CAST({x} AS BIGINT)" for x in leak_sql("text"))} AS n_hits FROM r)
    SELECT job_id, prompt_sha256, seq,
      CASE WHEN error IS NOT NULL THEN 'error' WHEN n_hits > 0 THEN 'rejected_private_leak'
        WHEN finish_reason <> 'stop' THEN 'rejected_incomplete_generation' ELSE 'success' END AS status, n_hits
    FROM h SEMI JOIN job USING (job_id, prompt_sha256)"""))
def _(spark, sf):
    log = B.doc_text_by(spark, sf, B.generation_log(spark, sf), "seq")
    responses = log.select(
        *G.KEY, "seq", "finish_reason", B.planted(F.col("doc_text"), F.col("seq")).alias("text"),
        F.when(F.col("seq") % 23 == 0, "timeout").alias("error"),
    )
    out = G.classify_responses(B.job(spark, sf), responses)
    return out.select(*G.KEY, "seq", "status", F.size("leak_matches").cast("bigint").alias("n_hits"))


@query("D6_latest_rows", with_tables("generation_log", _LATEST + """
    SELECT job_id, prompt_sha256, seq, status, finish_reason, pack_id, model, prompt_template_version FROM latest"""))
def _(spark, sf):
    return G.latest_rows(B.generation_log(spark, sf)).select(
        *G.KEY, "seq", "status", "finish_reason", "pack_id", "model", "prompt_template_version"
    )


@query("D7_latest_success", with_tables("generation_text", """,
    latest AS (SELECT * FROM generation_text QUALIFY
      row_number() OVER (PARTITION BY job_id, prompt_sha256 ORDER BY seq DESC) = 1)
    SELECT job_id, prompt_sha256, seq, md5(desired_output) AS text_md5
    FROM latest WHERE status = 'success' AND finish_reason = 'stop'"""))
def _(spark, sf):
    return G.latest_success(B.generation_log(spark, sf, with_text=True)).select(
        *G.KEY, "seq", F.md5("desired_output").alias("text_md5")
    )


@query("D7_export_summary", with_tables("generation_log", _LATEST + """
    SELECT (SELECT count(*) FROM generation_log) AS input_rows, count(*) AS latest_rows,
      count(*) FILTER (status = 'success' AND finish_reason = 'stop') AS exported_rows,
      count(*) FILTER (NOT (status = 'success' AND finish_reason = 'stop')) AS held_back_rows,
      count(*) FILTER (status = 'success' AND finish_reason = 'stop') = 750 AS meets_expected FROM latest"""))
def _(spark, sf):
    return G.export_summary(B.generation_log(spark, sf), expected=750)


@query("D7_latest_status_counts", with_tables("generation_log", _LATEST + """
    SELECT status, count(*) AS n FROM latest GROUP BY status"""))
def _(spark, sf):
    return G.latest_status_counts(B.generation_log(spark, sf))


def _wanted(spark, sf):
    """Keys to look up: a third of them with a prompt hash the log has never seen."""
    jobs = B.job(spark, sf)
    stale = F.col("seq") % 3 == 0
    return jobs.select(
        "pack_id", "example_id", "job_id", F.col("prompt_sha256").alias("sha0"), "seq",
        F.when(stale, F.sha2(F.col("prompt_sha256"), 256)).otherwise(F.col("prompt_sha256")).alias("prompt_sha256"),
    )


_WANTED = """,
    wanted AS (SELECT pack_id, example_id, job_id, seq AS job_seq,
      CASE WHEN seq % 3 = 0 THEN sha256(prompt_sha256) ELSE prompt_sha256 END AS prompt_sha256 FROM job),
    ex AS (SELECT * FROM generation_text QUALIFY
      row_number() OVER (PARTITION BY job_id, prompt_sha256 ORDER BY seq DESC) = 1),
    fb AS (SELECT * FROM generation_text QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1),
    m AS (SELECT w.*, coalesce(ex.seq, fb.seq) AS out_seq,
        coalesce(ex.prompt_sha256, fb.prompt_sha256) AS out_sha,
        coalesce(ex.finish_reason, fb.finish_reason) AS finish_reason,
        CASE WHEN ex.job_id IS NOT NULL THEN ex.desired_output ELSE fb.desired_output END AS desired_output,
        coalesce(ex.prompt_template_version, fb.prompt_template_version) AS ptv
      FROM wanted w LEFT JOIN ex ON ex.job_id = w.job_id AND ex.prompt_sha256 = w.prompt_sha256
        LEFT JOIN fb ON fb.job_id = w.job_id)"""


@query("D8_prompt_aware_match", with_tables("job generation_text", _WANTED + """
    SELECT job_id, prompt_sha256, job_seq, out_seq, out_sha FROM m"""))
def _(spark, sf):
    wanted = _wanted(spark, sf).select("job_id", "prompt_sha256", F.col("seq").alias("job_seq"))
    log = B.generation_log(spark, sf)
    out = G.match_outputs(wanted, log, ["seq"])
    return out.select(*G.KEY, "job_seq", F.col("out.seq").alias("out_seq"), F.col("out.prompt_sha256").alias("out_sha"))


@query("D8_success_by_job", with_tables("generation_log", """
    SELECT job_id, max(seq) AS seq, arg_max(prompt_sha256, seq) AS prompt_sha256
    FROM generation_log WHERE status = 'success' GROUP BY job_id"""))
def _(spark, sf):
    return G.latest_success_by_job(B.generation_log(spark, sf)).select("job_id", "seq", "prompt_sha256")


_OUTCOME = f""",
    o AS (SELECT *, CASE WHEN out_seq IS NULL THEN 'missing'
        WHEN finish_reason <> 'stop' THEN 'missing_or_non_stop_finish_reason'
        WHEN desired_output IS NULL OR trim(desired_output) = '' THEN 'empty_or_non_string_desired_output'
        WHEN out_sha <> prompt_sha256 THEN 'prompt_sha256_mismatch'
        WHEN ptv <> 'v1' THEN 'prompt_template_version_mismatch'
        WHEN {" OR ".join(leak_sql("desired_output"))} THEN 'private_leak_matches'
        ELSE 'applied' END AS outcome FROM m)"""


def _frozen(spark, sf):
    examples = _wanted(spark, sf).select(
        "pack_id", "example_id", "job_id", "prompt_sha256", F.lit("v1").alias("prompt_template_version")
    )
    return G.freeze_outcomes(examples, B.generation_log(spark, sf, with_text=True))


@query("D9_freeze_outcomes", with_tables("job generation_text", _WANTED + _OUTCOME + """
    SELECT pack_id, example_id, job_id, outcome,
      CASE WHEN outcome = 'applied' THEN md5(desired_output) END AS text_md5 FROM o"""))
def _(spark, sf):
    return _frozen(spark, sf).select("pack_id", "example_id", "job_id", "outcome", F.md5("text").alias("text_md5"))


@query("D9_freeze_counts", with_tables("job generation_text", _WANTED + _OUTCOME + """
    SELECT pack_id, count(*) FILTER (outcome = 'applied') AS applied,
      count(*) FILTER (outcome = 'missing') AS missing,
      count(*) FILTER (outcome NOT IN ('applied', 'missing')) AS rejected FROM o GROUP BY pack_id"""))
def _(spark, sf):
    return G.freeze_counts(_frozen(spark, sf))


@query("D10_latest_view", with_tables("generation_log", """
    SELECT job_id, prompt_sha256, max(seq) AS seq, count(*) AS n_rows, arg_max(status, seq) AS status,
      arg_max(finish_reason, seq) AS finish_reason FROM generation_log GROUP BY ALL"""))
def _(spark, sf):
    return latest_view(B.generation_log(spark, sf), ["status", "finish_reason"])


@query("D11_status_counts", with_tables("generation_log", "SELECT status, count(*) AS n FROM generation_log GROUP BY 1"))
def _(spark, sf):
    return G.log_status_counts(B.generation_log(spark, sf))


@query("D11_throughput", with_tables("generation_log", """
    SELECT model, count(*) AS n, round((epoch_us(max(finished_at)) - epoch_us(min(finished_at))) / 1e6, 6) AS seconds,
      round(count(*) * 60.0 / ((epoch_us(max(finished_at)) - epoch_us(min(finished_at))) / 1e6), 6) AS per_minute
    FROM generation_log GROUP BY model"""))
def _(spark, sf):
    return tidy(G.throughput(B.generation_log(spark, sf), by=["model"]))
