"""The append-only generation log and what is built on it.

Keys are ``(job_id, prompt_sha256)``; ``seq`` is the arrival order and unique. "Latest" is the
highest ``seq`` of a key. Latest-per-key runs as a hash aggregate over three narrow columns; the
wide columns (output text) only meet it in one semi-join, so a hot key shrinks map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.bloom import KeyFilter
from evalweave.functions.expr import count_where, has_text, id_part, label
from evalweave.functions.patterns import PRIVATE_LEAK_PATTERNS, pattern_hits

KEY = ["job_id", "prompt_sha256"]
REQUIRED_JOB_FIELDS = ("job_id", "pack_id", "example_id", "prompt", "prompt_sha256")


def job_violations(jobs: DataFrame) -> DataFrame:
    """One row per required job field that is null or empty."""
    missing = F.array_compact(
        F.array(*[F.when(id_part(f) == "", F.lit(f)) for f in REQUIRED_JOB_FIELDS])
    )
    return jobs.select(
        F.lit("D1_missing_field").alias("rule_id"),
        F.lit("error").alias("severity"),
        F.col("seq").cast("string").alias("entity_id"),
        F.explode(missing).alias("detail"),
    )


def _keyed(log: DataFrame) -> DataFrame:
    return log.filter((id_part("job_id") != "") & (id_part("prompt_sha256") != ""))


def completed_keys(log: DataFrame) -> DataFrame:
    """Keys with any finished success, also one that a later row superseded."""
    return (
        log.filter(
            (F.col("status") == "success") & (F.col("finish_reason") == "stop") & (id_part("job_id") != "")
        )
        .select(*KEY)
        .distinct()
    )


def failed_keys(log: DataFrame) -> DataFrame:
    """D3: keys whose latest row with a status is not a success."""
    with_status = _keyed(log).filter(id_part("status") != "")
    latest = with_status.groupBy(*KEY).agg(F.max_by("status", "seq").alias("status"))
    return latest.filter(F.col("status") != "success")


def pending_jobs(
    jobs: DataFrame,
    log: DataFrame,
    *,
    pack_id: str | None = None,
    source: str | None = None,
    retry_keys: DataFrame | None = None,
    limit: int | None = None,
    resume: bool = True,
) -> DataFrame:
    """Jobs still to run, in job order. ``limit`` is the caller's batch size."""
    if pack_id is not None:
        jobs = jobs.filter(F.col("pack_id") == pack_id)
    if source is not None:
        jobs = jobs.filter(F.col("source") == source)
    if retry_keys is not None:
        jobs = jobs.join(retry_keys.select(*KEY), KEY, "left_semi")
    if resume:
        jobs = jobs.join(completed_keys(log), KEY, "left_anti")
    return jobs if limit is None else jobs.orderBy("seq").limit(limit)


def classify_responses(
    jobs: DataFrame, responses: DataFrame, *, patterns: Sequence[str] = PRIVATE_LEAK_PATTERNS
) -> DataFrame:
    """Responses joined to their jobs, with a status and the leak patterns hit.

    ``responses``: ``job_id, prompt_sha256, text, finish_reason, error``. An error comes first (no
    response exists), then a leak, then an unfinished answer. Responses are judged beside their texts,
    before the join: it carries the text of successes, and none where the caller does not ask for it.
    """
    status = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.size("leak_matches") > 0, "rejected_private_leak")
        .when(~F.col("finish_reason").eqNullSafe(F.lit("stop")), "rejected_incomplete_generation")
        .otherwise("success")
    )
    judged = responses.withColumn("leak_matches", pattern_hits(F.col("text"), patterns)).withColumn("status", status)
    judged = judged.withColumn("desired_output", F.when(F.col("status") == "success", F.col("text"))).drop("text")
    return jobs.select(*KEY, "pack_id", "example_id").join(judged, KEY)


def latest_rows(log: DataFrame, *, keys: Sequence[str] = KEY, wide: bool = False) -> DataFrame:
    """The whole latest row of each key; rows that lack a key part are left out.

    With ``wide``, for logs whose rows carry texts, a Bloom filter of the latest ``seq`` stands beside
    the scan, so that texts of superseded rows are not shuffled.
    """
    rows = log
    for k in keys:
        rows = rows.filter(id_part(k) != "")
    newest = rows.groupBy(*keys).agg(F.max("seq").alias("seq"))
    if wide:
        may_be_newest = KeyFilter(newest, ["seq"], bits=1 << 25)
        rows = rows.withColumn("__words", may_be_newest.words).filter(may_be_newest(F.xxhash64("seq"))).drop("__words")
    return rows.join(newest, [*keys, "seq"], "left_semi")


def latest_success(log: DataFrame) -> DataFrame:
    """Latest rows that are finished successes."""
    return latest_rows(log, wide=True).filter((F.col("status") == "success") & (F.col("finish_reason") == "stop"))


def export_summary(log: DataFrame, *, expected: int | None = None) -> DataFrame:
    """Input, latest, exported and held-back row counts, and whether they meet ``expected``."""
    latest = _keyed(log).groupBy(*KEY).agg(
        F.max_by(F.struct("status", "finish_reason"), "seq").alias("r"), F.count("*").alias("n")
    )
    good = F.coalesce((F.col("r.status") == "success") & (F.col("r.finish_reason") == "stop"), F.lit(False))
    counts = latest.agg(
        F.count("*").alias("latest_rows"),
        count_where(good).alias("exported_rows"),
        count_where(~good).alias("held_back_rows"),
    )
    out = counts.select(log.agg(F.count("*")).scalar().alias("input_rows"), "*")
    meets = F.lit(True) if expected is None else F.col("exported_rows") == expected
    return out.withColumn("meets_expected", meets)


def latest_status_counts(log: DataFrame) -> DataFrame:
    """Keys per latest status."""
    latest = _keyed(log).groupBy(*KEY).agg(F.max_by("status", "seq").alias("status"))
    return latest.groupBy(label("status").alias("status")).agg(F.count("*").alias("n"))


def latest_success_by_job(log: DataFrame) -> DataFrame:
    """Last success row of each job, whatever its prompt."""
    return latest_rows(log.filter(F.col("status") == "success"), keys=["job_id"])


def match_outputs(wanted: DataFrame, log: DataFrame, columns: Sequence[str], late: Sequence[str] = ()) -> DataFrame:
    """Per wanted ``(job_id, prompt_sha256)`` the exact latest row, else the job's latest row.

    ``columns`` are log columns; they arrive in the struct ``out`` (null when the job never ran), with
    ``seq``, which identifies a log row. The winners are found from one grouping of these columns; the
    wide columns named in ``late`` are fetched for the winners alone, by ``seq``.
    """
    narrow = [c for c in dict.fromkeys([*columns, "prompt_sha256"]) if c != "seq"]
    rows = log.filter(id_part("job_id") != "").select("job_id", F.col("prompt_sha256").alias("__prompt"), F.struct("seq", *narrow).alias("out"))
    newest = rows.groupBy("job_id", "__prompt").agg(F.max_by("out", "out.seq").alias("out"))
    exact = newest.filter(id_part("__prompt") != "").select("job_id", F.col("__prompt").alias("prompt_sha256"), F.col("out").alias("exact"))
    any_prompt = newest.groupBy("job_id").agg(F.max_by("out", "out.seq").alias("fallback"))
    found = (
        wanted.join(exact, KEY, "left")
        .join(any_prompt, "job_id", "left")
        .withColumn("out", F.coalesce("exact", "fallback"))
        .drop("exact", "fallback")
    )
    if not late:
        return found
    texts = log.select(F.col("seq").alias("__seq"), F.struct(*late).alias("__late"))
    fetched = found.withColumn("__seq", F.col("out.seq")).join(texts, "__seq", "left")
    added = [F.col("__late")[c].alias(c) for c in late]
    out = F.when(F.col("out").isNotNull(), F.struct("out.*", *added))
    return fetched.withColumn("out", out).drop("__seq", "__late")


def freeze_outcomes(
    examples: DataFrame, log: DataFrame, *, patterns: Sequence[str] = PRIVATE_LEAK_PATTERNS
) -> DataFrame:
    """What happens to each example's output, first failing test wins.

    ``examples``: ``pack_id, example_id, job_id, prompt_sha256, prompt_template_version`` as
    recorded in the pack. The log's ``status`` is not consulted.
    """
    found = match_outputs(
        examples.filter(id_part("job_id") != ""),
        log,
        ["finish_reason", "prompt_template_version", "model"],
        late=["desired_output"],
    )
    out = F.col("out")
    expects = lambda c: id_part(c) != ""
    outcome: Column = (
        F.when(out.isNull(), "missing")
        .when(~out["finish_reason"].eqNullSafe(F.lit("stop")), "missing_or_non_stop_finish_reason")
        .when(~has_text(out["desired_output"]), "empty_or_non_string_desired_output")
        .when(
            expects("prompt_sha256") & ~out["prompt_sha256"].eqNullSafe(F.col("prompt_sha256")),
            "prompt_sha256_mismatch",
        )
        .when(
            expects("prompt_template_version")
            & ~out["prompt_template_version"].eqNullSafe(F.col("prompt_template_version")),
            "prompt_template_version_mismatch",
        )
        .when(F.size(pattern_hits(out["desired_output"], patterns)) > 0, "private_leak_matches")
        .otherwise("applied")
    )
    kept = found.withColumn("outcome", outcome)
    applied = F.col("outcome") == "applied"
    return kept.select(
        "pack_id",
        "example_id",
        "job_id",
        "outcome",
        F.when(applied, out["desired_output"]).alias("text"),
        F.when(applied, out["prompt_sha256"]).alias("prompt_sha256"),
        F.when(applied, out["model"]).alias("model"),
    )


def freeze_counts(outcomes: DataFrame) -> DataFrame:
    """Applied, missing and rejected examples per pack."""
    o = F.col("outcome")
    return outcomes.groupBy("pack_id").agg(
        count_where(o == "applied").alias("applied"),
        count_where(o == "missing").alias("missing"),
        count_where(~o.isin("applied", "missing")).alias("rejected"),
    )


def freeze_blockers(outcomes: DataFrame, *, allow_missing: bool = False) -> DataFrame:
    """Examples that forbid the write; hand it to ``fail_if_any`` before writing."""
    bad = outcomes.filter(F.col("outcome") != "applied")
    if allow_missing:
        bad = bad.filter(F.col("outcome") != "missing")
    return bad.select(
        F.lit("D9_not_applied").alias("rule_id"),
        F.lit("error").alias("severity"),
        F.col("example_id").alias("entity_id"),
        F.col("outcome").alias("detail"),
    )


def log_status_counts(log: DataFrame) -> DataFrame:
    """Rows per status."""
    return log.groupBy(label("status").alias("status")).agg(F.count("*").alias("n"))


def throughput(log: DataFrame, *, at: str = "finished_at", by: Sequence[str] = ()) -> DataFrame:
    """Rows per minute of elapsed time; null when no time has passed."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    agg = log.groupBy(*by).agg(
        F.count("*").alias("n"), ((F.max(micros) - F.min(micros)) / F.lit(1e6)).alias("seconds")
    )
    return agg.withColumn("per_minute", F.try_divide(F.col("n") * 60.0, F.col("seconds")))
