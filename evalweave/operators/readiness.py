"""Coverage, model inventory and readiness gates (H3-H8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.expr import count_where, has_text, id_part, label, lit_list
from evalweave.operators.packs import usable_examples
from evalweave.operators.violations import rule_rows, union_all, violation


@dataclass(frozen=True)
class Profile:
    """What one phase demands."""

    skill_modes: tuple[str, ...]
    eval_modes: tuple[str, ...]
    official_modes: tuple[str, ...] = ()
    require_official: bool = False
    complete: bool = True


# -- H3 ---------------------------------------------------------------------------------------


def example_status_counts(packs: DataFrame, examples: DataFrame) -> DataFrame:
    """H3: per pack, train examples that are generated, waiting or invalid."""
    status, gen = F.col("output_status"), F.lit("generated")
    done = F.coalesce((status == gen) & F.col("output").isNotNull(), F.lit(False))
    wait = F.coalesce(status == "needs_generation", F.lit(False))
    per_pack = examples.groupBy("pack_id").agg(
        F.count("*").alias("train_examples"), count_where(done).alias("generated"),
        count_where(wait).alias("needs_generation"), count_where(~done & ~wait).alias("invalid"),
    )
    cols = ["train_examples", "generated", "needs_generation", "invalid"]
    return packs.select("pack_id").distinct().join(per_pack, "pack_id", "left").na.fill(0, cols)


# -- H4, H5 -----------------------------------------------------------------------------------


def skill_coverage(skills: DataFrame, *, required: Sequence[str]) -> DataFrame:
    """H4: per pack with skill rows, missing required modes, failures, ready."""
    rows = skills.filter(id_part("pack_id") != "")
    failed = F.coalesce(F.col("status") == "induction_error", F.lit(False))
    usable = ~failed & F.col("mode").isNotNull() & has_text("skill_md")
    # One row per pack and mode first: the list below holds distinct modes only.
    per_mode = rows.groupBy("pack_id", "mode").agg(F.max(usable).alias("ok"), count_where(failed).alias("failures"))
    agg = per_mode.groupBy("pack_id").agg(
        F.collect_set(F.when(F.col("ok") & F.col("mode").isin(list(required)), F.col("mode"))).alias("have"),
        F.sum("failures").alias("failures"),
    )
    missing = F.array_except(lit_list(list(required)), F.col("have"))
    return agg.select("pack_id", missing.alias("missing_modes"), "failures", ((F.size(missing) == 0) & (F.col("failures") == 0)).alias("ready"))


def eval_coverage(rows: DataFrame, *, required: Sequence[str]) -> DataFrame:
    """H5: per ``(pack, task)``, missing, duplicate and non-success modes.

    Any failing duplicate makes a cell not ready, unlike F7, where one success is enough. Modes of
    a task are distinct labels, so the gathered maps stay small.
    """
    keyed = rows.withColumns({c: id_part(c) for c in ("pack_id", "task_id", "mode")}).filter(
        (F.col("pack_id") != "") & (F.col("task_id") != "") & (F.col("mode") != "")
    )
    cell = ["pack_id", "task_id", "mode"]
    per_status = keyed.groupBy(*cell, label("status").alias("status")).agg(F.count("*").alias("n"))
    per_mode = per_status.groupBy(*cell).agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("status") != "success", F.col("status"))).alias("bad"),
        F.array_sort(F.collect_list("status")).alias("statuses"),
    )
    fault = F.when(F.col("bad").isNotNull(), F.when(F.col("n") == 1, F.col("bad")).otherwise(
        F.concat(F.lit("duplicate_statuses:"), F.array_join("statuses", ","))
    ))
    note = lambda c: F.when(c.isNotNull(), F.concat_ws("=", F.col("mode"), c))
    out = per_mode.groupBy("pack_id", "task_id").agg(
        F.collect_set(F.when(F.col("mode").isin(list(required)), F.col("mode"))).alias("have"),
        F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("mode")))).alias("duplicate_modes"),
        F.array_sort(F.collect_list(note(fault))).alias("non_success_modes"),
        F.sum("n").alias("n_rows"),
    )
    missing = F.array_except(lit_list(list(required)), F.col("have"))
    return out.select(
        "pack_id", "task_id", "n_rows", missing.alias("missing_modes"), "duplicate_modes", "non_success_modes",
        ((F.size(missing) == 0) & (F.size("non_success_modes") == 0)).alias("ready"),
    )


# -- H6 ---------------------------------------------------------------------------------------


def row_models(*parts: Column) -> Column:
    """Distinct non-blank model names of a row; parts are string or array<string> columns."""
    arrays = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.array_distinct(F.filter(F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])), lambda m: has_text(m)))


def model_inventory(skills: DataFrame, evals: DataFrame) -> DataFrame:
    """H6: models per role, for all rows and for scored (success) rows.

    ``skills``: ``solver_models array``. ``evals``: ``status, solver_models, judge_models``
    (arrays from ``row_models``). One row per ``(scope, role, model)`` with its row count; rows
    without any model are counted under a null model.
    """
    def lines(df: DataFrame, role: str, arr: str, scored: Column) -> DataFrame:
        models = F.when(F.size(arr) > 0, F.col(arr)).otherwise(F.array(F.lit(None).cast("string")))
        scopes = F.when(scored, F.array(F.lit("all"), F.lit("scored"))).otherwise(F.array(F.lit("all")))
        return df.select(F.explode(scopes).alias("scope"), F.lit(role).alias("role"), models.alias("models")).select(
            "scope", "role", F.explode("models").alias("model")
        )

    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    rows = union_all([
        lines(skills, "skill_solver", "solver_models", F.lit(True)),
        lines(evals, "eval_solver", "solver_models", ok),
        lines(evals, "eval_judge", "judge_models", ok),
    ])
    return rows.groupBy("scope", "role", "model").agg(F.count("*").alias("n"))


def monoculture(inventory: DataFrame) -> DataFrame:
    """H6: per scope, distinct models over all roles, the single one if there is only one, and
    rows without a model."""
    return inventory.groupBy("scope").agg(
        F.count_distinct("model").alias("n_models"),
        F.when(F.min("model") == F.max("model"), F.min("model")).alias("monoculture_model"),
        F.coalesce(F.sum(F.when(F.col("model").isNull(), F.col("n"))), F.lit(0)).alias("rows_without_model"),
    ).withColumn("monoculture", F.col("monoculture_model").isNotNull()).withColumn(
        "identity_complete", F.col("rows_without_model") == 0
    )


# -- H7 ---------------------------------------------------------------------------------------


def expected_targets(packs: DataFrame, heldout: DataFrame, examples: DataFrame, *, source: str | None = None, limit_heldout: int | None = None) -> DataFrame:
    """H7: heldout tasks that must have evaluation rows: packs with a usable example."""
    return _targets(packs, heldout, examples, source, limit_heldout).distinct()


def _targets(packs: DataFrame, heldout: DataFrame, examples: DataFrame, source: str | None, limit_heldout: int | None) -> DataFrame:
    """Expected targets, as often as ``heldout`` holds them."""
    if source is not None:
        packs = packs.filter(F.col("source") == source)
    if limit_heldout is not None:
        heldout = heldout.filter(F.col("pos") < limit_heldout)
    good = usable_examples(examples).select("pack_id").distinct()
    kept = packs.select("pack_id").distinct().join(good, "pack_id", "left_semi")
    return heldout.filter(id_part("task_id") != "").join(kept, "pack_id", "left_semi").select("pack_id", "task_id")


def coverage_issues(rows: DataFrame, expected: DataFrame, *, required: Sequence[str], name: str, severity: str, complete: bool) -> list[DataFrame]:
    """H7: missing targets (when coverage must be complete) and targets that are not ready, as H5 has it.

    Rows and expected targets meet in one shuffle as flags, which are combined before it, so neither a list
    per target nor a join is needed.
    """
    flags = [f"has_{i}" for i in range(len(required))]
    pack, task, mode = (id_part(c) for c in ("pack_id", "task_id", "mode"))
    marked = rows.filter((pack != "") & (task != "") & (mode != "")).select(
        pack.alias("pack_id"), task.alias("task_id"), F.lit(True).alias("seen"), F.lit(False).alias("wanted"),
        (label("status") != "success").alias("bad"), *[(mode == m).alias(f) for m, f in zip(required, flags)],
    )
    if complete:
        no = F.lit(False)
        marked = marked.unionByName(expected.select(
            pack.alias("pack_id"), task.alias("task_id"), no.alias("seen"), F.lit(True).alias("wanted"), no.alias("bad"), *[no.alias(f) for f in flags]
        ))
    cells = marked.groupBy("pack_id", "task_id").agg(*[F.max(c).alias(c) for c in ("seen", "wanted", "bad", *flags)])
    lacks = reduce(or_, [~F.col(f) for f in flags], F.col("bad"))
    return [rule_rows(cells, F.concat_ws("::", "pack_id", "task_id"), [
        (f"H7_{name}_incomplete", severity, F.col("seen") & lacks, ""),
        (f"H7_{name}_missing", severity, F.col("wanted") & ~F.col("seen"), ""),
    ])]


def readiness(
    profile: Profile,
    *,
    packs: DataFrame,
    examples: DataFrame,
    heldout: DataFrame,
    skills: DataFrame,
    evals: Mapping[str, tuple[DataFrame, str | None]],
    official: tuple[DataFrame, str | None] | None = None,
    surrogate: str | None = None,
    inventory: DataFrame | None = None,
    schema_faults: Sequence[DataFrame] = (),
    limit_heldout: int | None = None,
) -> DataFrame:
    """H7: blockers (errors) and warnings of a phase; ready when there is no error.

    ``evals`` maps a name to its rows and the pack source it covers. The one named ``surrogate``
    only warns when complete coverage is not demanded. ``official`` are official score rows; they
    block when the profile requires them and warn otherwise. ``inventory`` is H6.
    """
    counts = example_status_counts(packs, examples)
    out = [
        *schema_faults,
        violation(packs.limit(1).agg(F.count("*").alias("n")).filter("n = 0"), "H7_no_packs", F.lit(""), "no example packs loaded"),
        rule_rows(counts, "pack_id", [
            ("H7_no_train_examples", "error", F.col("train_examples") == 0, ""),
            ("H7_few_outputs", "error", F.col("generated") < 2, F.col("generated").cast("string")),
            ("H7_not_frozen", "error", (F.col("needs_generation") > 0) | (F.col("invalid") > 0), ""),
        ]),
    ]
    if profile.complete:
        cov = skill_coverage(skills, required=profile.skill_modes).withColumn("seen", F.lit(True))
        joined = packs.select("pack_id").distinct().join(cov, "pack_id", "left")
        out.append(rule_rows(joined, "pack_id", [
            ("H7_no_skill_rows", "error", F.col("seen").isNull(), ""),
            ("H7_missing_skill_modes", "error", ~F.col("ready"), F.array_join("missing_modes", ",")),
        ]))
    for name, (rows, source) in evals.items():
        severity = "warning" if name == surrogate and not profile.complete else "error"
        want = _targets(packs, heldout, examples, source, limit_heldout)
        out += coverage_issues(rows, want, required=profile.eval_modes, name=name, severity=severity, complete=profile.complete)
    if official is not None:
        rows, source = official
        severity = "error" if profile.require_official else "warning"
        want = _targets(packs, heldout, examples, source, limit_heldout)
        out += coverage_issues(rows, want, required=profile.official_modes, name="official", severity=severity, complete=profile.complete)
        present = rows.limit(1).select(F.lit(1).alias("k")).distinct()
        absent = want.limit(1).select(F.lit(1).alias("k")).join(present, "k", "left_anti")
        out.append(violation(absent, "H7_official_absent", F.lit(""), "", severity))
    if inventory is not None:
        mono = monoculture(inventory)
        out.append(violation(
            mono.filter((F.col("scope") == "all") & F.col("monoculture")), "H7_model_monoculture", "monoculture_model",
            F.when(F.col("identity_complete"), "complete").otherwise("some rows lack model identity"), "warning",
        ))
        flags = mono.agg(
            F.max(F.when(F.col("scope") == "all", F.col("monoculture"))).alias("all_mono"),
            F.max(F.when(F.col("scope") == "scored", F.col("monoculture_model"))).alias("scored_model"),
        )
        scored = flags.filter(F.col("scored_model").isNotNull() & ~F.coalesce("all_mono", F.lit(False)))
        out.append(violation(scored, "H7_scored_monoculture", "scored_model", "", "warning"))
    return union_all(out)


# -- H8 ---------------------------------------------------------------------------------------


def source_domain_coverage(rows: DataFrame) -> DataFrame:
    """H8: rows per source, and per source and primary, secondary or language value, in one pass.

    ``rows``: ``source, primary, secondary, language``. ``facet`` is ``source`` for the plain count.
    """
    src = label("source").alias("source")
    facets = F.array(
        F.struct(F.lit("source").alias("facet"), F.lit("").alias("value")),
        *[F.struct(F.lit(f).alias("facet"), id_part(f).alias("value")) for f in ("primary", "secondary", "language")],
    )
    long = rows.select(src, F.explode(facets).alias("f")).select("source", "f.*")
    return long.filter((F.col("facet") == "source") | (F.col("value") != "")).groupBy("source", "facet", "value").agg(F.count("*").alias("n"))


def frozen_summary(packs: DataFrame, examples: DataFrame, heldout: DataFrame) -> DataFrame:
    """H8: packs, train examples, heldout tasks and frozen examples, in one row."""
    frozen = F.coalesce((F.col("output_status") == "generated") & has_text("output"), F.lit(False))
    counts = examples.agg(F.count("*").alias("train_examples"), count_where(frozen).alias("frozen_train_examples"))
    rows = lambda df: df.agg(F.count("*")).scalar()
    return counts.select(rows(packs).alias("packs"), "*", rows(heldout).alias("heldout_tasks"))


def job_log_differences(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """H8: job keys without a latest log row and log keys without a job; latest rows that failed.

    Jobs and log meet in one grouping by key. Of latest rows with one ``seq`` the greatest status stays.
    A prompt hash travels as its 32 bytes; what is none as text that is longer.
    """
    long = "=" * 33
    sha = F.col("prompt_sha256").cast("string")
    packed = F.when(sha.rlike("^[0-9a-f]{64}$"), F.unhex(sha)).otherwise(F.encode(F.concat(F.lit(long), sha), "UTF-8")).alias("sha")
    full = (id_part("job_id") != "") & (id_part("prompt_sha256") != "")
    job_id = F.col("job_id").cast("string").alias("job_id")
    none = F.lit(None).cast(f"struct<seq:{log.schema['seq'].dataType.simpleString()},status:string>").alias("row")
    j = jobs.filter(full).select(job_id, packed, F.lit(True).alias("in_jobs"), none)
    row = F.struct("seq", F.col("status").cast("string").alias("status")).alias("row")
    g = log.filter(full & F.col("seq").isNotNull()).select(job_id, packed, F.lit(False).alias("in_jobs"), row)
    both = j.unionByName(g).repartition("job_id", "sha").groupBy("job_id", "sha").agg(F.max("in_jobs").alias("in_jobs"), F.max("row").alias("row"))
    text = F.when(F.octet_length("sha") == 32, F.lower(F.hex("sha"))).otherwise(F.substring(F.decode("sha", "UTF-8"), len(long) + 1, 1 << 30))
    in_log, status = F.col("row").isNotNull(), F.col("row.status")
    return rule_rows(both, F.concat_ws("/", "job_id", text), [
        ("H8_job_without_log", "error", ~in_log, ""),
        ("H8_log_without_job", "error", ~F.col("in_jobs"), ""),
        ("H8_latest_not_success", "error", in_log & ~status.eqNullSafe(F.lit("success")), status),
    ])


def expectation_faults(summary: DataFrame, expected: Mapping[str, int], *, severity: str = "error", name: str = "H8") -> DataFrame:
    """H8: columns of a one-row summary that differ from the expected totals."""
    rules = [
        (f"{name}_expected_{c}", severity, F.coalesce(F.col(c), F.lit(-1)) != n, F.concat(F.lit(f"expected {n}, got "), F.col(c).cast("string")))
        for c, n in expected.items()
    ]
    return rule_rows(summary, F.lit(""), rules)


def frozen_faults(summary: DataFrame, *, severity: str = "error") -> DataFrame:
    """H8: train examples that are not frozen."""
    return rule_rows(summary, F.lit(""), [
        ("H8_not_all_frozen", severity, F.col("frozen_train_examples") != F.col("train_examples"),
         F.concat_ws("/", F.col("frozen_train_examples").cast("string"), F.col("train_examples").cast("string")))
    ])


def audit_file_faults(rows: DataFrame, specs: DataFrame, *, severity: str = "error") -> DataFrame:
    """H8: audit result files against their specification.

    ``rows``: ``path, source, status``. ``specs``: ``path, source`` (null: any), ``min_success``.
    Wrong sources, too few successes, any non-success row; a file without rows has no success.
    """
    per_file = rows.groupBy("path").agg(
        F.min(label("source")).alias("lo"), F.max(label("source")).alias("hi"), F.count("*").alias("n"),
        count_where(F.coalesce(F.col("status") == "success", F.lit(False))).alias("ok"),
    )
    joined = specs.select("path", F.col("source").alias("want"), "min_success").join(per_file, "path", "left").na.fill(0, ["n", "ok"])
    wrong = F.col("want").isNotNull() & ~((F.col("lo") == F.col("want")) & (F.col("hi") == F.col("want")))
    return rule_rows(joined, "path", [
        ("H8_audit_source", severity, F.coalesce(wrong, F.col("want").isNotNull()), F.col("want")),
        ("H8_audit_few_success", severity, F.col("ok") < F.col("min_success"), F.concat_ws(" < ", F.col("ok").cast("string"), F.col("min_success").cast("string"))),
        ("H8_audit_non_success", severity, (F.col("ok") != F.col("n")) | (F.col("n") == 0), ""),
    ])


def cleaning_status(
    *,
    flow: DataFrame,
    packs: DataFrame,
    examples: DataFrame,
    heldout: DataFrame,
    jobs: DataFrame,
    log: DataFrame,
    expected: Mapping[str, int],
    required_audits: tuple[DataFrame, DataFrame] | None = None,
    optional_audits: tuple[DataFrame, DataFrame] | None = None,
    subset: DataFrame | None = None,
    require_subset: bool = False,
) -> DataFrame:
    """H8: all faults of a cleaned data set. ``flow`` is H2; ``expected`` maps summary columns
    (``packs, train_examples, heldout_tasks, generation_jobs``) to totals; ``subset`` holds the
    faults of an optional subset pack, which only warn unless it is required."""
    summary = frozen_summary(packs, examples, heldout)
    summary = summary.withColumn("generation_jobs", jobs.agg(F.count("*")).scalar())
    out = [flow, expectation_faults(summary, expected), frozen_faults(summary), job_log_differences(jobs, log)]
    if required_audits is not None:
        out.append(audit_file_faults(*required_audits))
    if optional_audits is not None:
        out.append(audit_file_faults(*optional_audits, severity="warning"))
    if subset is not None:
        out.append(subset if require_subset else subset.withColumn("severity", F.lit("warning")))
    return union_all(out)
