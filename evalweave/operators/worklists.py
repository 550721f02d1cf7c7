"""Joins that decide which evaluation work is left, and why some of it cannot run
(F3, F10, F17, F18, F21-F26)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalweave.functions.expr import count_where, has_text, id_part, label
from evalweave.functions.joins import one_row
from evalweave.operators.responses import kind
from evalweave.operators.text import truncate_evidence
from evalweave.sources.listing import latest_score_artifact

CELL = ["pack_id", "task_id", "mode"]


def _cells(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: id_part(c) for c in CELL})


def _full_key() -> Column:
    return (F.col("pack_id") != "") & (F.col("task_id") != "") & (F.col("mode") != "")


# -- F3 ---------------------------------------------------------------------------------------


def criteria(private: DataFrame, *, keys: Sequence[str], supervision: str = "supervision") -> DataFrame:
    """criteria of private rows, one per row: ``pos, group, index, requirement`` (JSON text).

    ``items`` or ``criteria`` when it is a non-empty list, else the checklist groups by name.
    """
    v = F.try_parse_json(supervision)
    as_list = lambda f: F.try_variant_get(v, f"$.{f}", "array<variant>")
    filled = lambda a: F.when(F.size(a) > 0, a)
    own = F.coalesce(filled(as_list("items")), filled(as_list("criteria")))
    shape = "array<struct<group:string,index:int,requirement:string>>"
    from_list = F.transform(
        own,
        lambda x: F.struct(F.lit(None).cast("string").alias("group"), F.lit(None).cast("int").alias("index"), F.to_json(x).alias("requirement")),
    )
    groups = F.array_sort(F.map_entries(F.transform_values(
        F.try_variant_get(v, "$.checklists", "map<string,variant>"),
        lambda k, g: F.transform(F.try_variant_get(g, "$", "array<variant>"), lambda x: F.to_json(x)),
    )))
    from_groups = F.flatten(F.transform(
        F.filter(groups, lambda e: e["value"].isNotNull()),
        lambda e: F.transform(
            e["value"],
            lambda x, i: F.struct(e["key"].alias("group"), (i + 1).cast("int").alias("index"), x.alias("requirement")),
        ),
    ))
    chosen = F.coalesce(from_list.cast(shape), from_groups.cast(shape))
    return private.select(*keys, F.posexplode(chosen).alias("pos", "c")).select(*keys, "pos", "c.*")


# -- F10 --------------------------------------------------------------------------------------


def score_bucket(text: Column) -> Column:
    """bucket of a result file from its path and all evaluator names, as one lower-case text."""
    has = lambda w: F.contains(F.lower(text), F.lit(w))
    return (
        F.when(has("pattern_similarity"), "debug_scores")
        .when(has("surrogate"), "surrogate_debug_scores")
        .when(has("official") | has("writingbench"), "official_benchmark_scores")
        .otherwise("debug_scores")
    )


def file_buckets(rows: DataFrame) -> DataFrame:
    """bucket per ``path``. Evaluator names are a handful of labels, gathered per file."""
    per_file = rows.groupBy("path").agg(F.collect_set(label("evaluator_kind")).alias("kinds"))
    return per_file.select("path", score_bucket(F.concat_ws(" ", "path", "kinds")).alias("score_bucket"))


def inferred_source(rows: DataFrame, names: Mapping[str, str], *, head: int = 20) -> DataFrame:
    """source per ``path``: the one non-empty ``source`` value, else a name found in the path
    or in evaluator and pack of the first ``head`` rows. ``names`` maps text to source, in order.
    """
    only = rows.groupBy("path").agg(
        F.min(F.when(id_part("source") != "", F.col("source"))).alias("lo"),
        F.max(F.when(id_part("source") != "", F.col("source"))).alias("hi"),
    )
    order = W.partitionBy("path").orderBy("seq")
    first = rows.select("path", "seq", "evaluator_kind", "pack_id").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= head)
    text = first.groupBy("path").agg(
        F.lower(F.concat_ws(" ", F.first("path"), F.concat_ws(" ", F.collect_list(F.concat_ws(" ", "evaluator_kind", "pack_id"))))).alias("text")
    )
    guess = None
    for needle, source in names.items():
        hit = F.contains("text", F.lit(needle.lower()))
        guess = F.when(hit, source) if guess is None else guess.when(hit, source)
    agreed = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    return only.join(text, "path", "left").select("path", F.coalesce(agreed, guess).alias("source"))


def row_judge_model(judge_model: Column, nested: Column, calls: Column) -> Column:
    """judge model from the row, its judge report or the first judge call that names one."""
    named = F.filter(calls, lambda m: id_part(m) != "")
    filled = lambda c: F.when(id_part(c) != "", c)
    return F.coalesce(filled(judge_model), filled(nested), F.get(named, F.lit(0)), F.lit("unknown"))


def solver_model(own: Column, nested: Column) -> Column:
    """solver model from the row, else from its generation."""
    filled = lambda c: F.when(id_part(c) != "", c)
    return F.coalesce(filled(own), filled(nested))


def mapped(mode: Column, mapping: Mapping[str, str]) -> Column:
    """A mode looked up in a fixed mapping (evaluation mode to skill mode); null when unknown."""
    entries = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*entries), mode) if entries else F.lit(None).cast("string")


# -- F17 --------------------------------------------------------------------------------------


def grounding_worklist(
    rows: DataFrame,
    packs: DataFrame,
    heldout: DataFrame,
    *,
    modes: Sequence[str] | None = None,
    pack_ids: Sequence[str] | None = None,
) -> DataFrame:
    """success rows with ``skip_reason`` null (a job) or the reason they are skipped."""
    kept = _cells(rows.filter(F.col("status") == "success"))
    if modes is not None:
        kept = kept.filter(F.col("mode").isin(list(modes)))
    if pack_ids is not None:
        kept = kept.filter(F.col("pack_id").isin(list(pack_ids)))
    known = packs.select(id_part("pack_id").alias("pack_id")).distinct().withColumn("has_pack", F.lit(True))
    tasks = heldout.select("pack_id", "task_id").distinct().withColumn("has_task", F.lit(True))
    joined = kept.join(known, "pack_id", "left").join(tasks, ["pack_id", "task_id"], "left")
    reason = (
        F.when(~has_text("text"), "empty_generation")
        .when(F.col("has_pack").isNull(), "missing_pack")
        .when(F.col("has_task").isNull(), "missing_heldout_task")
    )
    return joined.withColumn("skip_reason", reason).drop("has_pack", "has_task")


def heldout_evidence(tasks: DataFrame, materials: DataFrame, *, max_chars: int) -> DataFrame:
    """task input and materials of a task as one evidence text with a visible cut.

    ``materials``: ``pack_id, task_id, pos, path, text``. Only materials that start before the
    limit are gathered, since everything behind it is cut off.
    """
    from evalweave.functions.scan import blocked_scan

    keys = ["pack_id", "task_id"]
    numbered = blocked_scan(materials, keys, "pos", F.lit(1), "__idx")
    name = F.when(id_part("path") != "", F.col("path")).otherwise(F.concat(F.lit("material-"), (F.col("__idx") + 1).cast("string")))
    block = F.concat(
        F.lit("Material "), (F.col("__idx") + 1).cast("string"), F.lit(": "), name, F.lit("\n"), F.coalesce("text", F.lit(""))
    )
    blocks = numbered.withColumn("block", F.substring(block, 1, max_chars + 1)).withColumn("__len", F.length(block))
    started = blocked_scan(blocks, keys, "pos", F.col("__len") + 2, "__before").filter(F.col("__before") <= max_chars)
    texts = started.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("b"))
    head = F.concat(F.lit("Task input:\n"), F.coalesce("task_input", F.lit("")))
    out = tasks.join(texts, keys, "left")
    joined = F.concat_ws("\n\n", head, F.transform("b", lambda x: x["block"]))
    return out.select(*keys, truncate_evidence(joined, max_chars).alias("evidence"))


def grounding_summary(rows: DataFrame) -> DataFrame:
    """per mode (missing as empty), rows, successes and means of the three report fields."""
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    return rows.groupBy(id_part("mode").alias("mode")).agg(
        F.count("*").alias("n"),
        count_where(ok).alias("success"),
        *[F.avg(F.when(ok, F.col(c))).alias(f"mean_{c}") for c in ("grounding_score", "hallucination_risk", "unsupported_claim_count")],
    )


# -- F18, F24 ---------------------------------------------------------------------------------


def latest_candidates(rows: DataFrame, *, columns: Sequence[str] = ("text",), any_status: bool = False) -> DataFrame:
    """latest success row with text per fully keyed cell; ``any_status``: latest row at all."""
    rows = _cells(rows).filter(_full_key())
    if not any_status:
        rows = rows.filter((F.col("status") == "success") & F.col("text").isNotNull())
    newest = rows.groupBy(*CELL).agg(F.max("seq").alias("seq"))
    cols = [c for c in dict.fromkeys([*columns, "status"]) if c not in (*CELL, "seq")]
    return rows.join(newest, [*CELL, "seq"], "left_semi").select(*CELL, F.col("seq").alias("candidate_seq"), *cols)


def pattern_worklist(expected: DataFrame, candidates: DataFrame) -> DataFrame:
    """expected cells with their candidate, or ``missing_candidate_output``."""
    joined = expected.join(candidates, CELL, "left")
    status = F.when(F.col("candidate_seq").isNull(), "missing_candidate_output").otherwise("job")
    return joined.withColumn("state", status)


def pattern_rows(worklist: DataFrame, judged: DataFrame) -> DataFrame:
    """result rows of a worklist: the judged cells, and cells without a candidate under their state.

    ``judged``: cell columns, ``seq, status, overall_score``. Jobs that have not been judged give no row.
    """
    own = judged.join(worklist.filter("state = 'job'").select(*CELL), CELL, "left_semi").select(*CELL, "seq", "status", "overall_score")
    none = worklist.filter("state <> 'job'").select(
        *CELL, F.lit(0).cast("long").alias("seq"), F.col("state").alias("status"), F.lit(None).cast("double").alias("overall_score")
    )
    return own.unionByName(none)


def judge_swap(expected: DataFrame, source_rows: DataFrame) -> DataFrame:
    """cells that reuse the latest source row's text; an unusable one is
    ``missing_reused_candidate``."""
    latest = latest_candidates(source_rows, columns=["text"], any_status=True)
    joined = expected.join(latest, CELL, "left")
    usable = F.coalesce((F.col("status") == "success") & F.col("text").isNotNull(), F.lit(False))
    return joined.withColumn("state", F.when(usable, "job").otherwise("missing_reused_candidate"))


# -- F21 --------------------------------------------------------------------------------------


def audit_worklist(
    examples: DataFrame, private: DataFrame, *, scored_sources: Mapping[str, str], default_missing: str = "missing_benchmark_criteria"
) -> DataFrame:
    """train examples with the reason they cannot be audited, ``state`` = ``job`` otherwise.

    ``examples``: ``pack_id, example_id, source, output_status, output`` (status null: no output).
    ``private``: ``pack_id, task_ref, n_criteria``. ``scored_sources`` maps each auditable source
    to its status for missing criteria.
    """
    p = private.select("pack_id", F.col("task_ref").alias("example_id"), "n_criteria", F.lit(True).alias("has_private"))
    joined = examples.join(one_row(p, "pack_id", "example_id"), ["pack_id", "example_id"], "left")
    state = (
        F.when(F.col("output_status").isNull(), "missing_desired_output")
        .when(F.col("output_status") != "generated", "desired_output_not_generated")
        .when(~has_text("output"), "empty_desired_output")
        .when(F.col("has_private").isNull(), "missing_private_eval")
        .when(
            F.coalesce("n_criteria", F.lit(0)) == 0,
            F.coalesce(mapped(F.col("source"), scored_sources), F.lit(default_missing)),
        )
        .when(~F.coalesce(F.col("source").isin(list(scored_sources)), F.lit(False)), "unsupported_source_for_audit")
        .otherwise("job")
    )
    return joined.withColumn("state", state).drop("has_private")


def audit_status_by_source(rows: DataFrame) -> DataFrame:
    """rows per source and status."""
    return rows.groupBy(label("source").alias("source"), label("status").alias("status")).agg(F.count("*").alias("n"))


# -- F22 --------------------------------------------------------------------------------------


def official_scores(expected: DataFrame, artifacts: DataFrame) -> DataFrame:
    """expected cells with the status of their official score.

    ``artifacts``: one row per cell's result directory with ``has_slides``, ``has_failure_flag``,
    ``pick`` (the A6 outcome: ``found``, ``ambiguous`` or ``none``) and ``score_percent`` (null
    when the file could not be read).
    """
    joined = expected.join(artifacts, CELL, "left")
    present = F.coalesce(F.col("has_slides") | F.col("has_failure_flag"), F.lit(False))
    status = (
        F.when(~present, "missing_official_eval_artifacts")
        .when(F.col("pick") == "ambiguous", "ambiguous_score_artifacts")
        .when(F.coalesce("pick", F.lit("none")) == "none", "missing_score_artifact")
        .when(F.col("score_percent").isNull(), "score_parse_error")
        .otherwise("success")
    )
    return joined.withColumn("status", status).withColumn(
        "overall_score", F.when(F.col("status") == "success", F.col("score_percent"))
    )


# Names of the artifacts in a result directory.
SLIDES, FAILURE_FLAG = "slides", "slides_generation_failed.txt"


def artifacts_from_listing(files: DataFrame, scores: DataFrame, *, judge_model: str | None = None) -> DataFrame:
    """the artifacts of each cell from a listing of its result directory.

    ``files``: cell columns, ``result_dir, name``. ``scores``: ``result_dir, name, score_percent`` of score
    files that could be read. The score file is chosen by A6.
    """
    held = files.groupBy(*CELL, "result_dir").agg(
        F.max(F.startswith("name", F.lit(SLIDES + "."))).alias("has_slides"), F.max(F.col("name") == FAILURE_FLAG).alias("has_failure_flag")
    )
    picked = latest_score_artifact(files, judge_model=judge_model)
    read = one_row(scores.select("result_dir", "name", "score_percent"), "result_dir", "name")
    return held.join(picked, "result_dir").join(read, ["result_dir", "name"], "left").select(
        *CELL, "has_slides", "has_failure_flag", "pick", F.col("name").alias("score_file"), "score_percent"
    )


# -- F23 --------------------------------------------------------------------------------------


def compatible_success(rows: DataFrame, expected: DataFrame, *, judge_model: str, metadata: Mapping[str, object]) -> DataFrame:
    """success rows of expected cells made under exactly this judge and run metadata.

    ``metadata_json`` holds the row's recorded metadata. A field that is absent does not match,
    not even an expected null; a present null only matches null.
    """
    v = F.try_parse_json("metadata_json")
    same = F.col("judge_model").eqNullSafe(F.lit(judge_model))
    for name, want in metadata.items():
        got = F.try_variant_get(v, f"$.{name}", "variant")
        if want is None:
            ok = F.is_variant_null(got)
        elif isinstance(want, bool):
            ok = (kind(got) == "bool") & (F.try_variant_get(got, "$", "boolean") == F.lit(want))
        elif isinstance(want, (int, float)):
            ok = kind(got).isin("int", "number") & (F.try_variant_get(got, "$", "double") == F.lit(float(want)))
        else:
            ok = (kind(got) == "string") & (F.try_variant_get(got, "$", "string") == F.lit(str(want)))
        same = same & got.isNotNull() & F.coalesce(ok, F.lit(False))
    kept = _cells(rows).filter((F.col("status") == "success") & same)
    return kept.join(expected.select(*CELL).distinct(), CELL, "left_semi")


def stray_cells(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """distinct observed cells outside the expected matrix."""
    return _cells(rows).select(*CELL).distinct().join(expected.select(*CELL), CELL, "left_anti")


# -- F25 --------------------------------------------------------------------------------------


def eval_worklist(
    expected: DataFrame,
    completed: DataFrame,
    private: DataFrame,
    skills: DataFrame,
    *,
    skill_of_mode: Mapping[str, str],
    missing_names: Mapping[str, str],
    order: Sequence[str] = ("private", "criteria", "skill"),
    criteria_status: str = "missing_eval_criteria",
) -> DataFrame:
    """cells still to do, ``state`` = ``job`` or the first failed preflight check.

    ``private``: ``pack_id, task_id, n_criteria``. ``skills``: ``pack_id, skill_mode`` with text.
    ``skill_of_mode`` names the skill each mode needs; ``missing_names`` the status for some modes
    (``missing_skill`` otherwise). ``order`` is the order of the checks.
    """
    todo = expected.join(completed.select(*CELL).distinct(), CELL, "left_anti")
    p = private.select("pack_id", "task_id", "n_criteria", F.lit(True).alias("has_private"))
    s = skills.select("pack_id", "skill_mode").distinct().withColumn("has_skill", F.lit(True))
    needed = mapped(F.col("mode"), skill_of_mode)
    joined = (
        todo.withColumn("skill_mode", needed)
        .join(one_row(p, "pack_id", "task_id"), ["pack_id", "task_id"], "left")
        .join(s, ["pack_id", "skill_mode"], "left")
    )
    checks = {
        "private": (F.col("has_private").isNull(), F.lit("missing_private_eval")),
        "criteria": (F.coalesce("n_criteria", F.lit(0)) == 0, F.lit(criteria_status)),
        "skill": (
            F.col("skill_mode").isNotNull() & F.col("has_skill").isNull(),
            F.coalesce(mapped(F.col("mode"), missing_names), F.lit("missing_skill")),
        ),
    }
    state = None
    for name in order:
        cond, value = checks[name]
        state = F.when(cond, value) if state is None else state.when(cond, value)
    return joined.withColumn("state", state.otherwise(F.lit("job"))).select(*CELL, "skill_mode", "state")


# -- F26 --------------------------------------------------------------------------------------


def selected_skill_rows(
    rows: DataFrame, *, modes: Sequence[str], pack_ids: Sequence[str] | None = None, limit_packs: int | None = None
) -> DataFrame:
    """success rows in the modes, of the first ``limit_packs`` packs in arrival order."""
    kept = rows.filter((F.col("status") == "success") & (id_part("pack_id") != "") & F.col("mode").isin(list(modes)))
    if pack_ids:
        kept = kept.filter(F.col("pack_id").isin(list(pack_ids)))
    if limit_packs is None:
        return kept
    first = kept.groupBy("pack_id").agg(F.min("seq").alias("first")).orderBy("first").limit(limit_packs)
    return kept.join(first.select("pack_id"), "pack_id", "left_semi")
