"""Parsed responses, tokens, artifacts, disagreement, induction, gates, threads."""

import json
from functools import reduce

import pytest
from pyspark.sql import functions as F

from evalweave.operators import artifacts as A
from evalweave.operators import disagreement as D
from evalweave.operators import flow_audit as X
from evalweave.operators import induction as G
from evalweave.operators import packs as P
from evalweave.operators import readiness as R
from evalweave.operators import responses as E
from evalweave.operators import schema_rules as H
from evalweave.operators import threads as T
from evalweave.operators import tokens as K
from evalweave.operators import worklists as L
from evalweave.operators.splits import split_violations
from evalweave.operators.violations import status, union_all


def texts(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "id long, text string")


def test_criterion_scores(spark, rows):
    df = texts(spark, [
        '```json\n{"score": 8, "reason": "r"}\n```', '{"score": "7", "reason": "r"}', '{"score": true, "reason": "r"}', '{"score": 7.5, "reason": "r"}',
        'Answer: {"score": 3, "reason": "r"} ok', '{"score": 11, "reason": "r"}', '[1]', 'none', '{"score": 5}', '{"score":1,"reason":"r"} {"x":2}', '{"score": 8.0, "reason": "r"}',
    ])
    bad = "score_must_be_integer_1_to_10"
    assert rows(E.criterion_scores(df), "id", "parse_error") == [
        (0, None), (1, None), (10, bad), (2, bad), (3, bad), (4, None), (5, bad), (6, E.NOT_OBJECT), (7, E.NO_JSON), (8, "reason_must_be_string"), (9, E.NO_JSON),
    ]


def test_object_salvage_and_overall_score(spark, rows):
    df = texts(spark, ['x ```\n{"overall_score": "6.5"}\n``` {"overall_score": 1}', '{"overall_score": true}', 'pre {"overall_score": 4} post', '"text"', '{"overall_score": "n/a"}'])
    out = E.parse_object(df).withColumn("s", E.overall_score(F.col("report")))
    assert rows(out, "id", "s", "parse_error") == [(0, 6.5, None), (1, None, None), (2, 4.0, None), (3, None, E.NOT_OBJECT), (4, None, None)]


def test_grounding_pattern_plan_and_consistency_reports(spark, rows):
    g = texts(spark, ['{"grounding_score":5,"hallucination_risk":11,"unsupported_claim_count":1.5,"unsupported_claims":{}}'])
    assert rows(E.grounding_reports(g), "parse_error") == [("hallucination_risk_out_of_range;unsupported_claim_count_not_integer;unsupported_claims_not_list",)]
    good = {f: 5 for f in E.PATTERN_SCORES} | {"unsupported_pattern_risk": "low"} | {f: [] for f in E.PATTERN_LISTS}
    p = texts(spark, [json.dumps(good), json.dumps(good | {"unsupported_pattern_risk": "none"}), json.dumps(good | {E.PATTERN_SCORES[1]: 0})])
    assert rows(E.pattern_reports(p), "id", "parse_error") == [
        (0, None), (1, "unsupported_pattern_risk_must_be_low_medium_or_high"), (2, "structural_similarity_score_must_be_number_1_to_10"),
    ]
    plan = texts(spark, [json.dumps({"grounded_facts": ["a", " "], "generic_scaffolding": "x", "missing_specifics": [], "generation_constraints": [1]})])
    assert rows(E.plan_errors(plan).withColumn("e", F.array_join("errors", ",")), "e") == [
        ("grounded_facts_contains_non_string,generic_scaffolding_not_list,generation_constraints_contains_non_string",)
    ]
    c = {f: 9 for f in E.CONSISTENCY_SCORES} | {f: [] for f in E.CONSISTENCY_LISTS} | {"rationale": "r"}
    reps = texts(spark, [json.dumps(c), json.dumps(c | {"leakage_penalty": -1, "rationale": 3})])
    out = E.consistency_reports(reps).withColumn("e", F.array_join("errors", ","))
    assert rows(out, "id", "parse_error", "e") == [
        (0, None, ""), (1, "leakage_penalty_must_be_number_0_to_10", "leakage_penalty_must_be_number_0_to_10,rationale_must_be_string"),
    ]
    sig = texts(spark, ['{"abstract_example_signatures":[{"a":1},2,{"b":1}]}', "{}"])
    assert E.abstract_signatures(sig, ["id"]).count() == 2 and E.abstract_signatures(sig, ["id"], limit=1).count() == 1


USAGE = "struct<prompt_tokens:bigint,input_tokens:bigint,completion_tokens:bigint,output_tokens:bigint,total_tokens:bigint>"


def test_token_totals_count_failed_rows(spark, rows):
    schema = f"mode string, status string, layout_plan_usage {USAGE}, generation_usage {USAGE}, judge_usage {USAGE}, judge_call_usages array<{USAGE}>"
    df = spark.createDataFrame([
        ("m", "success", (4, None, 6, None, None), (5, None, 5, None, 10), (None, 3, None, 4, 7), [(5, None, 0, None, 0)]),
        ("m", "model_error", None, (4, None, 5, None, None), None, [(None, None, None, None, 10)]),
        ("base", "success", None, (8, None, 9, None, 17), None, None),
    ], schema)
    usage = K.token_usage(df)
    assert rows(usage.filter("mode = 'm'"), "bucket", "total_tokens", "total_tokens_per_attempt") == [
        ("combined", 51, 25.5), ("generation", 19, 9.5), ("judge", 22, 11.0), ("layout_plan", 10, 5.0)
    ]
    cmp = K.generation_comparison(usage, examples_only_mode="base").filter("field = 'total_tokens'")
    assert rows(cmp, "mode", "delta") == [("m", 2.0)]


def test_artifact_support_and_deltas(spark, rows):
    rep = json.dumps({"candidate_rules": [{"support_count": 3}, {"supporting_examples": ["a", "a", "b"]}, {"rule": "x"}, {"support_count": True}], "conflicts": [1]})
    md = "## Required rules\n- a\n- b\n## Optional rules\n- c"
    df = spark.createDataFrame([("p", "l", "success", 1, md, rep), ("p", "r", "success", 1, "", None), ("p", "r", "success", 2, md + "\n- d", None)],
                               "pack_id string, mode string, status string, seq long, skill_md string, report string")
    m = A.artifact_metrics(df)
    assert m.filter("mode = 'l'").first().support_counts == [3, 2]
    deltas = rows(A.artifact_deltas(m, left_mode="l", right_mode="r"), "field", "delta")
    assert ("optional_rules", 1) in deltas and ("conflicts_count", -1) in deltas


def test_disagreement_keeps_sign_changes_only(spark, rows):
    schema = "pack_id string, task_id string, mode string, status string, overall_score double, judge_model string, text string"
    def side(scores, note=""):
        return spark.createDataFrame([("p", "t", m, "success", s, "j", m + note) for m, s in scores.items()], schema)
    left, right = side({"base": 5.0, "a": 6.0, "b": 6.0, "c": 5.0}), side({"base": 5.0, "a": 4.0, "b": 7.0, "c": 6.0})
    out = D.disagreements(left, right, baseline_mode="base")
    assert rows(out, "mode", "disagreement_kind") == [("a", "sign_flip"), ("c", "sign_or_tie_disagreement")]
    assert D.output_mismatches(out).count() == 0
    assert D.output_mismatches(D.disagreements(left, side({"base": 5.0, "a": 4.0}, "!"), baseline_mode="base")).count() == 1
    assert D.duplicate_success_cells(left.union(left), "left").count() == 4


def test_rule_votes(spark, rows):
    v = spark.createDataFrame([("r", e, "supported") for e in "abca"] + [("s", e, "supported") for e in "ab"] + [("s", "c", "contradicted"), ("q", "a", "supported"), ("q", "b", "supported")],
                              "rule string, example_id string, vote string")
    totals = spark.createDataFrame([("r", 3), ("s", 3), ("q", 4)], "rule string, total long")
    assert rows(G.classify_rules(G.rule_support(v, totals)), "rule", "effective", "verdict") == [("q", 2, "optional"), ("r", 3, "required"), ("s", 1, "reject")]
    assert G.support_violations(G.rule_support(v, total_examples=2), F.col("rule")).count() == 1


def test_lessons_forms_and_ids(spark, rows):
    report = {"stable_features": ["a", {"rule": " r "}, {"feature": "f", "reason": "why"}, {"k": "é\"x", "b": [1, True]}, "a"]}
    reports = [{"example_id": "e1", "must_not_generalize": ["n"]}]
    df = spark.createDataFrame([("p", "m", "success", json.dumps(report), json.dumps(reports))], "pack_id string, mode string, status string, report string, feature_reports string")
    out = G.lessons_from_skills(df)
    assert {r.lesson for r in out.collect()} == {"a", "r", "f: why", json.dumps({"k": "é\"x", "b": [1, True]}, ensure_ascii=False, sort_keys=True), "n"}
    import hashlib
    for r in out.collect():
        payload = {"pack_id": r.pack_id, "mode": r.mode, "lesson_kind": r.lesson_kind, "lesson": r.lesson, "evidence_examples": sorted(r.evidence_examples)}
        assert r.memory_id == hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:24]


def test_folds_of_all_packs_whatever_their_size(spark, rows):
    ex = spark.createDataFrame([("big", str(i), i) for i in range(90)] + [("s", str(i), i) for i in range(3)] + [("tiny", "0", 0)], "pack_id string, example_id string, pos long")
    folds = G.leave_one_out(ex)
    assert rows(G.fold_counts(folds), "pack_id", "folds") == [("big", 90), ("s", 3)]
    assert folds.filter("pack_id = 'big' and validation_example_id = '4'").count() == 89 and folds.count() == 90 * 89 + 6


def test_schema_first_fault_and_absent_versus_null(spark, rows):
    ok = {"schema_version": "heldout-eval/v1", "status": "model_error", "pack_id": "p", "task_id": "t", "mode": "m", "evaluator_kind": "e", "overall_score": None}
    raws = [ok, {k: v for k, v in ok.items() if k != "overall_score"}, ok | {"overall_score": 3}, ok | {"status": "success", "overall_score": True}, ok | {"pack_id": "", "mode": ""}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raws)], "seq long, raw string")
    assert rows(H.schema_violations(df, "eval"), "entity_id", "detail") == [
        ("1", "missing required nullable field: overall_score"), ("2", "non-success overall_score must be null"),
        ("3", "success overall_score must be numeric"), ("4", "pack_id must be a non-empty string"),
    ]
    skill = [{"schema_version": "skill-induction/v1", "status": "induction_error", "pack_id": "p", "mode": "m", "model_calls": [], "skill_md": None, "error": "e"}]
    skill += [skill[0] | {"model_calls": {}}, skill[0] | {"status": "x"}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(skill)], "seq long, raw string")
    assert rows(H.schema_violations(df, "skills"), "entity_id", "detail") == [("1", "model_calls must be a list"), ("2", "unsupported skill row status: x")]
    with pytest.raises(ValueError):
        H.schema_violations(df, "other")


# -- the audit: one fault at a time ---------------------------------------------------------------


def flow(spark):
    prompt = "make it"
    sha = spark.range(1).select(F.sha2(F.lit(prompt), 256)).first()[0]
    df = spark.createDataFrame
    return dict(
        splits=df([("s", "A", "{}")], "split_id string, source string, domain string"),
        split_tasks=df([("s", "train", "A", "1"), ("s", "heldout", "A", "2")], "split_id string, role string, source string, source_id string"),
        packs=df([("p", "s", "A", "{}", X.ALLOWED_FIELDS, ["x"], '{"a":1}')], "pack_id string, split_id string, source string, domain string, can_use array<string>, must_not_use array<string>, payload string"),
        examples=df([("p", 0, "e", "A", "1", "generated", "out", "j", sha, "v")],
                    "pack_id string, pos long, example_id string, source string, source_task_id string, output_status string, output string, job_id string, prompt_sha256 string, prompt_template_version string"),
        heldout=df([("p", 0, "h", "A", "2", False)], "pack_id string, pos long, task_id string, source string, source_task_id string, has_output boolean"),
        private_rows=df([("p", "s", "A")], "pack_id string, split_id string, source string"),
        private_tasks=df([("p", "train", 0, "e", "A", "1", "{}", "{}"), ("p", "heldout", 0, "h", "A", "2", "{}", "{}")],
                         "pack_id string, role string, pos long, task_ref string, source string, source_task_id string, supervision string, judge string"),
        jobs=df([("j", "p", "e", "A", "1", sha, "v", prompt, 10)],
                "job_id string, pack_id string, example_id string, source string, source_task_id string, prompt_sha256 string, prompt_template_version string, prompt string, material_budget_chars int"),
        log=df([("j", sha, "p", "e", "A", "1", "v", 1, "success", "stop", "out")],
               "job_id string, prompt_sha256 string, pack_id string, example_id string, source string, source_task_id string, prompt_template_version string, seq long, status string, finish_reason string, desired_output string"),
        replayed=df([("e", prompt)], "example_id string, prompt string"),
        required_sources=("A",), template_version="v",
    )


MUTATIONS = [
    (lambda t: t | {"required_sources": ("A", "B")}, {"H2_missing_source"}),
    (lambda t: t | {"splits": t["splits"].withColumn("domain", F.lit("x"))}, {"H2_domain_differs"}),
    (lambda t: t | {"packs": t["packs"].withColumn("payload", F.lit('{"private_note":1}'))}, {"H2_private_key_in_pack"}),
    (lambda t: t | {"packs": t["packs"].withColumn("can_use", F.array(F.lit("heldout")))}, {"H2_boundary_required", "H2_boundary_extra"}),
    (lambda t: t | {"packs": t["packs"].unionByName(t["packs"])}, {"H2_duplicate_pack"}),
    (lambda t: t | {"heldout": t["heldout"].withColumn("has_output", F.lit(True))}, {"H2_heldout_has_output"}),
    (lambda t: t | {"heldout": t["heldout"].withColumn("source_task_id", F.lit("1"))}, {"H2_source_tasks_overlap", "H2_split_tasks_differ", "H2_private_source_id"}),
    (lambda t: t | {"heldout": t["heldout"].withColumn("task_id", F.lit("e"))}, {"H2_ids_overlap", "H2_private_refs_differ", "H2_private_source_id"}),
    (lambda t: t | {"private_rows": t["private_rows"].limit(0)}, {"H2_private_empty", "H2_private_row_missing"}),
    (lambda t: t | {"private_rows": t["private_rows"].withColumn("split_id", F.lit("zz"))}, {"H2_private_split_differs", "H2_private_split_missing"}),
    (lambda t: t | {"private_tasks": t["private_tasks"].withColumn("judge", F.lit(None).cast("string"))}, {"H2_private_content"}),
    (lambda t: t | {"private_tasks": t["private_tasks"].unionByName(t["private_tasks"])}, {"H2_duplicate_task_ref"}),
    (lambda t: t | {"examples": t["examples"].withColumn("output_status", F.lit("needs_generation"))}, {"H2_not_frozen"}),
    (lambda t: t | {"examples": t["examples"].withColumn("output", F.lit("a hidden checklist"))}, {"H2_output_leaks", "H2_log_text"}),
    (lambda t: t | {"examples": t["examples"].withColumn("job_id", F.lit(None).cast("string"))}, {"H2_no_job_id", "H2_orphan_job"}),
    (lambda t: t | {"jobs": t["jobs"].withColumn("prompt", F.lit("other"))}, {"H2_job_prompt_replay", "H2_job_sha_of_prompt"}),
    (lambda t: t | {"jobs": t["jobs"].withColumn("material_budget_chars", F.lit(0))}, {"H2_job_budget"}),
    (lambda t: t | {"jobs": t["jobs"].withColumn("prompt_template_version", F.lit("old"))}, {"H2_job_template", "H2_job_not_replayed"}),
    (lambda t: t | {"jobs": t["jobs"].unionByName(t["jobs"])}, {"H2_duplicate_job"}),
    (lambda t: t | {"jobs": None, "replayed": None}, {"H2_jobs_not_checked"}),
    (lambda t: t | {"log": t["log"].withColumn("status", F.lit("error"))}, {"H2_log_status"}),
    (lambda t: t | {"log": t["log"].limit(0)}, {"H2_log_missing"}),
    (lambda t: t | {"log": None}, {"H2_outputs_not_checked"}),
]


def test_a_sound_flow_has_no_violations(spark):
    assert X.audit_flow(X.FlowTables(**flow(spark))).collect() == []


GROUPS = {
    "table": X.table_rules, "pack": X.pack_rules, "task": X.task_rules, "output": X.output_rules, "private": X.private_rules,
}
OF_GROUP = {
    "table": {"missing_source", "packs_empty", "private_empty", "duplicate_pack", "duplicate_private_pack", "duplicate_job", "jobs_not_checked", "outputs_not_checked"},
    "pack": {"split_missing", "source_differs", "domain_differs", "boundary_required", "boundary_extra", "private_key_in_pack", "private_row_missing", "private_split_differs"},
    "task": {"ids_overlap", "source_tasks_overlap", "split_tasks_differ", "private_refs_differ", "private_source_id"},
    "private": {"heldout_has_output", "private_split_missing", "duplicate_task_ref", "private_content", "private_without_pack"},
}


def group_of(rule):
    name = rule.removeprefix("H2_")
    return next((g for g, rules in OF_GROUP.items() if name in rules), "output")


@pytest.mark.parametrize("i", range(len(MUTATIONS)))
def test_one_fault_gives_its_violations(spark, i):
    """Runs the rule groups the fault touches; the sound flow above runs all of them."""
    mutate, want = MUTATIONS[i]
    tables = X.FlowTables(**mutate(flow(spark)))
    found = union_all([v for g in sorted({group_of(r) for r in want}) for v in GROUPS[g](tables)])
    assert {r.rule_id for r in found.collect()} == want


def test_readiness_profiles(spark):
    df = spark.createDataFrame
    packs = df([("p", "A")], "pack_id string, source string")
    ex = df([("p", str(i), "generated", "o") for i in range(2)], "pack_id string, example_id string, output_status string, output string")
    held = df([("p", "t", 0)], "pack_id string, task_id string, pos int")
    skills = df([("p", "s1", "success", "# x")], "pack_id string, mode string, status string, skill_md string")
    ev = df([("p", "t", m, "success") for m in ("a", "b")], "pack_id string, task_id string, mode string, status string")
    inv = R.model_inventory(df([(["x"],)], "solver_models array<string>"), df([("success", ["x"], ["x"])], "status string, solver_models array<string>, judge_models array<string>"))
    def gate(profile, rows, **kw):
        out = R.readiness(profile, packs=packs, examples=ex, heldout=held, skills=skills, evals={"main": (rows, "A")}, **kw)
        return {r.rule_id for r in out.collect() if r.severity == "error"}, {r.rule_id for r in out.collect() if r.severity == "warning"}
    ok = R.Profile(("s1",), ("a", "b"))
    assert gate(ok, ev, inventory=inv) == (set(), {"H7_model_monoculture"})
    assert gate(R.Profile(("s1", "s2"), ("a", "b")), ev)[0] == {"H7_missing_skill_modes"}
    assert gate(ok, ev.limit(0))[0] == {"H7_main_missing"}
    assert gate(ok, ev.union(df([("p", "t", "a", "error")], ev.schema)))[0] == {"H7_main_incomplete"}
    assert gate(R.Profile(("s1",), ("a",), ("a",), require_official=True), ev, official=(ev.limit(0), "A"))[0] == {"H7_official_absent", "H7_official_missing"}
    faults = R.readiness(ok, packs=packs, examples=ex, heldout=held, skills=skills, evals={"main": (ev, "A")})
    assert status(faults).first().ok


def test_split_faults(spark):
    s = spark.createDataFrame([("s", "A", "p", "{}")], "split_id string, source string, learning_problem string, domain string")
    t = spark.createDataFrame([("s", "train", 0, "A", "1", "{}", "x", "{}", "{}"), ("s", "heldout", 0, "A", "1", "[]", " ", "{}", None)],
                              "split_id string, role string, pos long, source string, source_id string, domain string, task_input string, supervision string, judge string")
    got = {r.rule_id for r in split_violations(s, t).collect()}
    assert got == {"B6_duplicate_in_split", "B6_not_an_object", "B6_blank_task_input", "B6_missing_task_field"}
    assert {r.rule_id for r in split_violations(s.limit(0), t.limit(0)).collect()} == {"B6_empty"}


def test_threads(spark, rows):
    c = spark.createDataFrame([("o/r", 1, 7, "old.py", "please rename this", "@@", "2020-01-01"), ("o/r", 1, 8, "none.py", "x", "@@", "2020-01-01")],
                              "repo string, pr_number long, comment_id long, path string, body string, diff_hunk string, merged_at string")
    f = spark.createDataFrame([("o/r", 1, 0, "new.py", "old.py", "@@ -3 +5 @@\nx"), ("o/r", 1, 1, "old.py", None, "@@ -1,2 +9,4 @@")],
                              "repo string, pr_number long, pos long, filename string, previous_filename string, patch string")
    t = T.classify_threads(T.slice_threads(c, f))
    assert rows(t, "thread_id", "line_start", "line_end", "thread_kind", "path_cluster", "confidence") == [("o/r#1/review_7", 5, 6, "mechanical_followup", "general", 0.5)]
    assert rows(T.thread_drop_reason(t.withColumn("review_signal", F.lit("Thanks a lot!"))), "drop_reason") == [("social",)]


def test_prompt_rendering_and_resume_metadata(spark, rows):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(P.render("<{x}|{y}|{z}>", {"x": F.col("x"), "y": F.col("y")}).alias("p")).first().p == "<a||{z}>"
    cell = ("p", "t", "m")
    runs = spark.createDataFrame([(*cell, "success", "j", m, i) for i, m in enumerate(['{"a":1,"b":null}', '{"a":1}', '{"a":true,"b":null}', '{"a":1.0,"b":null}'])],
                                 "pack_id string, task_id string, mode string, status string, judge_model string, metadata_json string, seq long")
    want = spark.createDataFrame([cell], "pack_id string, task_id string, mode string")
    assert rows(L.compatible_success(runs, want, judge_model="j", metadata={"a": 1, "b": None}), "seq") == [(0,), (3,)]


def test_repeated_private_rows_do_not_multiply_worklists(spark, rows):
    examples = spark.createDataFrame(
        [("p", "e", "s", "generated", "text")], "pack_id string, example_id string, source string, output_status string, output string"
    )
    private = spark.createDataFrame([("p", "e", 0), ("p", "e", 2), ("p", "e", 1)], "pack_id string, task_ref string, n_criteria int")
    got = L.audit_worklist(examples, private, scored_sources={"s": "missing"})
    assert rows(got, "example_id", "n_criteria", "state") == [("e", 2, "job")]


def test_lesson_from_an_object_with_a_long_string(spark):
    from evalweave.operators.induction import spaced_json

    long = "x" * 100_000 + r"\n,:\"" * 30_000
    df = spark.createDataFrame([('{"a":"%s","b":[1,2]}' % long,)], "t string")
    assert df.select(spaced_json(F.col("t")).alias("s")).first().s == '{"a": "%s", "b": [1, 2]}' % long


def test_flow_audit_moves_faults_not_rows_between_its_joins(spark, rows):
    """H2 on odd tables: every rule once, roles beyond the two, empty and null ids; no join result carries both sides on."""
    from evalweave.operators import flow_audit as X

    text = "pack_id string, pos int, example_id string, source string, source_task_id string, output_status string, output string, job_id string, prompt_sha256 string, prompt_template_version string"
    examples = spark.createDataFrame([
        ("p1", 0, "e1", "a", "1", "generated", "t", "j1", "x", "v"), ("p1", 1, "e2", "a", "2", "generated", "t", "", "", "v"),
        ("p2", 0, "e3", "b", "3", "generated", "t", "j3", "x", "v"), ("p3", 0, "e4", "c", "4", "generated", "t", None, None, "v"),
    ], text)
    heldout = spark.createDataFrame([("p1", 0, "e1", "a", "1", False)], "pack_id string, pos int, task_id string, source string, source_task_id string, has_output boolean")
    private = spark.createDataFrame([
        ("p1", "train", 0, "e1", "a", "1", "{}", "{}"), ("p1", "train", 1, "e1", "a", "1", "{}", "{}"), ("p1", "extra", 2, "e9", "a", "9", "{}", "{}"),
        ("p2", "train", 0, "e3", "b", None, "{}", "{}"), ("p9", "train", 0, "e9", "b", "9", "{}", "{}"),
    ], "pack_id string, role string, pos int, task_ref string, source string, source_task_id string, supervision string, judge string")
    jobs = spark.createDataFrame([
        ("j1", "p1", "e1", "a", "1", "x", "v", "prompt", 1), ("", "p", "e", "a", "1", "x", "v", "prompt", 1), ("j3", "p2", "e3", "other", "3", "y", "v", "prompt", 0),
    ], "job_id string, pack_id string, example_id string, source string, source_task_id string, prompt_sha256 string, prompt_template_version string, prompt string, material_budget_chars int")
    t = X.FlowTables(
        splits=spark.createDataFrame([("s1", "a", "d"), ("s2", "b", "d")], "split_id string, source string, domain string"),
        split_tasks=spark.createDataFrame([("s1", "train", "a", "1"), ("s1", "extra", "a", "7"), ("s2", "train", "b", "3")], "split_id string, role string, source string, source_id string"),
        packs=spark.createDataFrame([("p1", "s1", "a", "d"), ("p2", "s2", "b", "d"), ("p3", "gone", "c", "d")], "pack_id string, split_id string, source string, domain string")
        .selectExpr("*", "array('train_examples.desired_output.text') AS can_use", "array('x') AS must_not_use"),
        examples=examples, heldout=heldout, private_rows=private.select("pack_id", "source").distinct().selectExpr("pack_id", "'s1' AS split_id", "source"),
        private_tasks=private, jobs=jobs, template_version="v",
    )
    got = rows(X.union_all([*X.task_rules(t), *X.output_rules(t)]), "rule_id", "severity", "entity_id", "detail")
    assert got == sorted([
        ("H2_source_tasks_overlap", "error", "p1", "a/1"), ("H2_ids_overlap", "error", "p1", "e1"),
        ("H2_split_tasks_differ", "error", "p1", "train"), ("H2_split_tasks_differ", "error", "p1", "heldout"), ("H2_split_tasks_differ", "error", "p1", "extra"),
        ("H2_duplicate_task_ref", "error", "p1.train", "e1"), ("H2_private_refs_differ", "error", "p1", "train"),
        ("H2_private_refs_differ", "error", "p1", "heldout"), ("H2_private_refs_differ", "error", "p1", "extra"), ("H2_private_source_id", "error", "p1", "extra.e9"),
        ("H2_private_source_id", "error", "p2", "train.e3"),
        ("H2_no_job_id", "error", "p1/e2", ""), ("H2_no_job_id", "error", "p3/e4", ""), ("H2_orphan_job", "warning", "", ""),
        ("H2_job_sha_of_prompt", "error", "p1/e1", ""), ("H2_job_sha_of_prompt", "error", "p2/e3", ""), ("H2_job_source", "error", "p2/e3", ""),
        ("H2_job_prompt_sha256", "error", "p2/e3", ""), ("H2_job_budget", "error", "p2/e3", ""),
    ])
    plan = X.output_rules(t)[0]._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]  # what stands over the last join
    assert "j_pack_id" not in above and "prompt" not in above


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_consistency_report_is_parsed_once_and_behind_the_deal(spark, rows):
    good = '{"%s":3,"matched_constraints":[],"missing_or_distorted_constraints":[],"rationale":"r"}' % '":3,"'.join(E.CONSISTENCY_SCORES)
    data = [("p", "m", "success", 1, good), ("p", "m", "success", 2, "[1]"), ("p", "m", "success", 3, "{"), ("p", "m", "error", 4, good)]
    df = spark.createDataFrame(data, "pack_id string, mode string, status string, seq long, judge_report string")
    bad = A.invalid_consistency_rows(A.consistency_rows(df.repartition(3, "seq")))
    assert rows(bad, "seq", "errors") == [(2, ["judge_report_must_be_object"]), (3, ["judge_report_must_be_object"])]
    plan = plan_of(bad)
    assert plan.count("parse_json(") + plan.count("parseJson") == 1
    assert plan.index("arse") < plan.index("Repartition")


def test_schema_rules_read_each_field_once(spark):
    df = spark.createDataFrame([(1, "{}")], "seq long, raw string")
    for row_kind in H.RULES:
        plan = plan_of(H.schema_violations(df, row_kind))
        fields = H.Fields()
        H.RULES[row_kind](fields)
        assert plan.count("variant_get(") <= len(fields.kinds) + len(fields.texts)


def test_split_ids_and_tasks_are_grouped_behind_the_deal(spark, rows):
    s = spark.createDataFrame([(i, "A", "p", "{}") for i in ("s", "s", "u")], "split_id string, source string, learning_problem string, domain string")
    t = spark.createDataFrame([(i, r, p, "A", "1", "{}", "x", "{}", "{}") for i in "su" for r, p in (("train", 0), ("heldout", 1))],
                              "split_id string, role string, pos long, source string, source_id string, domain string, task_input string, supervision string, judge string")
    found = split_violations(s, t.filter("split_id = 's' or role = 'train'"), partitions=7)
    assert rows(found, "rule_id", "entity_id", "detail") == [
        ("B6_duplicate_across_splits", "A/1", "2"), ("B6_duplicate_in_split", "s", "A/1"), ("B6_duplicate_split_id", "s", ""), ("B6_empty_role", "u", "heldout"),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # No grouping by split has a shuffle of its own, whose parts would be as many as the session says.
    own = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "split_id" in x and "REPARTITION_BY_NUM" not in x]
    assert own == [] and "REPARTITION_BY_NUM" in plan


def test_coverage_issues_take_one_shuffle_and_follow_coverage(spark):
    data = [(p, t, m, s) for p in ("p", "q", "") for t in ("t", "u", None) for m, s in [("a", "success"), ("b", None if t == "u" else "success"), ("a", "success"), ("", "x")]]
    data += [("r", "t", "a", "success"), ("s", "t", "z", "success"), ("v", "t", "a", "success"), ("v", "t", "b", "success"), ("v", "t", "c", "error")]
    rows = spark.createDataFrame(data, "pack_id string, task_id string, mode string, status string")
    want = spark.createDataFrame([("p", "t"), ("p", "t"), ("q", "w"), ("gone", "t"), ("s", "t")], "pack_id string, task_id string")
    for complete in (True, False):
        out = reduce(lambda a, b: a.unionByName(b), R.coverage_issues(rows, want, required=("a", "b"), name="n", severity="error", complete=complete))
        cov = R.eval_coverage(rows, required=("a", "b"))
        faults = {("H7_n_incomplete", f"{r.pack_id}::{r.task_id}") for r in cov.filter("not ready").collect()}
        if complete:
            faults |= {("H7_n_missing", "q::w"), ("H7_n_missing", "gone::t")}
        assert sorted((r.rule_id, r.entity_id) for r in out.collect()) == sorted(faults)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan and "collect_" not in plan and plan.count("HashAggregate") == 2, plan


def test_flow_audit_holds_the_shuffles_of_one_part_at_a_time(spark, rows):
    """What is left of the audit when it is read has no join or grouping; its violations are those of the lazy rules."""
    t = flow(spark)
    t |= {"heldout": t["heldout"].withColumn("source_task_id", F.lit("1")), "jobs": t["jobs"].withColumn("prompt", F.lit("other")),
          "log": t["log"].withColumn("status", F.lit("error")), "packs": t["packs"].unionByName(t["packs"])}
    tables = X.FlowTables(**t)
    columns = "rule_id", "severity", "entity_id", "detail"
    lazy = union_all([*X.table_rules(tables), *X.pack_rules(tables), *X.task_rules(tables), *X.output_rules(tables), *X.private_rules(tables)])
    audit = X.audit_flow(tables)
    assert rows(audit, *columns) == rows(lazy, *columns) and len(rows(audit, *columns)) > 6
    assert "Join" not in plan_of(audit) and "Aggregate" not in plan_of(audit)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_pairs_with_one_name_overlap_and_are_yet_compared_by_their_parts(spark, rows):
    t = flow(spark)
    t |= {
        "split_tasks": spark.createDataFrame([("s", "train", "a/b", "c"), ("s", "heldout", "a", "b/c"), ("s", None, "x", "y"), ("s", "extra", "x", "y")], t["split_tasks"].schema),
        "examples": t["examples"].withColumn("source", F.lit("a")).withColumn("source_task_id", F.lit("b/c")),
        "heldout": t["heldout"].withColumn("source", F.lit("a")).withColumn("source_task_id", F.lit("b/c")),
    }
    pairs = X.task_rules(X.FlowTables(**t))[0]
    assert rows(pairs, "rule_id", "entity_id", "detail") == [
        ("H2_source_tasks_overlap", "p", "a/b/c"), ("H2_split_tasks_differ", "p", "extra"), ("H2_split_tasks_differ", "p", "train"),
    ]
    assert "collect_list" not in plan_of(pairs)


def test_jobs_and_log_meet_in_one_grouping_whatever_the_hash(spark, rows):
    good = "0123456789abcdef" * 4
    keys = [good, good.upper(), good[:-1], "=" * 33, "é" * 16, "bad", good[:-1] + "g"]
    jobs = spark.createDataFrame([("j", k) for k in keys] + [("j", good), ("", good), ("k", None)], "job_id string, prompt_sha256 string")
    log = spark.createDataFrame(
        [("j", good, 1, "error"), ("j", good, 2, "success"), ("j", "bad", 5, None), ("j", keys[1], None, "success"), ("l", "é", 1, "late"), ("l", good, 1, "success")],
        "job_id string, prompt_sha256 string, seq int, status string")
    found = R.job_log_differences(jobs, log)
    without = [("H8_job_without_log", f"j/{k}", "") for k in keys if k not in (good, "bad")]
    assert rows(found, "rule_id", "entity_id", "detail") == sorted([
        *without, ("H8_latest_not_success", "j/bad", ""), ("H8_latest_not_success", "l/é", "late"), ("H8_log_without_job", "l/é", ""), ("H8_log_without_job", f"l/{good}", ""),
    ])
    assert "Join" not in plan_of(found)
