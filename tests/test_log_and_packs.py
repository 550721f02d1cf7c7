"""Generation log, packs, splits, sources, stream."""

import pytest
from pyspark.sql import functions as F

from evalweave.functions.scan import blocked_scan
from evalweave.operators import batch_inference as I
from evalweave.operators import genlog as G
from evalweave.operators import packs as P
from evalweave.operators import splits as X
from evalweave.operators.violations import ViolationsFound, fail_if_any
from evalweave.sources import jsonl as J
from evalweave.sources import listing as L
from evalweave.streaming import log_view as V

LOG = "job_id string, prompt_sha256 string, seq long, status string, finish_reason string, desired_output string, prompt_template_version string, model string"


def log(spark):
    return spark.createDataFrame([
        ("a", "h1", 1, "success", "stop", "old", "v", "m"), ("a", "h1", 2, "success", "stop", "new", "v", "m"),
        ("b", "h1", 3, "success", "stop", "x", "v", "m"), ("b", "h2", 4, "error", None, None, "v", "m"),
        ("c", "h1", 5, "rejected_private_leak", "stop", None, "v", "m"), ("d", "h1", 6, "success", "length", "cut", "v", "m"),
        ("e", "h1", 7, "success", "stop", "the hidden rubric", "v", "m"), ("f", "h1", 8, "success", "stop", "t", "w", "m"),
        (None, "h1", 9, "success", "stop", "t", "v", "m"), ("g", None, 10, "success", "stop", "t", "v", "m"),
    ], LOG)


def test_latest_and_pending(spark, rows):
    assert ("a", "h1", "new") in rows(G.latest_rows(log(spark)), "job_id", "prompt_sha256", "desired_output")
    assert rows(G.failed_keys(log(spark)), "job_id", "status") == [("b", "error"), ("c", "rejected_private_leak")]
    jobs = spark.createDataFrame([("a", "h1", 0), ("b", "h2", 1), ("z", "h1", 2)], "job_id string, prompt_sha256 string, seq long")
    assert rows(G.pending_jobs(jobs, log(spark)), "job_id") == [("b",), ("z",)]
    assert rows(G.pending_jobs(jobs, log(spark), limit=1), "job_id") == [("b",)]


def test_freeze_reasons_and_gate(spark, rows):
    ex = spark.createDataFrame(
        [("p", j, j, s, "v") for j, s in [("a", "h1"), ("b", "h9"), ("c", "h1"), ("d", "h1"), ("e", "h1"), ("f", "h1"), ("z", "h1")]],
        "pack_id string, example_id string, job_id string, prompt_sha256 string, prompt_template_version string",
    )
    out = G.freeze_outcomes(ex, log(spark))
    assert rows(out, "job_id", "outcome") == [
        ("a", "applied"), ("b", "missing_or_non_stop_finish_reason"), ("c", "empty_or_non_string_desired_output"),
        ("d", "missing_or_non_stop_finish_reason"), ("e", "private_leak_matches"), ("f", "prompt_template_version_mismatch"), ("z", "missing"),
    ]
    assert rows(G.freeze_counts(out), "applied", "missing", "rejected") == [(1, 1, 5)]
    with pytest.raises(ViolationsFound):
        fail_if_any(G.freeze_blockers(out))
    fail_if_any(G.freeze_blockers(out.filter("job_id in ('a', 'z')"), allow_missing=True))


def test_stale_prompt_is_a_mismatch_and_not_missing(spark, rows):
    ex = spark.createDataFrame([("p", "a", "a", "other", "v")], "pack_id string, example_id string, job_id string, prompt_sha256 string, prompt_template_version string")
    assert rows(G.freeze_outcomes(ex, log(spark)), "outcome") == [("prompt_sha256_mismatch",)]


def test_blocked_scan_equals_plain_window(spark, rows):
    df = spark.createDataFrame([("g" if i % 4 else "h", i, i % 7) for i in range(500)], "g string, pos long, v long")
    got = rows(blocked_scan(df, ["g"], "pos", F.col("v"), "s", block=16), "g", "pos", "s")
    want, acc = [], {}
    for i in range(500):
        g = "g" if i % 4 else "h"
        want.append((g, i, acc.get(g, 0)))
        acc[g] = acc.get(g, 0) + i % 7
    assert sorted(got) == sorted(want)


def python_context(items, budget):
    left, out = budget, []
    for path, text in items:
        if left <= 0:
            break
        cut = text[:left].strip()
        out.append(f"## Material: {path} (extracted)" + (f"\n{cut}" if cut else ""))
        left -= len(cut)
    return "\n\n".join(out)


def test_material_context_is_the_exact_fold(spark):
    cases = {
        "plain": ["alpha beta", "gamma delta", "eps"], "cut at a blank": ["aaaa bbbb", "cccc", "dd"], "blank texts": ["  ", "x", "   ", "yyyyyyyyyyyyy", "z"],
        "leading blanks": ["   abc   ", "    defghijkl", " m"], "long": ["word " * 30, "tail"], "tail blanks": ["abcd          ", "          e", "f", "g"],
        "many": [f"{i} " for i in range(40)],
    }
    data = [(o, i, f"m{i}", "extracted", t) for o, ts in cases.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(data, "owner_id string, pos long, path string, status string, text string")
    for budget in (1, 3, 5, 9, 12, 30):
        got = {r.owner_id: r.context for r in P.material_context(df, max_chars=budget, block=4).collect()}
        want = {o: python_context([(f"m{i}", t) for i, t in enumerate(ts)], budget) for o, ts in cases.items()}
        assert got == want, budget


def test_group_selection_and_split_roles(spark, rows):
    data = [(str(i), "d" if i < 9 else "e", "x", "en") for i in range(13)]
    tasks = spark.createDataFrame(data, "source_id string, domain1 string, domain2 string, lang string")
    out = X.few_shot_split(tasks, train_size=3, heldout_size=2, max_groups=5)
    assert rows(out.groupBy("split_id", "role").count(), "split_id", "role", "count") == [("tasks::d::x::en", "heldout", 2), ("tasks::d::x::en", "train", 3)]
    s = X.group_selection_summary(X.group_sizes(tasks), train_size=3, heldout_size=2, max_groups=1).first()
    assert (s.total_groups, s.eligible_groups, s.selected_groups, s.skipped_too_small, s.largest_group_sizes) == (2, 1, 1, 1, [9, 4])


def test_hot_group_is_cut_before_the_shuffle(spark):
    tasks = spark.range(1000).select(F.col("id").cast("string").alias("source_id"), (F.col("id") % 2).cast("string").alias("domain1"), (F.col("id") % 3).cast("string").alias("domain2"), (F.col("id") % 5).cast("string").alias("lang"))
    plan = X.few_shot_split(tasks, train_size=3, heldout_size=2, max_groups=5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_lenient_tail_and_line_numbers(spark, rows, tmp_path):
    f = tmp_path / "log.jsonl"
    f.write_text('{"a":1}\n\n[2]\n{"a":3}\n{"a":4\n\n', encoding="utf-8")
    g = tmp_path / "other.jsonl"
    g.write_text('{bad\n{"a":5}\n', encoding="utf-8")
    scan = J.scan_lines(spark, [str(f), str(g)])
    assert rows(J.good_rows(scan, "a long"), "line", "a") == [(1, 1), (2, 5), (4, 3)]
    name = F.element_at(F.split("entity_id", "/"), -1)
    strict = J.strict_violations(scan).withColumn("e", name)
    assert rows(strict, "e", "detail") == [("log.jsonl:3", "not_object"), ("log.jsonl:5", "bad_json"), ("other.jsonl:1", "bad_json")]
    lenient = J.lenient_violations(scan).withColumn("e", name)
    assert rows(lenient, "e", "severity") == [("log.jsonl:3", "error"), ("log.jsonl:5", "warning"), ("other.jsonl:1", "error")]


def test_line_numbers_over_several_splits(spark, rows, tmp_path):
    f = tmp_path / "big.jsonl"
    f.write_text("".join("\n" if i % 10 == 3 else f'{{"a":{i}}}\n' for i in range(5000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = rows(J.good_rows(J.scan_lines(spark, str(f)), "a long"), "a", "line")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == [(i, i + 1) for i in range(5000) if i % 10 != 3]


def test_missing_file_is_a_blocker(spark, rows, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"a":1}\n', encoding="utf-8")
    merged, missing = J.merge_files(spark, [str(f), str(tmp_path / "none.jsonl")])
    assert merged.count() == 1 and missing.count() == 1
    assert rows(J.with_seq(J.good_rows(merged).withColumn("file_ordinal", F.lit(0))), "seq") == [(1,)]


def test_case_tree(spark, rows, tmp_path):
    case = tmp_path / "edu" / "set" / "case1"
    (case / "generation_task").mkdir(parents=True)
    (case / "generation_task" / "instructions.md").write_text("do")
    (case / "material_1.md").write_text("text")
    (case / "material.pdf").write_text(L.POINTER_PREFIX + "v1\n")
    (case / "notes.md").write_text("n")
    mats = L.case_materials(L.list_files(spark, str(tmp_path)))
    assert rows(mats, "case", "collection", "material", "is_pointer") == [
        ("edu/set/case1", "set", "material.pdf", True), ("edu/set/case1", "set", "material_1.md", False)
    ]
    assert rows(L.inventory_totals(mats), "category", "cases", "material_files", "pointer_files") == [("edu", 1, 2, 1)]


def test_score_artifacts(spark, rows):
    files = spark.createDataFrame([
        ("new", "j_2026-01-01_00-00-00_score.yaml"), ("new", "j_2026-02-01_00-00-00_score.yaml"), ("mix", "j_2026-01-01_00-00-00_score.yaml"),
        ("mix", "k_2026-01-02_00-00-00_score.yaml"), ("one", "plain_score.yaml"), ("two", "a_score.yaml"), ("two", "b_score.yaml"), ("none", "readme.md"),
    ], "result_dir string, name string")
    assert rows(L.latest_score_artifact(files), "result_dir", "pick", "name") == [
        ("mix", "ambiguous", None), ("new", "found", "j_2026-02-01_00-00-00_score.yaml"), ("none", "none", None), ("one", "found", "plain_score.yaml"), ("two", "ambiguous", None),
    ]
    assert ("mix", "found", "k_2026-01-02_00-00-00_score.yaml") in rows(L.latest_score_artifact(files, judge_model="k"), "result_dir", "pick", "name")


def test_batch_inference_captures_failures(spark, rows):
    def call(prompt):
        if "bad" in prompt:
            raise RuntimeError("boom")
        return {"text": prompt[::-1], "finish_reason": "stop", "model": "m"}

    jobs = spark.createDataFrame([("a", "h", "abc"), ("b", "h", "bad")], "job_id string, prompt_sha256 string, prompt string")
    assert rows(I.run_jobs(jobs, call, concurrency=2), "job_id", "text", "error") == [("a", "cba", None), ("b", None, "RuntimeError: boom")]


def test_stream_state_equals_batch(spark, rows, tmp_path):
    full = log(spark).select("job_id", "prompt_sha256", "seq", "status").repartition(4)
    full.write.json(str(tmp_path / "log"))
    stream = V.read_log_stream(spark, str(tmp_path / "log"), full.schema, files_per_trigger=1)
    query = (
        V.latest_view(stream, ["status"]).writeStream.outputMode("complete").format("memory").queryName("latest_view")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    cols = ("job_id", "prompt_sha256", "seq", "status")
    want = rows(G.latest_rows(full), *cols)
    assert rows(spark.table("latest_view"), *cols) == want
    V.upsert_stream(V.read_log_stream(spark, str(tmp_path / "log"), full.schema, files_per_trigger=1), str(tmp_path / "view"), str(tmp_path / "c"), bucket_keys=2).awaitTermination()
    assert rows(V.current_view(spark, str(tmp_path / "view"), full.schema), *cols) == want


def files_of(folder):
    return {str(p) for p in folder.rglob("*.parquet")}


def test_view_opens_and_keeps_current_files_only(spark, rows, tmp_path):
    view, names = tmp_path / "view", ("job_id", "prompt_sha256", "seq", "status")
    schema = "job_id string, prompt_sha256 string, seq long, status string"
    want, sizes = {}, []
    for batch in range(9):
        data = [(f"j{(batch * 7 + i) % (20 + 12 * batch)}", "p", batch * 100 + i // 2, f"s{batch}.{i % 3}") for i in range(30)]
        data += [data[0]] * 3  # repeated rows of one seq
        df = spark.createDataFrame(data, schema)
        for _ in range(1 + batch % 2):  # every other batch runs twice, as after a failure
            V.merge_batch(df, batch, str(view), bucket_keys=16)
        for j, p, seq, status in data:
            want[j, p] = max(want.get((j, p), (-1, "")), (seq, status))
        now = V.current_view(spark, str(view), df.schema)
        assert rows(now, *names) == sorted((j, p, *v) for (j, p), v in want.items())
        manifest, _ = V._manifest(spark, str(view), None)
        opened = {f.removeprefix("file://") for f in now.inputFiles()}
        assert len({(m.home, m.slot) for m in manifest}) >= len(opened) and opened <= files_of(view)
        sizes.append((manifest[0].buckets, len(manifest), len(files_of(view))))
    assert sizes[0][0] < sizes[-1][0] and all(buckets >= n for buckets, n, _ in sizes)
    # Two versions of a bucket at most, and what two doublings have left behind, emptied.
    full = [f for f in files_of(view) if spark.read.parquet(f).count()]
    assert len(full) <= 2 * sizes[-1][1]


def test_blank_materials_are_gathered_in_blocks(spark):
    n = 1_000_000
    blanks = spark.range(n).select(F.lit("o").alias("owner_id"), (F.col("id") + 1).alias("pos"), F.lit("b").alias("path"), F.lit("x").alias("status"), F.lit("  ").alias("text"))
    ends = spark.createDataFrame([("o", 0, "first", "x", "abc"), ("o", n + 1, "last", "x", "defgh"), ("o", n + 2, "never", "x", "z")], blanks.schema)
    context = P.material_context(blanks.unionByName(ends), max_chars=5).first().context
    header = "## Material: b (x)\n\n"
    assert context == "## Material: first (x)\nabc\n\n" + header * n + "## Material: last (x)\nde"


def test_texts_of_responses_and_superseded_rows_are_not_shuffled(spark, rows):
    from evalweave.operators import genlog as G

    jobs = spark.createDataFrame([("j", "x", "p", "e")], "job_id string, prompt_sha256 string, pack_id string, example_id string")
    responses = spark.createDataFrame([
        ("j", "x", "fine", "stop", None), ("j", "x", "a hidden rubric", "stop", None), ("j", "x", None, "stop", "timeout"), ("other", "x", "t", "stop", None),
    ], "job_id string, prompt_sha256 string, text string, finish_reason string, error string")
    out = G.classify_responses(jobs, responses)
    assert rows(out, "status", "desired_output") == [("error", None), ("rejected_private_leak", None), ("success", "fine")]
    plan = out.drop("desired_output")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.lower().index("rubric")  # judged below the join

    log = spark.createDataFrame([
        ("j", "x", 1, "success", "stop", "old"), ("j", "x", 2, "success", "stop", "new"), ("k", "x", 3, "success", "stop", "old"), ("k", "x", 4, "error", "stop", None), ("", "x", 5, "success", "stop", "t"),
    ], "job_id string, prompt_sha256 string, seq long, status string, finish_reason string, desired_output string")
    latest = G.latest_success(log)
    assert rows(latest, "seq", "desired_output") == [(2, "new")]
    assert "getbit" in latest._jdf.queryExecution().optimizedPlan().toString().lower()
