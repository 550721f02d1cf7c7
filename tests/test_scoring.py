"""Score cells: literal cases and invariance under partitioning and row order."""

import pytest
from pyspark.sql import functions as F

from evalweave.operators import scoring as S

SCHEMA = "pack_id string, task_id string, mode string, status string, overall_score double, seq long"


def make(spark, data):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(data)], SCHEMA)


def cells(spark, data):
    return spark.createDataFrame(data, "pack_id string, task_id string, mode string")


def test_duplicates_count_in_the_mean_but_the_last_one_is_paired(spark, rows):
    df = make(spark, [
        ("p", "t", "base", "success", 5.0), ("p", "t", "m", "success", 9.0), ("p", "t", "m", "success", 3.0),
    ])
    assert rows(S.mode_scores(df), "mode", "n", "mean_score") == [("base", 1, 5.0), ("m", 2, 6.0)]
    assert rows(S.paired_deltas(df, baseline_mode="base"), "mode", "pairs", "mean_delta", "losses") == [("m", 1, -2.0, 1)]


def test_a_success_without_a_finite_score_counts_as_status_but_not_as_coverage(spark, rows):
    df = make(spark, [("p", "t", "m", "success", float("nan")), ("p", "u", "m", "success", float("inf")), ("p", "v", "m", "success", None)])
    want = cells(spark, [("p", t, "m") for t in "tuv"])
    assert rows(S.status_counts(df).filter("all_modes"), "status", "n") == [("success", 3)]
    assert rows(S.coverage_cells(df, want), "state") == [("non_success",)] * 3
    assert rows(S.coverage_cells(df, want, require_finite=False), "state") == [("ok",)] * 3


def test_missing_expected_pair_halves_the_rate_base(spark, rows):
    df = make(spark, [("p", "t", "base", "success", 7.0), ("p", "t", "m", "success", 6.0), ("p", "u", "base", "success", 7.0)])
    want = cells(spark, [("p", t, m) for t in "tu" for m in ("base", "m")])
    out = S.negative_transfer(S.paired_deltas(df, baseline_mode="base", expected=want))
    assert rows(out, "rate_on_pairs", "rate_on_expected", "missing_pair_rate", "mean_loss_magnitude") == [(1.0, 0.5, 0.5, 1.0)]
    gaps = S.missing_pairs(df, baseline_mode="base", expected=want)
    assert rows(gaps, "task_id", "baseline_statuses", "mode_statuses") == [("u", "success:1", "missing")]


def test_no_pairs_leave_null_statistics(spark, rows):
    df = make(spark, [("p", "t", "m", "success", 6.0)])
    out = S.negative_transfer(S.paired_deltas(df, baseline_mode="base"))
    assert rows(out, "paired_count", "rate_on_pairs", "rate_on_expected") == [(0, None, 0.0)]


def test_unexpected_and_missing_cells(spark, rows):
    df = make(spark, [("p", "t", "m", "success", 1.0), ("p", "t", "x", "success", 1.0), (None, None, None, None, None)])
    out = S.coverage_cells(df, cells(spark, [("p", "t", "m"), ("p", "u", "m")]))
    assert rows(out, "pack_id", "task_id", "mode", "state") == [
        ("", "", "unknown", "unexpected"), ("p", "t", "m", "ok"), ("p", "t", "x", "unexpected"), ("p", "u", "m", "missing")
    ]


def test_published_means_are_reproduced(spark, rows):
    """Wins, losses and ties of a small published table shape."""
    deltas = [0.5, 0.5, -1.0, 0.0]
    data = []
    for i, d in enumerate(deltas):
        data += [("p", str(i), "base", "success", 7.0), ("p", str(i), "m", "success", 7.0 + d)]
    out = S.paired_deltas(make(spark, data), baseline_mode="base")
    assert rows(out, "mean_delta", "wins", "losses", "ties", "min_delta", "max_delta") == [(0.0, 2, 1, 1, -1.0, 0.5)]


@pytest.mark.parametrize("parts", [1, 8])
def test_partitioning_and_row_order_do_not_matter(spark, rows, parts):
    data = [(f"p{i % 5}", f"t{i % 3}", ["base", "a", "b"][i % 7 % 3], "success" if i % 4 else "error", float(i % 11)) for i in range(300)]
    df = make(spark, data)
    cols = ("mode", "pairs", "mean_delta", "wins", "losses", "ties")
    want = rows(S.paired_deltas(df, baseline_mode="base"), *cols)
    shuffled = df.orderBy(F.xxhash64("seq")).repartition(parts)
    assert rows(S.paired_deltas(shuffled, baseline_mode="base"), *cols) == want


def test_numeric_summary_interpolates_the_median(spark, rows):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,), (None,)], "v double").withColumn("g", F.lit("g"))
    assert rows(S.numeric_summary(df, "v", by=["g"]), "n", "mean", "min", "p50", "max") == [(4, 4.0, 1.0, 3.0, 9.0)]


def test_status_precedence(spark, rows):
    data = [
        ("length", "stop", None, 5.0, "generation_incomplete"), ("stop", "refusal", None, 5.0, "judge_refusal"),
        ("stop", None, None, 5.0, "judge_incomplete"), ("stop", "stop", "bad", 5.0, "judge_parse_error"),
        ("stop", "stop", None, None, "judge_parse_error"), ("stop", "stop", None, 11.0, "judge_invalid_score"),
        ("stop", "stop", None, 10.0, "success"),
    ]
    df = spark.createDataFrame(data, "g string, j string, e string, s double, want string")
    out = df.withColumn("got", S.score_row_status(F.col("g"), F.col("j"), F.col("e"), F.col("s")))
    assert all(w == g for w, g in rows(out, "want", "got"))


def test_expected_matrix_of_groups_follows_their_source(spark, rows):
    want = spark.createDataFrame([("A", "p", "t", "m"), ("B", "q", "t", "m")], "source string, pack_id string, task_id string, mode string")
    groups = spark.createDataFrame([("j1", "A"), ("j2", None)], "judge_model string, source string")
    out = S.expected_for_groups(want, groups, ["A", "B"])
    assert rows(out, "judge_model", "pack_id") == [("j1", "p"), ("j2", "p"), ("j2", "q")]


def test_median_equals_the_sorted_middle_on_skewed_and_tied_groups(spark, rows):
    import random
    import statistics

    rng = random.Random(11)
    groups = {
        "ties": [3.0] * 4000 + [5.0] * 10, "wide": [rng.uniform(-1e6, 1e6) for _ in range(9001)], "even": [rng.gauss(0, 1) for _ in range(5000)],
        "one": [7.5], "two": [1.0, 2.0], "split": [0.0] * 500 + [1.0] * 500, "ints": [float(rng.randint(0, 9)) for _ in range(3000)],
    }
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [("none", None)], "g string, v double")
    got = {g: m for g, m in rows(S.numeric_summary(df, "v", by=["g"]), "g", "p50")}
    assert got == {**{g: statistics.median(xs) for g, xs in groups.items()}, "none": None}


def test_the_group_without_a_key_has_a_median(spark, rows):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0), (None, 4.0), ("g", 2.0)], "g string, v double")
    assert rows(S.numeric_summary(df, "v", by=["g"]), "g", "n", "p50") == [("g", 1, 2.0), (None, 3, 1.0)]


def test_matrix_by_reference_gives_the_deltas_of_the_matrix_written_out(spark, rows):
    data = [
        (f"j{i % 3}", f"p{i * 7 % 5}", f"t{i * 5 % 4}", ["base", "a", "b", "odd"][i * 11 % 4], "success" if i % 5 else "error", float(i % 13), i)
        for i in range(150)
    ]
    df = spark.createDataFrame(data, "judge_model string, pack_id string, task_id string, mode string, status string, overall_score double, seq long")
    df = df.withColumns({"score_bucket": F.lit("s"), "evaluator_kind": F.lit("e"), "path": F.lit("f")})
    # p0 and p1 belong to both sources, b has no base cell in t3, c is never seen.
    cells = [
        (s, f"p{p}", f"t{t}", m) for s in "AB" for p in range(5) for t in range(4) for m in ("base", "a", "b", "c")
        if (p < 2 or (p % 2 == 0) == (s == "A")) and not (t == 3 and m == "base")
    ]
    cells = spark.createDataFrame(cells + cells[:3], "source string, pack_id string, task_id string, mode string")
    groups = spark.createDataFrame([("s", "e", "j0", "A"), ("s", "e", "j1", None), ("s", "e", "j9", "B")], [*S.GROUP, "source"])
    matrix = S.GroupMatrix(cells, groups, ["A", "B"])
    got = S.group_report(df, baseline_mode="base", expected=matrix)
    want = S.group_report(df, baseline_mode="base", expected=matrix.rows())
    for table in ("paired_deltas", "negative_transfer", "coverage"):
        cols = want[table].columns
        assert rows(got[table], *cols) == rows(want[table], *cols) != []
