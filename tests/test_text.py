"""Text operators: literal cases, CJK borders, whole-text scans, brute-force overlap."""

import random

from pyspark.sql import functions as F

from evalweave.functions.expr import slug
from evalweave.functions.patterns import LITERAL_PATTERNS, STOPWORDS, literals, pattern_hits, text_content_grams
from evalweave.operators import contamination as C
from evalweave.operators import text as T


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_leak_patterns_and_cjk_word_borders(spark):
    assert one(spark, "The HIDDEN RUBRIC says", pattern_hits) == [r"\bhidden rubric\b"]
    assert one(spark, "标准hidden rubric", pattern_hits) == []
    assert one(spark, "这是隐藏的评分标准", pattern_hits) == ["隐藏.*评分标准", "隐藏.*(rubric|评分|标准|checklist|检查)"]
    assert one(spark, "private  checklist", pattern_hits) == [r"\b(private|benchmark|grading)\s+(rubric|checklist|criteria)\b"]
    assert one(spark, "fine", pattern_hits) == []


def test_ngrams_english_and_cjk(spark):
    grams = lambda n: lambda t: text_content_grams(t, n)
    assert one(spark, "The quick-fox ran 3.5 km", grams(3)) == ["the quick-fox ran", "quick-fox ran 3.5", "ran 3.5 km"]
    assert one(spark, "to be or not", grams(3)) == ["be or not"]
    assert one(spark, "计划 A", grams(2)) == ["计 划", "划 a"]
    assert one(spark, "one two", grams(3)) == []


def brute(tokens, n):
    out = set()
    for i in range(len(tokens) - n + 1):
        g = tokens[i : i + n]
        if any(t not in STOPWORDS for t in g):
            out.add(" ".join(g))
    return out


def test_chunk_grams_cross_borders_like_joined_text(spark, rows):
    rng = random.Random(3)
    words = ["the", "of", "alpha", "beta", "x9", "7", "and", "gamma"]
    data, texts = [], {}
    for g in ("hot", "a", "b"):
        chunks = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 0, 1, 1, 2, 5]))) for _ in range(60 if g == "hot" else 7)]
        data += [(g, i * 3, c) for i, c in enumerate(chunks)]
        texts[g] = "\n".join(chunks).split()
    df = spark.createDataFrame(data, "g string, pos long, text string")
    for n in (1, 2, 3, 4):
        got = rows(C.chunk_grams(df, ["g"], n, block=8), "g", "gram")
        want = sorted((g, x) for g, toks in texts.items() for x in brute(toks, n))
        assert got == want, n


def test_copied_phrase_is_found_and_heldout_phrase_is_not(spark, rows):
    cand = spark.createDataFrame(
        [("p", "t", "m", 1, "success", "we use alpha beta gamma here and delta eps zeta"), ("p", "t", "prompt_only", 2, "success", "nothing at all here"),
         ("q", "t", "m", 3, "success", "alpha beta gamma"), ("p", "t", "m", 4, "model_error", "alpha beta gamma")],
        "pack_id string, task_id string, mode string, seq long, status string, text string",
    )
    train = spark.createDataFrame([("p", 0, "alpha beta gamma"), ("p", 1, "delta eps zeta")], "pack_id string, pos long, text string")
    held = spark.createDataFrame([("p", "t", 0, "delta eps zeta")], "pack_id string, task_id string, pos long, text string")
    out, matches = C.contamination_rows(cand, train, held)
    assert rows(out, "seq", "suspicious", "excess") == [(1, 1, 1), (2, 0, 0)]
    assert rows(C.top_matches(matches), "seq", "rank", "phrase", "candidate_count") == [(1, 1, "alpha beta gamma", 1)]


def test_literals(spark):
    found = one(spark, "On 2024-05-01 see a@b.org, 45% of (https://x.y/z) and data/raw/a.csv by Acme Corp Ltd", literals)
    assert {"2024-05-01", "a@b.org", "https://x.y/z", "data/raw/a.csv", "Acme Corp Ltd"} <= set(found)


def test_literal_matches_equal_brute_force(spark, rows):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcé") for _ in range(k))
    lits = [(g, word(rng.choice([3, 4, 6, 7, 9]))) for g in "hx" for _ in range(80)]
    texts = [(i, "h" if i % 3 else "x", word(60)) for i in range(60)]
    train = spark.createDataFrame(sorted(set(lits)), "pack_id string, literal string")
    df = spark.createDataFrame(texts, "id long, pack_id string, haystack string")
    want = sorted((i, lit) for i, g, t in texts for pg, lit in set(lits) if pg == g and lit in t)
    assert sorted(rows(T.literal_matches(df, train, keys=["id"]), "id", "literal")) == want


def test_common_heads_key_no_literals(spark, rows):
    lits = [f"https://host.example/item/{i:05d}" for i in range(3000)] + [f"pack::train::{i:05d}" for i in range(3000)]
    train = spark.createDataFrame([("p", x) for x in lits], "pack_id string, literal string")
    body = "https://host.example/item/00017 pack::train::02999 https://host.example/item/ pack::train::"
    df = spark.createDataFrame([(i, "p", body) for i in range(50)] + [(50, "p", None)], "id long, pack_id string, haystack string")
    got = rows(T.literal_matches(df, train, keys=["id"]), "id", "literal")
    assert sorted(got) == sorted((i, x) for i in range(50) for x in (lits[17], lits[5999]))


def test_repeated_and_null_keys_keep_each_text(spark, rows):
    train = spark.createDataFrame([("p", "abcdefg"), ("p", "xyz")], "pack_id string, literal string")
    texts = [(1, "p", "..abcdefg"), (1, "p", "abcdefg xyz"), (None, "p", "xyz"), (2, None, "xyz")]
    df = spark.createDataFrame(texts, "id long, pack_id string, haystack string")
    got = rows(T.literal_matches(df, train, keys=["id"]), "id", "literal")
    assert sorted(got, key=str) == sorted([(1, "abcdefg"), (1, "abcdefg"), (1, "xyz"), (None, "xyz")], key=str)


def test_section_counts(spark):
    md = "# S\n- x\n## Required Rules:\n- a\n* [ ] b\ntext\n1. c\n### Optional rules\n2) d\n## Do not generalize\n+ e\n## Notes\n- f"
    assert tuple(one(spark, md, T.section_rule_counts)) == (3, 1, 1)


def test_pages_and_reasoning(spark):
    text = "intro\n\n# Slide 1: *A*\nx\nSlide 2\n  y\tz "
    assert one(spark, text, T.page_texts) == ["intro", "# Slide 1: A\nx", "Slide 2\ny z"]
    assert one(spark, "# Slide 1\na", T.page_texts) == ["# Slide 1\na"]
    assert one(spark, "think</think>\n\nanswer", T.strip_reasoning) == "answer"
    assert one(spark, "no marker", T.strip_reasoning) == "no marker"


def test_stats_truncation_slug(spark):
    s = one(spark, "ab 计划 c\n", T.text_stats)
    assert (s.chars, s.words, s.cjk_chars) == (8, 3, 2)
    assert one(spark, "abcdef", lambda t: T.truncate_evidence(t, 3)) == "abc\n\n[TRUNCATED after 3 chars]"
    assert one(spark, "abcdef", lambda t: T.truncate_preview(t, 0)) == "abcdef"
    assert one(spark, "  a//b  c__", slug) == "a_b_c" and one(spark, " /// ", slug) == "item"


def test_evidence_keeps_first_spelling_and_reads_the_whole_text(spark, rows):
    text = "Acme saw 12% and ACME said \"Big Plan\". " + "pad " * 8000 + "Zeta 99"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    got = rows(T.evidence_inventory(df, keys=["id"]), "kind", "rank", "value")
    assert ("number", 2, "99") in got and ("capitalised", 1, "Acme") in got and ("quoted", 1, "Big Plan") in got
    assert not [v for k, _, v in got if k == "capitalised" and v == "ACME"]


def test_private_keys_with_paths(spark, rows):
    texts = ['{"a":[{"judge":{"private_x":1}}],"b":2}', '{"a":{"b":{"c":{"d":1}}}}', "not json", '[1,[2,{"judge":[]}],{"k":"judge"},{"\\u006audge":"a,b]"}]', '{"judge":1', None, '"judge"', '{"x":["judge","statistics"],"private_":{},"judge":{"judge":[[],[{"statistics":0}]]}}']
    df = spark.createDataFrame(list(enumerate(texts, 1)), "id long, j string")
    want = [(1, "$.a[0].judge"), (1, "$.a[0].judge.private_x"), (4, "$[1][1].judge"), (4, "$[3].judge")]
    want += [(8, "$.judge"), (8, "$.judge.judge"), (8, "$.judge.judge[1][0].statistics"), (8, "$.private_")]
    assert rows(T.private_key_paths(df, "j", ["id"]), "id", "path") == want


def test_private_keys_far_down_leave_the_plan_as_it_is(spark):
    def nested(depth):
        text = '{"judge":1}'
        for i in range(depth):
            text = '{"n":%s}' % text if i % 2 else "[0,%s]" % text
        return spark.createDataFrame([(depth, text)], "id int, j string")

    plans = []
    for depth in (2, 200):
        out = T.private_key_paths(nested(depth), "j", ["id"])
        plans.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        (found,) = out.collect()
        assert found.path.endswith(".judge") and found.path.count("[1]") == depth // 2 and found.path.count(".n") == depth // 2
    assert max(plans) - min(plans) < 100


def test_token_pattern_is_the_published_one(spark):
    assert one(spark, "GPT-4o costs 3.50 USD_x", lambda t: text_content_grams(t, 1)) == ["gpt-4o", "costs", "3.50", "usd_x"]


def test_unicode_blanks_hide_nothing(spark):
    from evalweave.functions import expr, patterns

    texts = ["private\u00a0rubric", "private\u3000rubric", "隐藏\u2028评分标准", "plain", "\u00a0\u2003"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select(F.size(patterns.pattern_hits(F.col("t"))).alias("n"), expr.has_text("t").alias("h")).collect()
    assert [r.n > 0 for r in got] == [True, True, True, False, False] and [r.h for r in got] == [True] * 4 + [False]


def test_private_keys_at_any_depth(spark, rows):
    deep = '{"rubric": 1}'
    for i in range(12):
        deep = '{"k%d": %s}' % (i, deep)
    df = spark.createDataFrame([(1, deep)], "id int, j string")
    keys = ["rubric"]
    got = T.private_key_paths(df, "j", ["id"], private_keys=keys).collect()
    assert [r.path.endswith("rubric") for r in got] == [True]


def test_private_keys_past_escapes(spark, rows):
    cases = []
    for depth in range(4, 13):
        for k, escaped in enumerate([r"l1\nl2", r"say \"{\" or \"", "back\\\\", r"\\\" [{", r"{"]):
            deep = '{"judge":1}'
            for i in range(depth - 1):
                deep = '{"x%d":"%s","y":%s}' % (i, escaped, deep)
            cases.append((depth * 10 + k, deep))
    df = spark.createDataFrame(cases, "id int, j string")
    want = [(i, "$" + ".y" * (i // 10 - 1) + ".judge") for i, _ in cases]
    assert rows(T.private_key_paths(df, "j", ["id"]), "id", "path") == sorted(want, key=lambda t: [(False, str(x)) for x in t])


def test_literals_of_one_site_stay_linear(spark, rows):
    """Ten thousand addresses with one beginning: only the windows of the filter become rows."""
    from evalweave.functions.bloom import KeyFilter

    urls = [f"https://site.example/a/very/long/path/{i:05d}" for i in range(10_000)]
    train = spark.createDataFrame([("p", u) for u in urls], "pack_id string, literal string")
    texts = spark.createDataFrame([(i, "p", f"see {urls[i]} and https://site.example/a/very/long/path/other" if i % 2 else "nothing " * 50) for i in range(40)], "id long, pack_id string, haystack string")
    hits = T.literal_matches(texts, train, keys=["id"])
    assert sorted((r.id, r.literal) for r in hits.collect()) == [(i, urls[i]) for i in range(1, 40, 2)]
    may_hold = KeyFilter(train.select("pack_id", F.col("literal").alias("window")), ["pack_id", "window"])
    probe = spark.createDataFrame([("p", u) for u in urls[:2000]] + [("p", f"other {i}") for i in range(20_000)], "pack_id string, window string")
    kept = probe.withColumn("__words", may_hold.words).filter(may_hold(F.xxhash64("pack_id", "window"))).select("window").collect()
    assert len([r for r in kept if r.window.startswith("https")]) == 2000 and len(kept) < 2200


def test_matched_literals_are_listed_in_full(spark):
    words = [f"literal-{i:03d}" for i in range(120)]
    train = spark.createDataFrame([("p", w) for w in words], "pack_id string, literal string")
    texts = spark.createDataFrame([(1, "p", " ".join(words))], "id long, pack_id string, haystack string")
    assert T.literal_leakage(texts, train, keys=["id"]).first().matched_literals == words
    assert T.literal_leakage(texts, train, keys=["id"], show=3).first().matched_literals == words[:3]


def test_each_leak_pattern_has_its_phrase(spark):
    from evalweave.functions.patterns import PRIVATE_LEAK_PATTERNS, pattern_hits
    from evalweave.plans.bindings import PLANTED

    odd = ["RUBRİC crıterıa", "CHECKLIſT grading", "hidden\n评分标准", "Hidden Rubric"]
    df = spark.createDataFrame(list(enumerate([*PLANTED, *odd])), "i int, t string")
    # A list that is not the fixed one takes the way of the single alternation.
    got = df.select("i", pattern_hits(F.col("t")).alias("h"), pattern_hits(F.col("t"), [*PRIVATE_LEAK_PATTERNS, "never^"]).alias("w")).orderBy("i").collect()
    assert all(r.h == r.w for r in got)
    assert set().union(*(r.h for r in got)) == set(PRIVATE_LEAK_PATTERNS)
    assert not any(r.h for r in got[len(PLANTED) - 6 : len(PLANTED)])


def test_strict_json_takes_one_whole_value_and_parses_it_once(spark):
    from evalweave.operators import responses as R

    good = {"1": "1", " -2.5 ": "-2.5", "\t\n{\"a\": [1]}\r\n": '{"a":[1]}', "[]": "[]", '"x"': '"x"', "true": "true", "null": "null", "false": "false", "1e5": "100000"}
    bad = ["", " ", "1,2", "1, 2], [3", "1] , [2", "[1", "1]", "{} {}", "{}}", "] [", "{\"a\":1},", "nul", "Report: {}", "{} end", '1,"__end_of_value__"],[', " 1", "{\"a\":1,\"a\":2}"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string")
    got = {r.t: r.v for r in df.select("t", F.to_json(R.strict_json(F.col("t"))).alias("v")).collect()}
    assert {t: v for t, v in got.items() if t in bad} == dict.fromkeys(bad)
    assert all(got[t] is not None for t in good) and got["[]"] == "[]" and got[' -2.5 '] == "-2.5"
    plan = df.select(R.strict_json(F.col("t")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 1


def test_wide_table_spreads_a_file_of_one_row_group(spark):
    from evalweave.plans import bindings as B
    from tests.conftest import SMALL

    sizes = B.wide_table(spark, SMALL, "events").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 2 * spark.sparkContext.defaultParallelism - 1


def test_long_runs_of_names_take_no_stack(spark):
    plain = r"\b(?:[A-Z][A-Za-z0-9&.-]+(?:\s+|[-:])){2,}[A-Z][A-Za-z0-9&.-]+\b"
    short = [
        "see Acme Corp Ltd.", "Acme-Corp-Ltd", "Acme-Corp Ltd", "Acme X. Corp-a B. C. d", "Ab Cd E.é", "Ab Cd Ef G.H_", "Ab Cd E.F_", "A. B. Cd",
        "Ab: Cd Ef", "Ab:Cd:Ef-gh_", "Ab Cd", "Ab\n\nCd \tEf-.", "Ab Cd ef Gh Ij Kl", "xAb Cd Ef Gh",
    ]
    extract = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    df = spark.createDataFrame([(t,) for t in short], "t string").select(extract("t", plain).alias("want"), extract("t", LITERAL_PATTERNS[8]).alias("got"))
    assert all(r.got == r.want for r in df.collect())
    assert one(spark, "Anen. " * 30_000 + "end", literals) == [("Anen. " * 30_000).strip(". ")]


def test_literals_across_chunks_of_windows_and_short_ones(spark):
    from evalweave.functions.byte_windows import CHUNK

    lits = ["1日é", "12%", "naïve Straße 報告", "x" * 5_000 + "y", "abcd", "Zürich"]
    texts = [(0, "p", "z" * (CHUNK - 3) + "naïve Straße 報告" + "z" * CHUNK + "Zürich"), (1, "p", "é" * (CHUNK // 2) + "1日é"), (2, "p", ""), (3, "p", None),
             (4, "q", "12% abcd"), (5, "p", "x" * 6_000 + "y12%"), (6, "p", "ab" + "cdé12")]
    train = spark.createDataFrame([("p", x) for x in lits] + [("q", "abcd"), ("q", None)], "pack_id string, literal string")
    df = spark.createDataFrame(texts, "id long, pack_id string, haystack string").coalesce(1)
    got = sorted((r.id, r.literal) for r in T.literal_matches(df, train, keys=["id"]).collect())
    assert got == sorted((i, x) for i, p, t in texts for x in (lits if p == "p" else ["abcd"]) if t and x in t)
    counts = {r.id: r.candidate_literal_count for r in T.literal_leakage(df, train, keys=["id"]).collect()}
    assert counts[0] == 6 and counts[4] == 2


def test_the_filter_of_windows_grows_with_its_keys(spark):
    from evalweave.functions.byte_windows import WindowFilter

    keys = spark.range(1 << 20).select(F.lit("p").alias("pack_id"), (F.shiftleft(F.lit(6).cast("long"), 56) + F.col("id") * 268435399).alias("key"))
    texts = spark.range(40).select("id", F.lit("p").alias("pack_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.sha1((F.col("id") * 1000 + i).cast("string"))), "").alias("t"))
    assert WindowFilter(keys, ["pack_id"]).windows(texts, "t", ["id", "pack_id"], ["pack_id"]).count() < 0.01 * 3 * 40 * 20_000
