"""Data steps of skill induction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.expr import col, count_where, dedupe_casefold, has_text, id_part, strip
from evalweave.operators.violations import rule_rows

# -- G1 ---------------------------------------------------------------------------------------


def rule_support(votes: DataFrame, totals: DataFrame | None = None, *, total_examples: int | None = None, by: Sequence[str] = ("rule",)) -> DataFrame:
    """G1: support of each rule: distinct supporters minus distinct contradictors, over the total.

    ``votes``: rule keys, ``example_id``, ``vote`` (``supported`` or ``contradicted``). ``totals``:
    rule keys and ``total``. Without totals, the total is the number of the rule's examples in
    ``votes``, where a null vote marks an example that was seen and did not vote; rules without any
    vote are left out. Votes are first reduced to one row per rule and example, so a rule with most
    of the votes still spreads over its examples.
    """
    per_example = votes.groupBy(*by, "example_id").agg(
        F.max(F.when(F.col("vote") == "supported", 1).otherwise(0)).alias("s"),
        F.max(F.when(F.col("vote") == "contradicted", 1).otherwise(0)).alias("c"),
    )
    agg = per_example.groupBy(*by).agg(
        F.sum("s").alias("supporters"), F.sum("c").alias("contradictors"), F.count("*").alias("total")
    )
    agg = agg.filter(F.col("supporters") + F.col("contradictors") > 0)
    if totals is not None:
        agg = agg.drop("total").join(totals.select(*by, "total"), list(by))
    elif total_examples is not None:
        agg = agg.withColumn("total", F.lit(total_examples).cast("long"))
    return agg.withColumn("effective", F.greatest(F.lit(0), F.col("supporters") - F.col("contradictors")))


def classify_rules(support: DataFrame, *, required: float = 0.8, optional: float = 0.5) -> DataFrame:
    """G1: ``required``, ``optional`` or ``reject``; null where the bounds are broken."""
    share = F.try_divide(F.col("effective").cast("double"), F.col("total").cast("double"))
    sound = (F.col("total") > 0) & F.col("effective").between(0, F.col("total"))
    verdict = F.when(share >= required, "required").when(share >= optional, "optional").otherwise("reject")
    return support.withColumn("share", share).withColumn("verdict", F.when(sound, verdict))


def support_violations(support: DataFrame, entity: Column) -> DataFrame:
    """G1: rules whose total is not positive or whose support exceeds it."""
    return rule_rows(
        support,
        entity,
        [
            ("G1_total_not_positive", "error", F.coalesce(F.col("total"), F.lit(0)) <= 0, ""),
            ("G1_support_out_of_bounds", "error", F.col("effective") > F.col("total"), ""),
        ],
    )


# -- G2 ---------------------------------------------------------------------------------------


def leave_one_out(examples: DataFrame, *, min_examples: int = 3) -> DataFrame:
    """The training side of every fold, one row per fold and remaining example.

    Packs with at least ``min_examples`` have one fold per example. The rows of a large pack are
    spread over tasks, so no list of it is ever held.
    """
    sizes = examples.groupBy("pack_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_examples).select("pack_id")
    folds = examples.join(sizes, "pack_id", "left_semi").select("pack_id", F.col("example_id").alias("validation_example_id"))
    joined = folds.join(examples.select("pack_id", "pos", "example_id"), "pack_id")
    return joined.filter(F.col("example_id") != F.col("validation_example_id"))


# -- G3, G4 -----------------------------------------------------------------------------------

# List fields of a cross-example report and the lesson kind each gives.
LESSON_LISTS = {
    "stable_features": "stable_feature",
    "optional_features": "optional_feature",
    "conflicts": "conflict",
    "outliers": "outlier",
    "candidate_rules": "candidate_rule",
}
EVIDENCE_KEYS = ["supporting_example_ids", "supported_examples", "evidence_examples"]


def spaced_json(compact: Column) -> Column:
    """Compact JSON with a blank after every ``,`` and ``:`` that is outside a string."""
    parts = F.regexp_extract_all(compact, F.lit(r'"(?:[^"\\]++|\\.)*+"|[^"]++'), F.lit(0))
    spread = lambda p: F.when(p.startswith('"'), p).otherwise(
        F.replace(F.replace(p, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))
    )
    return F.array_join(F.transform(parts, spread), "")


def json_string(text: Column) -> Column:
    """A text as a quoted JSON string."""
    packed = F.to_json(F.array(text))
    return F.substring(packed, F.lit(2), F.length(packed) - 2)


def _is(item: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")) == "STRING", F.lit(False))


def _text_of(item: Column, name: str) -> Column:
    return F.when(_is(item, name), strip(F.try_variant_get(item, f"$.{name}", "string")))


def lesson_text(item: Column) -> Column:
    """Lesson of a list item: the string, ``rule``, ``feature: description``, ``description`` or
    ``reason``, else the item as JSON with sorted keys."""
    shape = F.schema_of_variant(item)
    given = F.coalesce(F.when(_text_of(item, "description") != "", _text_of(item, "description")), _text_of(item, "reason"))
    as_object = F.coalesce(
        _text_of(item, "rule"),
        F.concat(_text_of(item, "feature"), F.lit(": "), given),
        given,
        spaced_json(F.to_json(item)),
    )
    return F.when(shape.startswith("OBJECT"), as_object).otherwise(strip(F.try_variant_get(item, "$", "string")))


def evidence_of(item: Column, fallback: Column) -> Column:
    """Example ids behind an item, by the first key that gives any, else the fallback."""
    filled = lambda a: F.when(F.size(a) > 0, a)
    lists = [
        filled(F.filter(F.try_variant_get(item, f"$.{k}", "array<string>"), lambda x: F.coalesce(x, F.lit("")) != ""))
        for k in EVIDENCE_KEYS
    ]
    one = F.when(_is(item, "example_id"), F.array(F.try_variant_get(item, "$.example_id", "string")))
    return F.coalesce(*lists, one, fallback)


def memory_ids(lessons: DataFrame) -> DataFrame:
    """Add the content id: 24 hex digits over the canonical JSON of the lesson."""
    ev = F.array_sort(F.array_distinct("evidence_examples"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(ev, json_string), ", "), F.lit("]"))
    canonical = F.concat(
        F.lit('{"evidence_examples": '), listed,
        *[x for f in ("lesson", "lesson_kind", "mode", "pack_id") for x in (F.lit(f', "{f}": '), json_string(F.col(f)))],
        F.lit("}"),
    )
    return lessons.withColumn("evidence_examples", ev).withColumn("memory_id", F.substring(F.sha2(canonical, 256), 1, 24))


def lessons_from_skills(skills: DataFrame) -> DataFrame:
    """Lessons of success skill rows, one per content id.

    ``skills``: ``pack_id, mode, status, report`` and ``feature_reports`` (both JSON text).
    """
    none = F.array().cast("array<variant>")
    rows = skills.filter((F.col("status") == "success") & (id_part("pack_id") != "") & (id_part("mode") != ""))
    rows = rows.select(
        "pack_id", "mode", F.try_parse_json("report").alias("r"),
        F.coalesce(F.try_variant_get(F.try_parse_json("feature_reports"), "$", "array<variant>"), none).alias("f"),
    )
    ids = F.filter(
        F.transform("f", lambda x: F.try_variant_get(x, "$.example_id", "string")), lambda x: F.coalesce(x, F.lit("")) != ""
    )
    rows = rows.withColumn("fallback", ids)
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.coalesce(F.try_variant_get(F.col("r"), f"$.{f}", "array<variant>"), none).alias("items"))
        for f, k in LESSON_LISTS.items()
    ])
    cross = rows.select("pack_id", "mode", "fallback", F.explode(kinds).alias("k")).select(
        "pack_id", "mode", "fallback", F.col("k.kind").alias("lesson_kind"), F.explode("k.items").alias("item")
    )
    cross = cross.select("pack_id", "mode", "lesson_kind", lesson_text(F.col("item")).alias("lesson"), evidence_of(F.col("item"), F.col("fallback")).alias("evidence_examples"))
    per_report = rows.select("pack_id", "mode", "fallback", F.explode("f").alias("fr")).select(
        "pack_id", "mode", "fallback", F.coalesce(F.try_variant_get(F.col("fr"), "$.example_id", "string"), F.lit("")).alias("eid"),
        F.explode(F.try_variant_get(F.col("fr"), "$.must_not_generalize", "array<variant>")).alias("item"),
    )
    guard = per_report.select(
        "pack_id", "mode", F.lit("do_not_generalize").alias("lesson_kind"), lesson_text(F.col("item")).alias("lesson"),
        F.when(F.col("eid") != "", F.array("eid")).otherwise(F.col("fallback")).alias("evidence_examples"),
    )
    return merge_lessons(memory_ids(cross.unionByName(guard).filter(has_text("lesson"))))


def merge_lessons(*stores: DataFrame) -> DataFrame:
    """Stores merged to one row per id. Equal ids have equal content, so any of them will do."""
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["memory_id"])


def lesson_summary(lessons: DataFrame) -> DataFrame:
    """Lessons by kind and by pack, in one pass."""
    counts = lessons.groupBy("lesson_kind", "pack_id").agg(F.count("*").alias("n"))
    kind, pack = F.col("lesson_kind"), F.col("pack_id")
    return counts.groupingSets([[kind], [pack]], kind, pack).agg(F.sum("n").alias("n"))


# -- G5 ---------------------------------------------------------------------------------------


def _one_line(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def _filled(item: Column, *names: str) -> Column:
    """First of the fields that is truthy, as text, when it is a string."""
    out = []
    for n in names:
        v = F.when(_is(item, n), F.try_variant_get(item, f"$.{n}", "string"))
        out.append(F.when(F.length(v) > 0, v))
    return F.coalesce(*out)


def _plain(item: Column) -> Column:
    return F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))


def _count(item: Column) -> Column:
    """Stated support count, else the number of supporting examples."""
    stated = F.when(
        F.schema_of_variant(F.try_variant_get(item, "$.support_count", "variant")) == "BIGINT",
        F.try_variant_get(item, "$.support_count", "string"),
    )
    listed = F.size(F.try_variant_get(item, "$.supporting_examples", "array<variant>")).cast("string")
    return F.coalesce(stated, listed)


def _rule_line(item: Column) -> Column:
    rule = F.coalesce(_plain(item), _filled(item, "rule"))
    support = _count(item)
    return F.concat(
        _one_line(F.when(F.length(strip(rule)) > 0, rule)),
        F.when(support.isNotNull(), F.concat(F.lit(" (support="), support, F.lit(")"))).otherwise(""),
    )


def _feature_line(item: Column) -> Column:
    text = F.coalesce(_plain(item), _filled(item, "feature", "rule", "description"))
    return _one_line(F.when(F.length(strip(text)) > 0, text))


def _described(label_key: str):
    def line(item: Column) -> Column:
        text = _filled(item, "description", "reason")
        text = F.when(F.length(strip(text)) > 0, text)
        name = _filled(item, label_key)
        prefix = F.when(F.length(strip(name)) > 0, F.concat(name, F.lit(": "))).otherwise("")
        bare = F.when(F.length(strip(_plain(item))) > 0, _plain(item))
        return F.coalesce(_one_line(bare), F.concat(prefix, _one_line(text)))

    return line


# Report fields of a signature context, in order.
SIGNATURE_PARTS = {
    "stable_features": _feature_line,
    "candidate_rules": _rule_line,
    "optional_features": _feature_line,
    "conflicts": _described("feature"),
    "outliers": _described("example_id"),
}


def _latest_with(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    newest = rows.groupBy(*keys).agg(F.max("seq").alias("seq"))
    return rows.join(newest, [*keys, "seq"], "left_semi")


def signature_items(skills: DataFrame, *, limits: dict[str, int] | None = None) -> DataFrame:
    """Items of the compact signature context per ``(pack, mode)``: ``part, rank, line``.

    The last row of a key that has any item counts. ``skills``: ``pack_id, mode, seq, report``. Lists are
    full unless ``limits`` names a length for their part.
    """
    rows = skills.filter((id_part("pack_id") != "") & (id_part("mode") != "")).select(
        "pack_id", "mode", "seq", F.try_parse_json("report").alias("r")
    )
    parts = []
    for name, line in SIGNATURE_PARTS.items():
        items = F.try_variant_get(F.col("r"), f"$.{name}", "array<variant>")
        lines = F.array_compact(F.transform(items, line))
        if limits and name in limits:
            lines = F.slice(lines, 1, limits[name])
        parts.append(F.struct(F.lit(name).alias("part"), F.coalesce(lines, F.array().cast("array<string>")).alias("lines")))
    made = rows.select("pack_id", "mode", "seq", F.array(*parts).alias("parts")).filter(F.exists("parts", lambda p: F.size(p["lines"]) > 0))
    last = _latest_with(made, ["pack_id", "mode"])
    return last.select("pack_id", "mode", F.explode("parts").alias("p")).select(
        "pack_id", "mode", F.col("p.part").alias("part"), F.posexplode("p.lines").alias("rank", "line")
    ).withColumn("rank", F.col("rank") + 1)


DETAIL_SECTIONS = ["basic_attributes", "content_features", "structure_features"]
PRESERVE_SLOT = "example-specific preservation constraints"  # fixed value


def anchor_slots(skills: DataFrame, *, max_slots: int | None = None, max_styles: int | None = None) -> DataFrame:
    """Detail and style slots per ``(pack, mode)`` from key names of the feature reports.

    Key names are taken in document order, written with blanks and deduplicated without regard to
    case. ``skills``: ``pack_id, mode, seq, feature_reports`` (JSON array text).
    """
    rows = skills.filter((id_part("pack_id") != "") & (id_part("mode") != "")).select(
        "pack_id", "mode", "seq", F.from_json("feature_reports", "array<string>").alias("f")
    )
    none = F.array().cast("array<string>")
    human = lambda a: F.transform(a, lambda k: strip(F.regexp_replace(k, "[_-]+", " ")))
    keys = lambda r, s: F.coalesce(human(F.json_object_keys(F.get_json_object(r, f"$.{s}"))), none)
    preserved = lambda r: F.when(
        F.coalesce(F.json_array_length(F.get_json_object(r, "$.must_not_generalize")), F.lit(0)) > 0, F.array(F.lit(PRESERVE_SLOT))
    ).otherwise(none)
    slots = F.flatten(F.transform("f", lambda r: F.concat(*[keys(r, s) for s in DETAIL_SECTIONS], preserved(r))))
    styles = F.flatten(F.transform("f", lambda r: keys(r, "style_features")))
    made = rows.select(
        "pack_id", "mode", "seq", dedupe_casefold(slots, max_slots).alias("slot"), dedupe_casefold(styles, max_styles).alias("style")
    ).filter((F.size("slot") > 0) | (F.size("style") > 0))
    last = _latest_with(made, ["pack_id", "mode"])
    both = F.array(F.struct(F.lit("slot").alias("kind"), F.col("slot").alias("v")), F.struct(F.lit("style").alias("kind"), F.col("style").alias("v")))
    return last.select("pack_id", "mode", F.explode(both).alias("b")).select(
        "pack_id", "mode", F.col("b.kind").alias("kind"), F.posexplode("b.v").alias("rank", "value")
    ).withColumn("rank", F.col("rank") + 1)


def bullet_context(items: DataFrame, *, keys: Sequence[str], part: str, line: str, titles: dict[str, str], header: str = "") -> DataFrame:
    """Items as one text per key: a title per part, then its bullets. Wording is the caller's."""
    order = {name: i for i, name in enumerate(titles)}
    place = F.create_map(*[x for n, i in order.items() for x in (F.lit(n), F.lit(i))])
    title = F.create_map(*[x for n, t in titles.items() for x in (F.lit(n), F.lit(t))])
    blocks = items.groupBy(*keys, part).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(line).alias("l")))).alias("ls"))
    blocks = blocks.select(
        *keys, F.element_at(place, F.col(part)).alias("o"),
        F.concat(F.lit("\n\n## "), F.element_at(title, F.col(part)), F.lit("\n"), F.array_join(F.transform("ls", lambda x: F.concat(F.lit("- "), x["l"])), "\n")).alias("b"),
    )
    texts = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("o", "b"))).alias("bs"))
    return texts.select(*keys, strip(F.concat(F.lit(header), F.array_join(F.transform("bs", lambda x: x["b"]), ""))).alias("context"))


# -- G6, G7, G8 -------------------------------------------------------------------------------


def missing_modes(usable_counts: DataFrame, skills: DataFrame, *, modes: Sequence[str], deep_modes: Sequence[str] = (), deep_from: int = 3) -> DataFrame:
    """Requested skill modes per pack that have no non-blank success text.

    ``usable_counts``: ``pack_id, n`` usable examples; ``deep_modes`` need ``deep_from`` of them.
    """
    base = F.array(*[F.lit(m) for m in modes]) if modes else F.array().cast("array<string>")
    deep = F.array(*[F.lit(m) for m in deep_modes]) if deep_modes else F.array().cast("array<string>")
    wanted = usable_counts.select("pack_id", F.explode(F.when(F.col("n") >= deep_from, F.concat(base, deep)).otherwise(base)).alias("mode"))
    have = skills.filter((F.col("status") == "success") & has_text("skill_md")).select("pack_id", "mode").distinct()
    return wanted.join(have, ["pack_id", "mode"], "left_anti")


LEDGER_KEY = ["pack_id", "stage", "example_id", "validation_example_id", "prompt_sha256", "config_sha256"]


def ledger_lookup(calls: DataFrame, ledger: DataFrame) -> DataFrame:
    """Calls with the last success of the same six-part key, ``reused`` null when there is none."""
    keyed = lambda df: df.withColumns({k: id_part(k) for k in LEDGER_KEY})
    ok = keyed(ledger.filter(F.col("status") == "success"))
    newest = ok.groupBy(*LEDGER_KEY).agg(F.max("seq").alias("seq"))
    last = ok.join(newest, [*LEDGER_KEY, "seq"], "left_semi").select(*LEDGER_KEY, F.col("seq").alias("reused_seq"), F.col("parsed_json").alias("reused"))
    return keyed(calls).join(last, LEDGER_KEY, "left")


def first_call_model(models: str | Column) -> Column:
    """First non-blank model in call order, null when no call names one."""
    return F.get(F.filter(col(models), lambda m: F.length(strip(m)) > 0), F.lit(0))


def fold_counts(folds: DataFrame) -> DataFrame:
    """Folds per pack."""
    return folds.groupBy("pack_id").agg(F.count_distinct("validation_example_id").alias("folds"))
