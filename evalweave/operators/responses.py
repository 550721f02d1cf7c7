"""Model responses to typed reports (E12), as one job over a table of response texts.

Strict JSON first, then the widest ``{...}`` inside, as the reference does per candidate. Every
field is checked on the VARIANT, because a cast would turn ``true`` into 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.expr import col, let, strip

_V = "variant"
NO_JSON = "no_json_object_found"
NOT_OBJECT = "json_root_is_not_object"


# What stands behind a text that is tested for being one JSON value.
_END = "__end_of_value__"


def strict_json(text: Column) -> Column:
    """A VARIANT when the *whole* text is one JSON value, else null.

    ``try_parse_json`` stops after the first value. In an array, in front of a mark that the text does
    not hold, it yields two items and the mark last only when it is one value. A text that no value can
    begin or end is not parsed: a parse that fails costs far more than one that succeeds.
    """
    may_be = text.rlike(r'^[ \t\r\n]*+[\[{"0-9tfn-]') & text.rlike(r'[\]}"0-9el][ \t\r\n]*+\z') & ~F.contains(text, F.lit(_END))

    def single(items: Column) -> Column:
        whole = (F.size(items) == 2) & (F.try_variant_get(F.get(items, F.lit(1)), "$", "string") == _END)
        return F.when(whole, F.get(items, F.lit(0)))

    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))), "$", "array<variant>")
    return F.when(may_be, let(items, single))


def _braces(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def _parsed(candidate: Column) -> Column:
    """The candidate as JSON, else its widest brace span as JSON."""
    return F.coalesce(strict_json(candidate), strict_json(_braces(candidate)))


# The types that JSON can have, by the first letters of their names.
_KINDS = {
    "BIG": "int",
    "DEC": "number",
    "DOU": "number",
    "FLO": "number",
    "BOO": "bool",
    "STR": "string",
    "ARR": "list",
    "OBJ": "object",
    "VOI": "null",
}


def kind(value: Column) -> Column:
    """JSON type of a VARIANT: ``int, number, bool, string, list, object, null``; null if absent.

    The type name is read once and looked up; a chain of conditions would read it once per branch.
    """
    head = F.substring(F.schema_of_variant(value), 1, 3)
    names = F.create_map(*[x for k, v in _KINDS.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(names, head)


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", _V)


def field_kind(value: Column, name: str) -> Column:
    return F.coalesce(kind(field(value, name)), F.lit("absent"))


def field_number(value: Column, name: str) -> Column:
    """A JSON number (not a bool, not a digit string) as double."""
    return F.when(field_kind(value, name).isin("int", "number"), F.try_variant_get(value, f"$.{name}", "double"))


def parse_object(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``report`` (VARIANT object or null) and ``parse_error``.

    A fenced block comes first, then the whole text; the first that parses decides.
    """
    body = F.coalesce(col(text), F.lit(""))
    fence = F.regexp_extract(body, r"(?is)```(?:json)?\s*(.*?)```", 1)
    has_fence = body.rlike(r"(?is)```(?:json)?\s*(.*?)```")
    value = F.coalesce(F.when(has_fence, _parsed(strip(fence))), _parsed(body))
    out = df.withColumn("report", value)
    k = kind(F.col("report"))
    return out.withColumn(
        "parse_error", F.when(F.col("report").isNull(), NO_JSON).when(k != "object", NOT_OBJECT)
    )


def _first(conds: Sequence[tuple[Column, str]]) -> Column:
    out = None
    for cond, name in conds:
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def _out_of(value: Column, low: float, high: float) -> Column:
    return ~F.coalesce(value.between(low, high), F.lit(False))


def criterion_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """Criterion score 1-10 (a digit string counts) with a reason; adds ``score, parse_error``."""
    body = strip(F.coalesce(col(text), F.lit("")))
    body = strip(F.regexp_replace(body, r"^```(?:json)?", ""))
    body = strip(F.regexp_replace(body, r"```$", ""))
    out = df.withColumn("report", _parsed(body))
    r = F.col("report")
    score_kind = field_kind(r, "score")
    as_text = F.try_variant_get(r, "$.score", "string")
    digits = (score_kind == "string") & as_text.rlike(r"^\p{Nd}+$")
    number = F.when((score_kind == "int") | digits, F.try_variant_get(r, "$.score", "bigint"))
    error = _first(
        [
            (r.isNull(), NO_JSON),
            (kind(r) != "object", NOT_OBJECT),
            (score_kind == "bool", "score_must_be_integer_1_to_10"),
            (field_kind(r, "reason") != "string", "reason_must_be_string"),
            (_out_of(number, 1, 10), "score_must_be_integer_1_to_10"),
        ]
    )
    return out.withColumn("score", number).withColumn("parse_error", error)


# Fields of the four report kinds.
PATTERN_SCORES = [
    "pattern_similarity_score",
    "structural_similarity_score",
    "style_similarity_score",
    "constraint_transfer_score",
]
PATTERN_LISTS = ["supported_patterns", "missed_patterns", "unsupported_patterns"]
CONSISTENCY_SCORES = [
    "stable_feature_recall",
    "constraint_recall",
    "structure_recall",
    "style_signature",
    "leakage_penalty",
    "unsupported_specificity_penalty",
    "overall_self_consistency",
]
CONSISTENCY_LISTS = ["matched_constraints", "missing_or_distorted_constraints"]
PLAN_LISTS = ["grounded_facts", "generic_scaffolding", "missing_specifics", "generation_constraints"]


def pattern_reports(df: DataFrame, text: str = "text") -> DataFrame:
    """Four scores 1-10, a risk label and three lists; the first fault is the parse error."""
    out = parse_object(df, text)
    r = F.col("report")
    own = [(_out_of(field_number(r, f), 1, 10), f"{f}_must_be_number_1_to_10") for f in PATTERN_SCORES]
    risk = F.when(field_kind(r, "unsupported_pattern_risk") == "string", F.try_variant_get(r, "$.unsupported_pattern_risk", "string"))
    own.append(
        (~F.coalesce(risk.isin("low", "medium", "high"), F.lit(False)), "unsupported_pattern_risk_must_be_low_medium_or_high")
    )
    own += [(field_kind(r, f) != "list", f"{f}_must_be_list") for f in PATTERN_LISTS]
    error = F.coalesce(F.col("parse_error"), _first(own))
    scores = {f: field_number(r, f) for f in PATTERN_SCORES}
    return out.withColumns({"parse_error": error, **scores, "unsupported_pattern_risk": risk})


def grounding_reports(df: DataFrame, text: str = "text") -> DataFrame:
    """Grounding score and risk 1-10, claim count >= 0; faults are joined by ``;``."""
    out = parse_object(df, text)
    r = F.col("report")
    faults = []
    for name in ("grounding_score", "hallucination_risk"):
        number = field_number(r, name)
        faults.append(F.when(number.isNull(), f"{name}_not_numeric").when(_out_of(number, 1, 10), f"{name}_out_of_range"))
    claims = F.when(field_kind(r, "unsupported_claim_count") == "int", F.try_variant_get(r, "$.unsupported_claim_count", "bigint"))
    faults.append(
        F.when(claims.isNull(), "unsupported_claim_count_not_integer").when(claims < 0, "unsupported_claim_count_negative")
    )
    faults.append(F.when(field_kind(r, "unsupported_claims") != "list", "unsupported_claims_not_list"))
    joined = F.concat_ws(";", *faults)
    error = F.coalesce(F.col("parse_error"), F.when(joined != "", joined))
    return out.withColumns(
        {
            "parse_error": error,
            "grounding_score": field_number(r, "grounding_score"),
            "hallucination_risk": field_number(r, "hallucination_risk"),
            "unsupported_claim_count": claims,
        }
    )


def consistency_errors(report: Column, parse_error: Column, scores: Column | None = None) -> Column:
    """All faults of a self-consistency report, sorted and distinct.

    ``scores`` is a struct of the numeric fields when the caller has it already.
    """
    parts = _consistency_faults(report, scores)
    return _all_faults(report, F.array(parse_error, *parts))


def _consistency_faults(report: Column, scores: Column | None = None) -> list[Column]:
    """The faults of a report's own fields in their order, null where a field is as it should be."""
    parts = []
    for f in CONSISTENCY_SCORES:
        number = field_number(report, f) if scores is None else scores[f]
        parts.append(F.when(_out_of(number, 0, 10), f"{f}_must_be_number_0_to_10"))
    for f in CONSISTENCY_LISTS:
        parts.append(F.when(field_kind(report, f) != "list", f"{f}_must_be_list"))
    parts.append(F.when(field_kind(report, "rationale") != "string", "rationale_must_be_string"))
    return parts


def _all_faults(report: Column, faults: Column) -> Column:
    all_faults = F.array_sort(F.array_distinct(F.array_compact(faults)))
    return F.when(kind(report) == "object", all_faults).otherwise(F.array(F.lit("judge_report_must_be_object")))


def consistency_reports(df: DataFrame, text: str = "text") -> DataFrame:
    """Seven scores 0-10, two lists, a rationale; the first fault is the parse error."""
    out = parse_object(df, text)
    r = F.col("report")
    # Each field is read once; error and list of errors come from the same faults.
    out = out.withColumn("__scores", F.struct(*[field_number(r, f).alias(f) for f in CONSISTENCY_SCORES]))
    out = out.withColumn("__own", F.array_compact(F.array(*_consistency_faults(r, F.col("__scores")))))
    error = F.coalesce(F.col("parse_error"), F.get("__own", F.lit(0)))
    errors = _all_faults(r, F.concat(F.array(error), "__own"))
    scores = {f: F.col("__scores")[f] for f in CONSISTENCY_SCORES}
    return out.withColumns({"parse_error": error, "errors": errors, **scores}).drop("__scores", "__own")


def plan_errors(df: DataFrame, text: str = "text") -> DataFrame:
    """Plan fields must be lists of non-blank strings; adds the sorted ``errors`` array."""
    out = parse_object(df, text)
    r = F.col("report")
    parts = []
    for f in PLAN_LISTS:
        items = F.try_variant_get(field(r, f), "$", "array<variant>")
        blank = F.exists(
            items,
            lambda v: (F.coalesce(kind(v), F.lit("null")) != "string")
            | (F.length(strip(F.try_variant_get(v, "$", "string"))) == 0),
        )
        parts.append(F.when(field_kind(r, f) != "list", f"{f}_not_list").when(blank, f"{f}_contains_non_string"))
    return out.withColumn("errors", F.array_compact(F.array(*parts)))


def abstract_signatures(df: DataFrame, keys: Sequence[str], text: str = "text", *, limit: int | None = None) -> DataFrame:
    """Object items of ``abstract_example_signatures``, one row each in list order."""
    out = parse_object(df, text)
    items = F.try_variant_get(F.col("report"), "$.abstract_example_signatures", "array<variant>")
    kept = F.filter(items, lambda v: kind(v) == "object")
    if limit is not None:
        kept = F.slice(kept, 1, limit)
    return out.select(*keys, F.posexplode(kept).alias("pos", "signature"))


def overall_score(report: Column) -> Column:
    """Overall score: a number or a numeric string, never a bool."""
    k = field_kind(report, "overall_score")
    as_text = F.try_variant_get(report, "$.overall_score", "string")
    return F.when(k.isin("int", "number"), F.try_variant_get(report, "$.overall_score", "double")).when(
        k == "string", strip(as_text).try_cast("double")
    )
