"""Schema validation of raw JSON rows (H1).

Works on the raw text, because "key absent" and "key is null" differ only there. Each row kind is
an ordered rule list; ``mode="first"`` keeps the first fault of a row, ``mode="all"`` all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.expr import strip
from evalweave.operators.responses import field_kind, kind

# Schema versions of the three row kinds.
GENERATED_SCHEMA = "generated-desired-output/v1"
SKILL_SCHEMA = "skill-induction/v1"
EVAL_SCHEMAS = [
    "heldout-eval/v1",
    "pattern-similarity-eval/v1",
    "train-example-quality-audit/v1",
    "writingbench-official-eval/v1",
    "presentbench-official-score/v1",
]


class Fields:
    """Kinds and texts of a row's fields, by name, as columns that the rules share.

    Each is read from the row once, beside its parse, however many rules ask for it.
    """

    def __init__(self) -> None:
        self.kinds: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def kind(self, key: str) -> Column:
        return F.col(self.kinds.setdefault(key, f"__kind_{key}"))

    def text(self, key: str) -> Column:
        """The field where it is a string, else null."""
        self.kind(key)
        return F.col(self.texts.setdefault(key, f"__text_{key}"))

    def read(self, rows: DataFrame, report: str) -> DataFrame:
        """``rows`` with the columns that were asked for, from the VARIANT ``report``."""
        r = F.col(report)
        out = rows.withColumns({name: field_kind(r, key) for key, name in self.kinds.items()})
        is_text = lambda key: F.col(self.kinds[key]) == "string"
        return out.withColumns({name: F.when(is_text(key), F.try_variant_get(r, f"$.{key}", "string")) for key, name in self.texts.items()})


def _need_text(r: Fields, key: str) -> Column:
    """Fault when the key is absent, not a string or blank."""
    k = r.kind(key)
    return F.when(k == "absent", F.lit(f"missing required field: {key}")).when(
        (k != "string") | (F.length(strip(r.text(key))) == 0), F.lit(f"{key} must be a non-empty string")
    )


def _need_key(r: Fields, key: str, what: str = "field") -> Column:
    return F.when(r.kind(key) == "absent", F.lit(f"missing required {what}: {key}"))


def _text_or_null(r: Fields, key: str) -> Column:
    return F.when(~r.kind(key).isin("absent", "null", "string"), F.lit(f"{key} must be a string or null"))


def _only_if(cond: Column, *faults: Column) -> list[Column]:
    return [F.when(cond, f) for f in faults]


def _version(r: Fields, allowed: list[str]) -> Column:
    v = r.text("schema_version")
    return F.when(~v.isin(allowed), F.concat(F.lit("unsupported schema_version: "), v))


def generated_rules(r: Fields) -> list[Column]:
    status = r.text("status")
    known = ["success", "error", "rejected_private_leak", "rejected_incomplete_generation"]
    return [
        _need_text(r, "schema_version"),
        _version(r, [GENERATED_SCHEMA]),
        *[_need_text(r, k) for k in ("status", "job_id", "pack_id", "example_id")],
        *_only_if(
            status == "success",
            _need_text(r, "desired_output"),
            _need_text(r, "finish_reason"),
            F.when(r.text("finish_reason") != "stop", F.lit("success row finish_reason must be stop")),
        ),
        *_only_if(status == "error", _need_key(r, "error")),
        *_only_if(status == "rejected_private_leak", _need_key(r, "leak_matches"), _need_text(r, "finish_reason")),
        *_only_if(status == "rejected_incomplete_generation", _need_text(r, "finish_reason")),
        F.when(~status.isin(known), F.concat(F.lit("unsupported generated output status: "), status)),
    ]


def skill_rules(r: Fields) -> list[Column]:
    status = r.text("status")
    return [
        _need_text(r, "schema_version"),
        _version(r, [SKILL_SCHEMA]),
        *[_need_text(r, k) for k in ("status", "pack_id", "mode")],
        _need_key(r, "model_calls"),
        F.when(~r.kind("model_calls").isin("list", "absent"), F.lit("model_calls must be a list")),
        _text_or_null(r, "solver_model"),
        *_only_if(status == "success", _need_text(r, "skill_md")),
        *_only_if(status == "induction_error", _need_key(r, "skill_md", "nullable field"), _need_text(r, "error")),
        F.when(~status.isin("success", "induction_error"), F.concat(F.lit("unsupported skill row status: "), status)),
    ]


def eval_rules(r: Fields) -> list[Column]:
    status = r.text("status")
    score = r.kind("overall_score")
    return [
        _need_text(r, "schema_version"),
        _version(r, EVAL_SCHEMAS),
        *[_need_text(r, k) for k in ("status", "pack_id", "task_id", "mode", "evaluator_kind")],
        _need_key(r, "overall_score", "nullable field"),
        _text_or_null(r, "solver_model"),
        _text_or_null(r, "judge_model"),
        *_only_if(status == "success", F.when(~score.isin("int", "number", "absent"), F.lit("success overall_score must be numeric"))),
        *_only_if(status != "success", F.when(~score.isin("null", "absent"), F.lit("non-success overall_score must be null"))),
    ]


RULES = {"generated_outputs": generated_rules, "skills": skill_rules, "eval": eval_rules}


def schema_violations(
    rows: DataFrame, row_kind: str, *, raw: str = "raw", entity: str = "seq", mode: str = "first"
) -> DataFrame:
    """H1: faults of raw JSON rows of one kind, as violations with the rule's message."""
    if row_kind not in RULES:
        raise ValueError(f"unknown artifact kind: {row_kind}")

    fields = Fields()
    found = F.array_compact(F.array(*RULES[row_kind](fields)))
    if mode == "first":
        found = F.slice(found, 1, 1)
    is_object = F.coalesce(kind(F.col("__report")), F.lit("none")) == "object"
    # Behind an explode of one item the parse stands as a column; as an expression it would run once per field.
    parsed = rows.select(F.col(entity).cast("string").alias("entity_id"), F.explode(F.array(F.try_parse_json(raw))).alias("__report"))
    read = fields.read(parsed, "__report").withColumn("__object", is_object)
    return read.select(
        F.lit(f"H1_{row_kind}").alias("rule_id"),
        F.lit("error").alias("severity"),
        "entity_id",
        F.explode(F.when(F.col("__object"), found).otherwise(F.array(F.lit("row must be an object")))).alias("detail"),
    )
