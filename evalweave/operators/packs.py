"""Packs, private rows, generation jobs and prompts as flat tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.expr import count_where, has_text, id_part, let, slug, strip
from evalweave.functions.scan import DEFAULT_BLOCK, blocked_scan, blocked_scans

MAX_MATERIAL_CHARS = 16_000  # fixed value: default material budget of a prompt
TEMPLATE_VERSION = "desired-output/user-visible-only/v2"  # fixed value
NO_MATERIALS = "No separate material files."  # fixed value


def render(template: str, values: Mapping[str, Column]) -> Column:
    """A template with ``{name}`` places filled from columns; nulls become empty."""
    parts = []
    for piece in re.split(r"(\{[a-z_]+\})", template):
        name = piece[1:-1]
        if piece.startswith("{") and name in values:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


# -- C2 ---------------------------------------------------------------------------------------


def material_context(
    materials: DataFrame, *, max_chars: int = MAX_MATERIAL_CHARS, owner: str = "owner_id", block: int = DEFAULT_BLOCK
) -> DataFrame:
    """Per owner, material texts in ``pos`` order within a character budget.

    ``materials``: owner, ``pos``, ``path``, ``status``, ``text``. Each excerpt is the text cut to
    what is left, then stripped; its stripped length is charged. A blank excerpt leaves a header.

    The exact rule is a fold, which needs the rows of an owner in order. Only rows that can still
    matter reach it: those before the budget is used up by whole texts, and behind them (a cut may
    end in blanks that are not charged) as many as could use up the rest, each charging at least
    one character. Blank materials charge nothing, whatever is left, so a run of them between two
    others is one step of the fold: its headers are joined beforehand, block by block. An owner
    with millions of materials thus gathers a list of at most a few times ``max_chars`` items.
    """
    body = F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("## Material: "), F.coalesce("path", F.lit("None")), F.lit(" ("), F.coalesce("status", F.lit("None")), F.lit(")"))
    rows = materials.select(
        owner, F.col("pos").cast("long").alias("pos"), head.alias("head"), F.length(strip(body)).alias("__full"), F.substring(body, 1, max_chars).alias("text")
    )
    rows = blocked_scans(rows, [owner], "pos", {"__prior": F.col("__full"), "__run": (F.col("__full") > 0).cast("int")}, block=block)
    late = F.col("__prior") >= max_chars
    starts = late & (F.length(strip(F.substring("text", 1, 1))) > 0)
    rows = blocked_scan(rows, [owner], "pos", F.when(starts, 1).otherwise(0), "__late", block=block)
    rows = rows.filter(~late | (F.col("__late") < max_chars))
    joined = lambda at, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text]), "\n\n")
    blank = rows.filter("__full = 0").withColumn("__blk", F.floor(F.col("pos") / block))
    pieces = blank.groupBy(owner, "__run", "__blk").agg(joined("pos", "head").alias("head"), F.min("pos").alias("pos"))
    runs = pieces.groupBy(owner, "__run").agg(joined("__blk", "head").alias("head"), F.min("pos").alias("pos"))
    items = rows.filter("__full > 0").select(owner, "pos", "head", "text").unionByName(runs.select(owner, "pos", "head", F.lit("").alias("text")))
    lists = items.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("pos", "head", "text"))).alias("items"))
    start = F.struct(F.lit(max_chars).cast("long").alias("left"), F.lit("").alias("out"))

    def step(acc: Column, item: Column) -> Column:
        sep = F.when(acc["out"] == "", F.lit("")).otherwise(F.lit("\n\n"))

        def add(cut: Column) -> Column:
            body = F.when(cut != "", F.concat(item["head"], F.lit("\n"), cut)).otherwise(item["head"])
            return F.when(
                acc["left"] > 0,
                F.struct(
                    (acc["left"] - F.length(cut)).alias("left"), F.concat(acc["out"], sep, body).alias("out")
                ),
            ).otherwise(acc)

        return let(strip(F.substring(item["text"], F.lit(1), F.greatest(acc["left"], F.lit(0)).cast("int"))), add)

    return lists.select(owner, F.aggregate("items", start, step, lambda acc: acc["out"]).alias("context"))


# -- C3, C5 -----------------------------------------------------------------------------------


def task_ids(split_tasks: DataFrame) -> DataFrame:
    """Pack and row ids of split tasks: ``<pack>::train::<pos>``, ``<pack>::heldout::<pos>``."""
    pack = slug("split_id")
    return split_tasks.withColumn("pack_id", pack).withColumn(
        "task_ref", F.concat_ws("::", F.col("pack_id"), F.col("role"), F.col("pos").cast("string"))
    )


def public_examples(split_tasks: DataFrame) -> DataFrame:
    """Train rows a user may see, with a placeholder for the output."""
    t = task_ids(split_tasks).filter(F.col("role") == "train")
    return t.select(
        "pack_id",
        F.col("task_ref").alias("example_id"),
        "pos",
        "source",
        F.col("source_id").cast("string").alias("source_task_id"),
        "domain",
        "task_input",
        F.lit("needs_generation").alias("output_status"),
        F.concat(F.col("task_ref"), F.lit("::generate_desired_output")).alias("job_id"),
    )


def public_heldout(split_tasks: DataFrame) -> DataFrame:
    """Heldout rows a user may see; they carry no output."""
    t = task_ids(split_tasks).filter(F.col("role") == "heldout")
    return t.select(
        "pack_id",
        F.col("task_ref").alias("task_id"),
        "pos",
        "source",
        F.col("source_id").cast("string").alias("source_task_id"),
        "domain",
        "task_input",
    )


def private_tasks(split_tasks: DataFrame) -> DataFrame:
    """What only the evaluation may read: supervision, judge, statistics."""
    stats = F.col("statistics") if "statistics" in split_tasks.columns else F.lit(None).cast("string").alias("statistics")
    return task_ids(split_tasks).select(
        "pack_id", "role", "task_ref", "source", F.col("source_id").cast("string").alias("source_task_id"),
        "supervision", "judge", stats,
    )


def pack_rows(splits: DataFrame) -> DataFrame:
    """One pack per split, with the fields its consumers may and must not use."""
    return splits.select(
        slug("split_id").alias("pack_id"),
        "split_id",
        "source",
        F.coalesce("learning_problem", F.lit("few_shot_skill_induction")).alias("learning_problem"),
        "domain",
        F.array(F.lit("train_examples.task_input"), F.lit("train_examples.materials"), F.lit("train_examples.desired_output.text")).alias("can_use"),
        F.array(F.lit("private rubrics"), F.lit("private judge prompts"), F.lit("heldout tasks"), F.lit("heldout scores")).alias("must_not_use"),
    )


def nested_export(rows: DataFrame, *, by: str = "pack_id", name: str = "items") -> DataFrame:
    """Child rows as one ordered array per parent, for JSON export at the edge.

    A pack has as many children as its split was built with (train plus heldout size), which
    bounds the arrays.
    """
    rest = [c for c in rows.columns if c not in (by, "pos")]
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias(name))


# -- C4 ---------------------------------------------------------------------------------------


def generation_jobs(
    split_tasks: DataFrame,
    *,
    template: str,
    contexts: DataFrame | None = None,
    budget: int = MAX_MATERIAL_CHARS,
    version: str = TEMPLATE_VERSION,
) -> DataFrame:
    """C4: one job per train row, its prompt rendered and hashed.

    ``template`` may use ``{example_id}``, ``{artifacts}``, ``{task_input}``, ``{materials}``.
    ``contexts``: ``source_id, context`` from C2.
    """
    t = task_ids(split_tasks).filter(F.col("role") == "train")
    if contexts is not None:
        t = t.join(contexts.select("source_id", "context"), "source_id", "left")
    else:
        t = t.withColumn("context", F.lit(None).cast("string"))
    kinds = F.array_join("expected_artifacts", ", ") if "expected_artifacts" in t.columns else F.lit("")
    prompt = render(
        template,
        {
            "example_id": F.col("task_ref"),
            "artifacts": F.when(kinds == "", F.lit("task output")).otherwise(kinds),
            "task_input": F.col("task_input"),
            "materials": F.coalesce("context", F.lit(NO_MATERIALS)),
        },
    )
    return t.withColumn("prompt", prompt).select(
        F.concat(F.col("task_ref"), F.lit("::generate_desired_output")).alias("job_id"),
        F.sha2("prompt", 256).alias("prompt_sha256"),
        "pack_id",
        F.col("task_ref").alias("example_id"),
        "source",
        F.col("source_id").cast("string").alias("source_task_id"),
        F.lit(version).alias("prompt_template_version"),
        F.lit(budget).alias("material_budget_chars"),
        "prompt",
    )


# -- C6, C7, C8 -------------------------------------------------------------------------------


def pack_summary(tasks: DataFrame, material_counts: DataFrame | None = None) -> DataFrame:
    """Per pack, train and heldout rows, a token estimate and the number of materials.

    ``tasks``: ``pack_id, source, role, task_ref, task_input``; ``material_counts``: ``task_ref, n``.
    """
    if material_counts is None:
        tasks = tasks.withColumn("n", F.lit(0).cast("long"))
    else:
        tasks = tasks.join(material_counts.select("task_ref", "n"), "task_ref", "left")
    tokens = F.greatest(F.lit(1), F.floor(F.length(F.coalesce("task_input", F.lit(""))) / 4)).cast("long")
    return tasks.groupBy("pack_id", "source").agg(
        count_where(F.col("role") == "train").alias("train"),
        count_where(F.col("role") == "heldout").alias("heldout"),
        F.sum(tokens).alias("input_tokens_est"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("materials"),
    )


def pack_totals(summary: DataFrame) -> DataFrame:
    """Totals per source."""
    return summary.groupBy("source").agg(
        F.count("*").alias("packs"), F.sum("train").alias("train"), F.sum("heldout").alias("heldout")
    )


def usable_examples(examples: DataFrame) -> DataFrame:
    """Examples with a generated, non-blank output."""
    return examples.filter((F.col("output_status") == "generated") & has_text("output"))


def select_packs(
    packs: DataFrame,
    examples: DataFrame,
    *,
    pack_ids: Sequence[str] | None = None,
    source: str | None = None,
    min_usable: int = 1,
    limit: int | None = None,
) -> DataFrame:
    """Packs by id, source and number of usable examples, the first ``limit`` in ``seq`` order.

    Evaluation asks for one usable example, induction for two.
    """
    if pack_ids:
        packs = packs.filter(F.col("pack_id").isin(list(pack_ids)))
    if source:
        packs = packs.filter(F.col("source") == source)
    enough = usable_examples(examples).groupBy("pack_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_usable)
    out = packs.join(enough.select("pack_id"), "pack_id", "left_semi")
    return out if limit is None else out.orderBy("seq").limit(limit)


# -- C9 ---------------------------------------------------------------------------------------

# Modes that show examples.
EXAMPLE_MODES = [
    "few_shot_examples_only",
    "examples_plus_one_shot_skill",
    "examples_plus_feature_skill",
    "examples_plus_feature_signatures",
    "slide_constrained_examples_plus_feature_skill",
    "layout_plan_examples_plus_feature_skill",
]


def example_block(example_id: Column, task_input: Column, output: Column, paths: Column) -> Column:
    """One example as prompt text: heading, input, output, material list."""
    listed = F.array_join(F.transform(paths, lambda p: F.concat(F.lit("- "), p)), "\n")
    return F.concat(
        F.lit("### Example "), example_id,
        F.lit("\n\nTask input:\n"), task_input,
        F.lit("\n\nDesired output:\n"), F.when(id_part(output) == "", F.lit("(missing output)")).otherwise(output),
        F.lit("\n\nMaterials:\n"), F.when(id_part(listed) == "", F.lit("- None")).otherwise(listed),
        F.lit("\n"),
    )


def eval_prompts(
    cells: DataFrame,
    tasks: DataFrame,
    examples: DataFrame,
    skills: DataFrame,
    *,
    template: str,
    example_modes: Sequence[str] = EXAMPLE_MODES,
    no_examples: str = "",
) -> DataFrame:
    """The prompt of every cell: task, the pack's examples in order, the mode's skill text.

    ``skills``: ``pack_id, mode, skill_md`` by evaluation mode. ``template`` may use
    ``{task_input}``, ``{examples}``, ``{skill}``. The examples of a pack are gathered once per
    pack (a pack has ``train_size`` of them) and joined to its cells.
    """
    block = example_block(
        F.col("example_id"), F.coalesce("task_input", F.lit("")), F.col("output"), F.array().cast("array<string>")
    )
    shown = (
        usable_examples(examples)
        .groupBy("pack_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("block")))).alias("blocks"))
        .select("pack_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "\n").alias("examples"))
    )
    with_examples = F.col("mode").isin(*example_modes)
    joined = (
        cells.join(tasks.select("pack_id", "task_id", "task_input"), ["pack_id", "task_id"])
        .join(shown, "pack_id", "left")
        .join(skills.select("pack_id", "mode", "skill_md"), ["pack_id", "mode"], "left")
    )
    prompt = render(
        template,
        {
            "task_input": F.col("task_input"),
            "examples": F.when(with_examples, F.col("examples")).otherwise(F.lit(no_examples)),
            "skill": F.col("skill_md"),
        },
    )
    return joined.withColumn("prompt", prompt).select(
        "pack_id", "task_id", "mode", "prompt", F.sha2("prompt", 256).alias("prompt_sha256")
    )
