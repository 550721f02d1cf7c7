"""Task profiling and few-shot splits.

A group may hold a large share of all tasks. Members are therefore picked with ``row_number() <=
k`` filters, which Spark turns into a per-task top-k before the shuffle (WindowGroupLimit), and
group sizes come from ordinary partial counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalweave.functions.expr import count_where, has_text, id_part
from evalweave.operators.responses import kind
from evalweave.operators.violations import rule_rows, union_all, violation

GROUP = ["domain1", "domain2", "lang"]
TASK_FIELDS = ["source", "source_id", "domain", "task_input", "supervision", "judge"]  # fixed values: fields of a split task


def _or_unknown(c: str):
    return F.coalesce(F.col(c), F.lit("unknown")).alias(c)


def source_profile(tasks: DataFrame, *, top: int = 10) -> DataFrame:
    """B1: rows, distinct domains, rows per language and the largest domains, as one long table."""
    domain = F.concat_ws(" / ", *[F.coalesce(F.col(c), F.lit("unknown")) for c in ("domain1", "domain2")])
    counts = tasks.select(domain.alias("domain"), _or_unknown("lang")).groupBy("domain", "lang").agg(
        F.count("*").alias("n")
    )
    domains = counts.groupBy("domain").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.count_distinct("domain").alias("d"))
    head = total.select(F.explode(F.array(
        F.struct(F.lit("rows").alias("section"), F.lit("").alias("key"), F.coalesce("n", F.lit(0)).alias("n")),
        F.struct(F.lit("domains").alias("section"), F.lit("").alias("key"), F.col("d").alias("n")),
    )).alias("r")).select("r.*")
    langs = counts.groupBy("lang").agg(F.sum("n").alias("n")).select(F.lit("language").alias("section"), F.col("lang").alias("key"), "n")
    largest = domains.orderBy(F.desc("n"), "domain").limit(top).select(F.lit("top_domain").alias("section"), F.col("domain").alias("key"), "n")
    return union_all([head, langs, largest])


def canonical_tasks(raw: DataFrame, *, source: str, judge_type: str = "score_1_to_10", artifact: str = "written_response") -> DataFrame:
    """B2: source columns as the task row: domain map, supervision and judge as JSON text."""
    return raw.select(
        F.lit(source).alias("source"),
        F.col("source_id").cast("string").alias("source_id"),
        F.create_map(
            F.lit("primary"), F.col("domain1"), F.lit("secondary"), F.col("domain2"), F.lit("language"), F.col("lang")
        ).alias("domain"),
        F.col("task_input"),
        F.to_json(F.struct(F.lit("instance_specific_rubric").alias("type"), F.col("checklist").alias("items"))).alias("supervision"),
        F.to_json(F.struct(F.lit(judge_type).alias("type"))).alias("judge"),
        F.array(F.lit(artifact)).alias("expected_artifacts"),
    )


def grouped_tasks(tasks: DataFrame, *, known_bad: DataFrame | None = None, keys: Sequence[str] = GROUP) -> DataFrame:
    """Tasks with their group keys filled in, minus a known-bad list of ``source_id``."""
    if known_bad is not None:
        tasks = tasks.join(known_bad.select("source_id").distinct(), "source_id", "left_anti")
    return tasks.withColumns({k: F.coalesce(F.col(k), F.lit("unknown")) for k in keys})


def group_sizes(tasks: DataFrame, *, keys: Sequence[str] = GROUP) -> DataFrame:
    """Members per group."""
    return tasks.groupBy(*keys).agg(F.count("*").alias("size"))


def selected_groups(sizes: DataFrame, *, minimum: int, max_groups: int | None, keys: Sequence[str] = GROUP) -> DataFrame:
    """The ``max_groups`` largest groups with enough members, ranked; ties by key.

    The order and limit are a distributed top-k. The rank window then sees at most ``max_groups``
    rows. Without ``max_groups`` all eligible groups count, and none is ranked.
    """
    if max_groups is None:
        return sizes.filter(F.col("size") >= minimum).withColumn("group_rank", F.lit(None).cast("int"))
    order = [F.desc("size"), *[F.asc(k) for k in keys]]
    top = sizes.filter(F.col("size") >= minimum).orderBy(*order).limit(max_groups)
    return top.withColumn("group_rank", F.row_number().over(W.orderBy(*order)))


def few_shot_split(
    tasks: DataFrame,
    *,
    train_size: int,
    heldout_size: int,
    max_groups: int | None,
    seed: int = 7,
    prefix: str = "tasks",
    keys: Sequence[str] = GROUP,
) -> DataFrame:
    """One split per selected group: ``train_size`` train, then ``heldout_size`` heldout rows.

    Members are drawn in the order of a seeded hash of their id. (The reference draws from one
    shared random stream: same sizes, roles and eligibility, other members.)
    """
    need = train_size + heldout_size
    groups = selected_groups(group_sizes(tasks, keys=keys), minimum=need, max_groups=max_groups, keys=keys)
    members = tasks.join(groups, list(keys))
    draw = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col("source_id").cast("string")))
    order = W.partitionBy(*keys).orderBy(draw, F.col("source_id"))
    picked = members.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= need)
    split_id = F.replace(F.concat_ws("::", F.lit(prefix), *keys), F.lit(" "), F.lit("_"))
    return picked.select(
        split_id.alias("split_id"),
        "group_rank",
        F.when(F.col("n") <= train_size, "train").otherwise("heldout").alias("role"),
        F.when(F.col("n") <= train_size, F.col("n") - 1).otherwise(F.col("n") - 1 - train_size).alias("pos"),
        *[c for c in tasks.columns],
    )


def group_selection_summary(
    sizes: DataFrame, *, train_size: int, heldout_size: int, max_groups: int, largest: int = 10
) -> DataFrame:
    """How many groups were eligible, selected, too small or cut off, and the largest sizes."""
    need = train_size + heldout_size
    agg = sizes.agg(F.count("*").alias("total_groups"), count_where(F.col("size") >= need).alias("eligible_groups"))
    top = sizes.orderBy(F.desc("size")).limit(largest).agg(F.sort_array(F.collect_list("size"), asc=False).alias("largest_group_sizes"))
    chosen = F.least(F.col("eligible_groups"), F.lit(max_groups))
    return agg.select("*", top.scalar().alias("largest_group_sizes")).select(
        "total_groups",
        "eligible_groups",
        chosen.alias("selected_groups"),
        (F.col("total_groups") - F.col("eligible_groups")).alias("skipped_too_small"),
        (F.col("eligible_groups") - chosen).alias("truncated_by_max_groups"),
        F.lit(need).alias("minimum_group_size"),
        F.lit(max_groups).alias("max_groups"),
        "largest_group_sizes",
    )


def split_violations(splits: DataFrame, split_tasks: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Every fault of a split table, one row per fault.

    ``splits``: ``split_id, source, learning_problem, domain``. ``split_tasks``: ``split_id, role,
    pos, source, source_id, domain, task_input, supervision, judge``, the last two and ``domain``
    as JSON text. Nearly every row is a group of its own, so rows are dealt out as they are and grouped
    behind the deal; ``partitions`` is over how many tasks, for tables too large for the session's number.
    """
    t = split_tasks
    where = F.concat_ws(".", F.col("split_id"), F.concat(F.col("role"), F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    error = lambda rule_id, cond, detail="": (rule_id, "error", cond, detail)
    deal = lambda df, *keys: df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    is_object = lambda f: F.coalesce(kind(F.try_parse_json(F.col(f).cast("string"))) == "object", F.lit(False))
    roles = deal(t.select("split_id", "role"), "split_id").groupBy("split_id").agg(
        count_where(F.col("role") == "train").alias("train"), count_where(F.col("role") == "heldout").alias("heldout")
    )
    ids = deal(splits.select("split_id"), "split_id")  # one deal for the join and for repeated ids
    sized = ids.join(roles, "split_id", "left").na.fill(0, ["train", "heldout"])
    task = F.concat_ws("/", F.col("source"), F.col("source_id").cast("string"))
    keys = ["source", "source_id", "split_id"]
    uses = deal(t.select(*keys), "source_id", "split_id").groupBy(*keys).agg(F.count("*").alias("n"))
    across = uses.groupBy("source", "source_id").agg(F.count("*").alias("n")).filter("n > 1")
    return union_all([
        violation(splits.limit(1).agg(F.count("*").alias("n")).filter("n = 0"), "B6_empty", F.lit(""), "split file is empty"),
        rule_rows(splits, "split_id", [
            error("B6_missing_split_field", F.col(f).isNull(), f) for f in ("split_id", "source", "learning_problem", "domain")
        ]),
        *[violation(t.filter(F.col(f).isNull()), "B6_missing_task_field", where, f) for f in TASK_FIELDS],
        violation(t.filter(F.col("task_input").isNotNull() & ~has_text("task_input")), "B6_blank_task_input", where),
        *[violation(t.filter(F.col(f).isNotNull() & ~is_object(f)), "B6_not_an_object", where, f) for f in ("domain", "supervision", "judge")],
        rule_rows(sized, "split_id", [error("B6_empty_role", F.col(role) == 0, role) for role in ("train", "heldout")]),
        violation(ids.groupBy("split_id").agg(F.count("*").alias("n")).filter("n > 1"), "B6_duplicate_split_id", "split_id"),
        violation(uses.filter("n > 1"), "B6_duplicate_in_split", "split_id", task),
        violation(across, "B6_duplicate_across_splits", task, F.col("n").cast("string")),
    ])


def split_totals(splits: DataFrame, split_tasks: DataFrame) -> DataFrame:
    """Splits, train rows and heldout rows per split source."""
    per_split = split_tasks.groupBy("split_id").agg(
        count_where(F.col("role") == "train").alias("train"), count_where(F.col("role") == "heldout").alias("heldout")
    )
    src = F.when(id_part("source") == "", "unknown").otherwise(F.col("source")).alias("source")
    return splits.join(per_split, "split_id", "left").groupBy(src).agg(
        F.count("*").alias("num_splits"),
        F.coalesce(F.sum("train"), F.lit(0)).alias("train_examples"),
        F.coalesce(F.sum("heldout"), F.lit(0)).alias("heldout_tasks"),
    )
