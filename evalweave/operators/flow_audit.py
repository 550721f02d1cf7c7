"""Audit of splits, packs, private rows, jobs and log against each other (H2).

Rules that read the same joined row are evaluated together on one join; set comparisons are one
grouping of both sides. Nothing is gathered per pack, so a pack of any size spreads over its
ids. Every rule reports all its violations.

``audit_flow`` writes the violations of one part of the rules after the other to the shared folder, so
that the disk holds the shuffle files of one part, not of all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.expr import has_text, id_part, lit_list
from evalweave.functions.joins import one_row
from evalweave.functions.patterns import PRIVATE_LEAK_PATTERNS, pattern_hits
from evalweave.functions.scratch import settled
from evalweave.operators.packs import TEMPLATE_VERSION
from evalweave.operators.text import private_key_paths
from evalweave.operators.violations import rule_rows, union_all, violation

# Pack fields that induction may and must be allowed to read.
ALLOWED_FIELDS = ["train_examples.task_input", "train_examples.materials", "train_examples.desired_output.text"]
REQUIRED_FIELDS = ["train_examples.desired_output.text"]


@dataclass(frozen=True)
class FlowTables:
    """The five table families of the audit, as flat tables.

    - ``splits``: ``split_id, source, domain``; ``split_tasks``: ``split_id, role, source, source_id``
    - ``packs``: ``pack_id, split_id, source, domain, can_use, must_not_use`` (arrays or null) and,
      optionally, ``payload``: the pack as JSON text, searched for private keys
    - ``examples``: ``pack_id, pos, example_id, source, source_task_id, output_status, output,
      job_id, prompt_sha256, prompt_template_version``
    - ``heldout``: ``pack_id, pos, task_id, source, source_task_id, has_output``
    - ``private_rows``: ``pack_id, split_id, source``; ``private_tasks``: ``pack_id, role, pos,
      task_ref, source, source_task_id, supervision, judge``
    - ``jobs``: ``job_id, pack_id, example_id, source, source_task_id, prompt_sha256,
      prompt_template_version, prompt, material_budget_chars``; ``log``: as in D6, with the same ids
    - ``replayed``: ``example_id, prompt``, prompts built again from the split tasks (C4)
    """

    splits: DataFrame
    split_tasks: DataFrame
    packs: DataFrame
    examples: DataFrame
    heldout: DataFrame
    private_rows: DataFrame
    private_tasks: DataFrame
    jobs: DataFrame | None = None
    log: DataFrame | None = None
    replayed: DataFrame | None = None
    required_sources: tuple[str, ...] = ()
    patterns: tuple[str, ...] = field(default_factory=lambda: tuple(PRIVATE_LEAK_PATTERNS))
    template_version: str = TEMPLATE_VERSION


def _differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def _duplicates(df: DataFrame, key: str, rule_id: str) -> DataFrame:
    return violation(df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"), rule_id, key)


def _empty(df: DataFrame, rule_id: str, detail: str) -> DataFrame:
    return violation(df.limit(1).agg(F.count("*").alias("n")).filter("n = 0"), rule_id, F.lit(""), detail)


def table_rules(t: FlowTables) -> list[DataFrame]:
    """Empty tables, required sources, duplicate keys, unchecked provenance."""
    out = [
        _empty(t.packs, "H2_packs_empty", "example packs are empty"),
        _empty(t.private_rows, "H2_private_empty", "private eval rows are empty"),
        _duplicates(t.packs, "pack_id", "H2_duplicate_pack"),
        _duplicates(t.private_rows, "pack_id", "H2_duplicate_private_pack"),
    ]
    if t.required_sources:
        present = t.splits.select("source").distinct().withColumn("here", F.lit(True))
        wanted = t.splits.sparkSession.range(1).select(F.explode(lit_list(list(t.required_sources))).alias("source"))
        missing = wanted.join(present, "source", "left_anti")
        out.append(violation(missing, "H2_missing_source", "source"))
    if t.jobs is not None:
        out.append(_duplicates(t.jobs.filter(F.col("job_id").isNotNull()), "job_id", "H2_duplicate_job"))
    refs = t.examples.filter((id_part("job_id") != "") | (id_part("prompt_sha256") != "")).limit(1)
    if t.jobs is None:
        out.append(violation(refs, "H2_jobs_not_checked", F.lit(""), "generation job provenance not checked", "warning"))
    if t.log is None:
        out.append(violation(refs, "H2_outputs_not_checked", F.lit(""), "generated output provenance not checked", "warning"))
    return out


def pack_rules(t: FlowTables) -> list[DataFrame]:
    """Pack against its split and its private row, and the input boundary."""
    s = t.splits.select(
        "split_id", F.lit(True).alias("s_found"), F.col("source").alias("s_source"), F.col("domain").alias("s_domain")
    )
    p = t.private_rows.filter(id_part("pack_id") != "").select(
        "pack_id", F.lit(True).alias("p_found"), F.col("split_id").alias("p_split"), F.col("source").alias("p_source")
    )
    s, p = one_row(s, "split_id"), one_row(p, "pack_id")
    joined = t.packs.join(s, "split_id", "left").join(p, "pack_id", "left")
    found, private = F.col("s_found").isNotNull(), F.col("p_found").isNotNull()
    use, forbid = F.col("can_use"), F.col("must_not_use")
    has_boundary = use.isNotNull() | forbid.isNotNull()
    extra = F.array_except(use, lit_list(ALLOWED_FIELDS))
    lack = F.array_except(lit_list(REQUIRED_FIELDS), F.coalesce(use, F.array().cast("array<string>")))
    out = [
        rule_rows(
            joined,
            "pack_id",
            [
                ("H2_split_missing", "error", ~found, F.col("split_id")),
                ("H2_source_differs", "error", found & _differs("source", "s_source"), F.col("split_id")),
                ("H2_domain_differs", "error", found & _differs("domain", "s_domain"), F.col("split_id")),
                ("H2_boundary_missing", "error", ~has_boundary, ""),
                ("H2_boundary_no_forbidden", "error", has_boundary & (F.coalesce(F.size(forbid), F.lit(0)) <= 0), ""),
                ("H2_boundary_required", "error", has_boundary & (F.size(lack) > 0), F.array_join(lack, ",")),
                ("H2_boundary_extra", "error", F.size(extra) > 0, F.array_join(F.array_sort(extra), ",")),
                ("H2_private_row_missing", "error", ~private, ""),
                ("H2_private_split_differs", "error", private & _differs("split_id", "p_split"), ""),
                ("H2_private_source_differs", "error", private & _differs("source", "p_source"), ""),
            ],
        )
    ]
    if "payload" in t.packs.columns:
        hits = private_key_paths(t.packs, "payload", ["pack_id"])
        out.append(violation(hits, "H2_private_key_in_pack", "pack_id", F.col("path")))
    return out


def _visible(t: FlowTables) -> DataFrame:
    """Visible tasks of both roles: ``pack_id, role, ref, source, source_task_id``."""
    cols = ["pack_id", "source", "source_task_id"]
    train = t.examples.select(*cols, F.col("example_id").alias("ref"), F.lit("train").alias("role"))
    held = t.heldout.select(*cols, F.col("task_id").alias("ref"), F.lit("heldout").alias("role"))
    return train.unionByName(held).filter(id_part("ref") != "")


def _faults(*hits: tuple[Column, str, Column, Column, Column | bool]) -> Column:
    """The hits ``(condition, rule_id, entity_id, detail, needs)`` that hold, as an array of structs; null if none does."""
    text = lambda c: F.coalesce(c, F.lit("")).cast("string")
    return _held([
        (cond, F.struct(
            F.lit(rule).alias("rule_id"), text(entity).alias("entity_id"), text(detail).alias("detail"),
            (F.lit(needs) if isinstance(needs, bool) else needs).alias("needs"),
        ))
        for cond, rule, entity, detail, needs in hits
    ])


def _held(hits: list[tuple[Column, Column]]) -> Column:
    """The structs whose condition holds. Rows without a fault, which are most, make no array."""
    conds = [F.coalesce(cond, F.lit(False)) for cond, _ in hits]
    found = F.array_compact(F.array(*[F.when(cond, made) for cond, (_, made) in zip(conds, hits)]))
    return F.when(reduce(Column.__or__, conds), found)


def _each(df: DataFrame, *cols: str | Column) -> DataFrame:
    """One row with ``f`` per element of ``faults``. A plain explode would put a filter that makes them twice below."""
    return df.select(*cols, F.explode_outer("faults").alias("f")).filter(F.col("f").isNotNull())


def _of_packs(faults: DataFrame, *packs: DataFrame) -> DataFrame:
    """Distinct violations of an array of faults; those with ``needs`` only for packs in all of ``packs``.

    The packs meet the faults alone, never the tasks the faults were found in.
    """
    rows = _each(faults, "pack_id").select("pack_id", "f.*").distinct()
    for i, known in enumerate(packs):
        mark = known.select("pack_id", F.lit(True).alias(f"in_{i}")).distinct()
        rows = rows.join(mark, "pack_id", "left").filter(~F.col("needs") | F.col(f"in_{i}"))
    # A fault found both with and without the need is one violation.
    rows = rows.select("pack_id", "rule_id", "entity_id", "detail").distinct()
    return rows.select("rule_id", F.lit("error").alias("severity"), "entity_id", "detail")


# Bits of a row's role and side: a train task of the first and of the second side, a heldout task of either.
_TRAIN_1, _TRAIN_2, _HELD_1, _HELD_2 = 1, 2, 4, 8


def _sides(first: DataFrame, second: DataFrame, *key: str) -> DataFrame:
    """Rows of both sides, dealt by ``key``, with ``other, name_other, bits`` in place of ``role``.

    These are whether the role is neither train nor heldout, its name then, and the row's bit. A role beyond the
    two takes train's bits, in a group of its own.
    """
    rows = first.withColumn("second", F.lit(False)).unionByName(second.withColumn("second", F.lit(True))).repartition(*key)
    other = ~F.coalesce(F.col("role").isin("train", "heldout"), F.lit(False))
    bits = lambda one, two: F.when(F.col("second"), two).otherwise(one)
    bits = F.when(F.col("role") == "heldout", bits(_HELD_1, _HELD_2)).otherwise(bits(_TRAIN_1, _TRAIN_2))
    return rows.withColumns({"other": other, "name_other": F.when(other, F.col("role")), "bits": bits}).drop("role", "second")


def _as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def task_rules(t: FlowTables, kept: Callable[[DataFrame, str], DataFrame] = _as_is) -> list[DataFrame]:
    """Overlap of roles, visible tasks against split tasks and private refs, repeated private refs.

    All rules that read a task's id share one grouping by pack and id, those that read its source pair
    one by pack and pair. What a group holds of train and heldout are bits and numbers, never a list.
    """
    seen = _visible(t)
    bits = lambda *which: F.col("bits").bitwiseAND(sum(which)) == sum(which)
    uneven = lambda one, two: F.col("bits").bitwiseAND(one + two).isin(one, two)
    first_role = F.when(F.col("other"), F.col("name_other")).otherwise(F.lit("train"))

    # By source pair: overlap of roles, and the split's tasks (side 1) against the pack's (side 2).
    # A pair travels as its name and the length of its source.
    pair = F.concat_ws("/", "source", "source_task_id")
    whole = F.col("source").isNotNull() & F.col("source_task_id").isNotNull()
    known = t.packs.select("pack_id", "split_id").join(t.splits.select("split_id").distinct(), "split_id")
    by_pair = ["pack_id", pair.alias("name"), F.length("source").alias("at"), "role"]
    of_split = known.join(
        t.split_tasks.select("split_id", "role", "source", F.col("source_id").cast("string").alias("source_task_id")), "split_id"
    ).dropna(subset=["pack_id", "role", "source", "source_task_id"]).select(*by_pair)
    sides = _sides(of_split, seen.filter(whole).select(*by_pair), "pack_id", "name")
    name = ["pack_id", "name", "other", "name_other"]
    pairs = sides.groupBy(*name, "at").agg(F.bit_or("bits").alias("bits"))
    # Sides of roles that only one side has, beside those of the name, which two pairs may share.
    lone = F.when(uneven(_TRAIN_1, _TRAIN_2), F.col("bits").bitwiseAND(_TRAIN_1 + _TRAIN_2)).otherwise(0).bitwiseOR(
        F.when(uneven(_HELD_1, _HELD_2), F.col("bits").bitwiseAND(_HELD_1 + _HELD_2)).otherwise(0)
    )
    pairs = pairs.groupBy(*name).agg(F.bit_or("bits").alias("bits"), F.bit_or(lone).alias("lone"))
    is_lone = lambda bit: F.col("pack_id").isNotNull() & (F.col("lone").bitwiseAND(bit) != 0)
    pair_faults = _faults(
        (~F.col("other") & bits(_TRAIN_2, _HELD_2), "H2_source_tasks_overlap", F.col("pack_id"), F.col("name"), False),
        *[(is_lone(bit), "H2_split_tasks_differ", F.col("pack_id"), role, needs) for bit, role, needs in (
            (_TRAIN_1, first_role, False), (_TRAIN_2, first_role, True), (_HELD_1, F.lit("heldout"), False), (_HELD_2, F.lit("heldout"), True),
        )],
    )
    out = [kept(_of_packs(pairs.select("pack_id", pair_faults.alias("faults")), known), "flow-pairs")]

    # By id: overlap of roles, repeated private refs (side 2), and visible tasks (side 1) against private refs.
    private = t.private_tasks.filter(id_part("task_ref") != "").select(
        "pack_id", F.col("task_ref").cast("string").alias("ref"), F.col("source").cast("string").alias("source"),
        F.col("source_task_id").cast("string").alias("source_task_id"), "role",
    )
    # Pairs are compared by their hash; one with a missing part counts as no pair at all on either side.
    sides = _sides(seen, private, "pack_id", "ref")
    sides = sides.select("pack_id", "ref", "other", "name_other", "bits", F.when(whole, F.xxhash64("source", "source_task_id")).alias("pair"))
    # Of rows that share pack, role and ref the greatest hash stays, whatever the partitioning.
    of = lambda bit: F.max(F.when(F.col("bits") == bit, F.col("pair")))
    refs = sides.groupBy("pack_id", "ref", "other", "name_other").agg(
        F.bit_or("bits").alias("bits"), *[of(bit).alias(f"pair_{bit}") for bit in (_TRAIN_1, _TRAIN_2, _HELD_1, _HELD_2)],
        *[F.count(F.when(F.col("bits") == bit, 1)).alias(f"n_{bit}") for bit in (_TRAIN_2, _HELD_2)],
    )
    ref_faults = [(~F.col("other") & bits(_TRAIN_1, _HELD_1), "H2_ids_overlap", F.col("pack_id"), F.col("ref"), False)]
    for one, two, role in ((_TRAIN_1, _TRAIN_2, first_role), (_HELD_1, _HELD_2, F.lit("heldout"))):
        ref_faults += [
            (uneven(one, two), "H2_private_refs_differ", F.col("pack_id"), role, True),
            (bits(two) & ~F.col(f"pair_{two}").eqNullSafe(F.col(f"pair_{one}")), "H2_private_source_id", F.col("pack_id"), F.concat_ws(".", role, F.col("ref")), True),
            (F.col(f"n_{two}") > 1, "H2_duplicate_task_ref", F.concat_ws(".", F.col("pack_id"), role), F.col("ref"), False),
        ]
    out.append(kept(_of_packs(refs.select("pack_id", _faults(*ref_faults).alias("faults")), t.private_rows, t.packs), "flow-refs"))
    return out


def output_rules(t: FlowTables, kept: Callable[[DataFrame, str], DataFrame] = _as_is) -> list[DataFrame]:
    """Frozen outputs: present, clean, and equal to their job and to the latest log row.

    Texts stay beside their scans: what the rules ask of them (blank or not, leaks, a digest) goes on in
    their place. Log and jobs are met one after the other, by the examples that can have a row there. What
    a join brought is judged right behind it, so the next one carries the few faults, not the other side.
    """
    # 64 bits of the SHA-256, for texts and hashes that are only compared with their counterpart.
    digest = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 16))
    hit = lambda rule, cond, detail="", severity="error": (cond, rule, severity, detail)

    def judged(df: DataFrame, hits) -> DataFrame:
        return df.withColumn("faults", _held([
            (c, F.struct(
                F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.coalesce(F.lit(d) if isinstance(d, str) else d.cast("string"), F.lit("")).alias("detail")
            ))
            for c, r, s, d in hits
        ]))

    def told(df: DataFrame, entity: Column | None = None) -> DataFrame:
        example = F.concat_ws("/", "pack_id", "example_id")
        found = _each(df, (example if entity is None else F.coalesce(entity, example)).alias("entity_id"))
        return found.select("f.rule_id", "f.severity", "entity_id", "f.detail")

    own = ["pack_id", "example_id", "source", "source_task_id"]
    template = F.col("prompt_template_version")
    is_gen = F.coalesce(F.col("output_status") == "generated", F.lit(False))
    examples = t.examples.select(
        *own, "output_status", "prompt_template_version", F.when(id_part("job_id") != "", F.col("job_id").cast("string")).alias("job_id"),
        F.when(id_part("prompt_sha256") != "", F.col("prompt_sha256").cast("string")).alias("sha"), is_gen.alias("is_gen"), (is_gen & has_text("output")).alias("is_text"), "output",
    )
    frozen = F.col("is_text") & F.col("job_id").isNotNull()
    sha = F.col("sha").isNotNull()
    leaks = F.when(F.col("is_text"), pattern_hits(F.col("output"), t.patterns))
    rules = [
        hit("H2_not_frozen", ~F.col("is_gen"), F.coalesce("output_status", F.lit(""))),
        hit("H2_output_empty", F.col("is_gen") & ~F.col("is_text")),
        hit("H2_output_leaks", F.col("is_text") & (F.size("leaks") > 0), F.array_join("leaks", " | ")),
    ]
    if t.jobs is not None or t.log is not None:
        rules.append(hit("H2_no_job_id", F.col("is_text") & F.col("job_id").isNull()))
    if t.log is not None:
        rules.append(hit("H2_no_prompt_sha256", frozen & ~sha))
    out = [told(judged(examples.withColumn("leaks", leaks), rules))]

    if t.log is not None:
        key = ["job_id", "sha_key"]
        fields = [*own, "prompt_template_version", "status", "finish_reason"]
        row = F.struct(*[F.col(c).alias(f"g_{c}") for c in fields], F.col("g_digest"))
        keyed = t.log.filter((id_part("job_id") != "") & (id_part("prompt_sha256") != ""))
        keyed = keyed.select("job_id", digest("prompt_sha256").alias("sha_key"), "seq", *fields, digest("desired_output").alias("g_digest"))
        latest = keyed.repartition(*key).groupBy(*key).agg(F.max_by(row, "seq").alias("g"))
        named = examples.filter(frozen & sha).select(*own, "prompt_template_version", "job_id", digest("sha").alias("sha_key"), digest("output").alias("output_digest"))
        joined = named.join(latest.select(*key, "g.*", F.lit(True).alias("g_found")), key, "left")
        found = F.col("g_found").isNotNull()
        rules = [
            hit("H2_log_missing", ~found, F.col("job_id")),
            *[hit(f"H2_log_{c}", found & _differs(c, f"g_{c}")) for c in own],
            hit("H2_log_template", found & (id_part(template) != "") & _differs("prompt_template_version", "g_prompt_template_version")),
            hit("H2_log_status", found & ~F.col("g_status").eqNullSafe(F.lit("success")), F.col("g_status")),
            hit("H2_log_finish", found & ~F.col("g_finish_reason").eqNullSafe(F.lit("stop")), F.col("g_finish_reason")),
            hit("H2_log_text", found & _differs("output_digest", "g_digest")),
        ]
        out.append(kept(told(judged(joined, rules)), "flow-log"))

    if t.jobs is not None:
        j = t.jobs.filter(F.col("job_id").isNotNull()).select(
            F.col("job_id").cast("string").alias("job_id"), *[F.col(c).alias(f"j_{c}") for c in own], digest("prompt_sha256").alias("j_sha_key"),
            F.col("prompt_template_version").alias("j_prompt_template_version"), "material_budget_chars",
            has_text("prompt").alias("j_text"), digest("prompt").alias("j_digest"),
            (~F.col("prompt_sha256").eqNullSafe(F.sha2("prompt", 256))).alias("j_sha_differs"), F.array_join(pattern_hits(F.col("prompt"), t.patterns), " | ").alias("j_leaks"),
        )
        j = one_row(j.repartition("job_id"), "job_id").withColumn("j_found", F.lit(True))
        named = examples.filter(F.col("job_id").isNotNull()).select(*own, "prompt_template_version", "job_id", digest("sha").alias("sha_key"), frozen.alias("frozen"), F.lit(True).alias("e_found"))
        # A job that no example names stands alone in the full join.
        joined = named.join(j, "job_id", "full_outer")
        found = F.col("frozen") & F.col("j_found").isNotNull()
        text = found & F.col("j_text")
        is_current = F.col("j_prompt_template_version").eqNullSafe(F.lit(t.template_version))
        rules = [
            hit("H2_orphan_job", F.col("e_found").isNull(), "", "warning"),
            hit("H2_job_missing", F.col("frozen") & F.col("j_found").isNull(), F.col("job_id")),
            *[hit(f"H2_job_{c}", found & _differs(c, f"j_{c}")) for c in own],
            hit("H2_job_prompt_sha256", found & F.col("sha_key").isNotNull() & _differs("sha_key", "j_sha_key")),
            hit("H2_job_template", found & (id_part(template) != "") & _differs("prompt_template_version", "j_prompt_template_version")),
            hit("H2_job_prompt_empty", found & ~F.col("j_text")),
            hit("H2_job_sha_of_prompt", text & F.col("j_sha_differs")),
            hit("H2_job_prompt_leaks", text & (F.col("j_leaks") != ""), F.col("j_leaks")),
        ]
        joined = judged(joined, rules).select(
            *own, "faults", F.when(F.col("e_found").isNull(), F.col("job_id")).alias("orphan"), F.coalesce(text & is_current, F.lit(False)).alias("current"),
            F.when(text & ~is_current, F.coalesce("j_prompt_template_version", F.lit(""))).alias("stale"),
            F.when(text & is_current, F.col("j_digest")).alias("j_digest"), (F.coalesce("material_budget_chars", F.lit(1)) <= 0).alias("no_budget"),
        )
        joined = kept(joined, "flow-jobs")
        out.append(told(joined, F.col("orphan")))

        # What is left to say of a job, and then only of tasks of the split.
        current = joined.filter("current").select(*own, "no_budget", "j_digest")
        rules = [hit("H2_job_budget", F.col("no_budget"))]
        if t.replayed is not None:
            replayed = one_row(t.replayed.select("example_id", digest("prompt").alias("r_digest")).repartition("example_id"), "example_id")
            current = current.join(replayed, "example_id", "left")
            rules.append(hit("H2_job_prompt_replay", F.col("r_digest").isNotNull() & _differs("j_digest", "r_digest")))
        stale = judged(joined.filter(F.col("stale").isNotNull()), [hit("H2_job_not_replayed", F.lit(True), F.col("stale"), "warning")])
        late = judged(current, rules).select(*own, "faults").unionByName(stale.select(*own, "faults")).filter(F.col("faults").isNotNull())
        split_of = one_row(t.packs.select("pack_id", "split_id"), "pack_id")
        in_split = t.split_tasks.filter(F.col("role") == "train").select("split_id", "source", F.col("source_id").cast("string").alias("source_task_id"))
        late = late.join(split_of, "pack_id").join(in_split, ["split_id", "source", "source_task_id"], "left_semi")
        out.insert(0, kept(told(late), "flow-late"))
    return out


def private_rules(t: FlowTables, *, refs: bool = True) -> list[DataFrame]:
    """Heldout rows without output; private rows with a split and their content; with ``refs`` repeated refs.

    ``task_rules`` finds repeated refs as well, in a grouping it needs anyway.
    """
    p = t.private_tasks
    named = p.filter(id_part("task_ref") != "").select("pack_id", "role", F.col("task_ref").cast("string").alias("ref"))
    repeated = named.groupBy("pack_id", "role", "ref").agg(F.count("*").alias("n")).filter("n > 1")
    orphan_split = t.private_rows.join(t.splits.select("split_id").distinct(), "split_id", "left_anti")
    lone = t.private_rows.filter(id_part("pack_id") != "").select("pack_id").distinct().join(t.packs.select("pack_id"), "pack_id", "left_anti")
    where = F.concat_ws(".", F.col("pack_id"), F.col("role"), F.col("pos").cast("string"))
    out = [violation(repeated, "H2_duplicate_task_ref", F.concat_ws(".", "pack_id", "role"), F.col("ref"))] if refs else []
    return out + [
        violation(t.heldout.filter("has_output"), "H2_heldout_has_output", F.concat_ws("/", "pack_id", "task_id")),
        violation(orphan_split, "H2_private_split_missing", "pack_id", F.col("split_id")),
        violation(p.filter(F.col("supervision").isNull() | F.col("judge").isNull()), "H2_private_content", where),
        violation(lone, "H2_private_without_pack", "pack_id", "", "warning"),
    ]


def audit_flow(t: FlowTables, extra: list[DataFrame] | None = None) -> DataFrame:
    """H2: all violations. ``extra``: further tables, e.g. split faults (B6) or schema faults (H1).

    The parts of the rules run when this is called, one after the other; the frame reads their violations
    from ``spark.checkpoint.dir``.
    """
    parts = [
        settled(union_all(table_rules(t)), "flow-tables"), settled(union_all([*pack_rules(t), *private_rules(t, refs=False)]), "flow-packs"),
        *task_rules(t, settled), *output_rules(t, settled),
    ]
    return union_all([*(extra or []), *parts])
