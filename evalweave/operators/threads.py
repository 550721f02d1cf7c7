"""Review threads to packs split in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.expr import count_where, strip
from evalweave.operators.violations import violation

HUNK = r"@@ -\p{Nd}+(?:,\p{Nd}+)? \+(\p{Nd}+)(?:,(\p{Nd}+))? @@"


def hunk_lines(patch: Column) -> tuple[Column, Column]:
    """Start and end line of the first hunk header; a missing length is 1."""
    start = F.regexp_extract(patch, HUNK, 1).try_cast("long")
    length = F.coalesce(F.when(F.regexp_extract(patch, HUNK, 2) != "", F.regexp_extract(patch, HUNK, 2).try_cast("long")), F.lit(1))
    return start, start + length


def slice_threads(comments: DataFrame, files: DataFrame) -> DataFrame:
    """Each comment with the first changed file that has its path as new or previous name.

    ``comments``: ``repo, pr_number, comment_id, path, body, diff_hunk, merged_at``. ``files``:
    ``repo, pr_number, pos, filename, previous_filename, patch``. Names are resolved on narrow
    rows; the patch joins last. Comments without a file are dropped.
    """
    pr = ["repo", "pr_number"]
    names = files.select(*pr, "pos", F.explode(F.array_compact(F.array("filename", "previous_filename"))).alias("path"))
    first = names.groupBy(*pr, "path").agg(F.min("pos").alias("pos"))
    start, end = hunk_lines(F.coalesce("patch", F.lit("")))
    return (
        comments.join(first, [*pr, "path"])
        .join(files.select(*pr, "pos", "patch"), [*pr, "pos"])
        .select(
            *pr,
            "merged_at",
            F.concat(F.col("repo"), F.lit("#"), F.col("pr_number").cast("string"), F.lit("/review_"), F.col("comment_id").cast("string")).alias("thread_id"),
            "path",
            F.col("body").alias("review_signal"),
            F.coalesce("diff_hunk", F.lit("")).alias("before_context"),
            F.coalesce("patch", F.lit("")).alias("accepted_change"),
            start.alias("line_start"),
            end.alias("line_end"),
        )
    )


def classify_threads(threads: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Kind, path cluster and confidence by rules, or from a label table where it has a row.

    ``labels``: ``thread_id, thread_kind, path_cluster, confidence`` from a model run. With labels
    the rules are the fallback (confidence 0.3), without them the method (0.5).
    """
    path, signal = F.coalesce("path", F.lit("")), F.lower(F.coalesce("review_signal", F.lit("")))
    has = lambda t, *words: _any([F.contains(t, F.lit(w)) for w in words])
    words = F.size(F.filter(F.split(signal, r"(?U)\s+"), lambda w: w != ""))
    cluster = (
        F.when(has(path, "test") | path.endswith("_test.py"), "tests")
        .when(has(path, "docs") | path.endswith(".md"), "docs")
        .when(has(path, "model"), "models")
        .when(has(path, "integration"), "integrations")
        .otherwise("general")
    )
    kind = (
        F.when(has(signal, "suggestion"), "suggestion_block")
        .when(has(signal, "rename", "format", "import"), "mechanical_followup")
        .when(has(signal, "?") | (words > 30), "discussion_resolution")
        .otherwise("code_owner_review")
    )
    if labels is None:
        return threads.withColumns({"thread_kind": kind, "path_cluster": cluster, "confidence": F.lit(0.5)})
    lab = labels.select(
        "thread_id", F.lit(True).alias("__l"), F.col("thread_kind").alias("__k"), F.col("path_cluster").alias("__c"), F.col("confidence").alias("__p")
    )
    joined = threads.join(lab, "thread_id", "left")
    given = F.col("__l").isNotNull()
    return joined.withColumns(
        {
            "thread_kind": F.when(given, F.coalesce("__k", F.lit("unknown"))).otherwise(kind),
            "path_cluster": F.when(given, F.coalesce("__c", F.lit("general"))).otherwise(cluster),
            "confidence": F.when(given, F.coalesce("__p", F.lit(0.5))).otherwise(F.lit(0.3)),
        }
    ).drop("__l", "__k", "__c", "__p")


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


# Words that mark a thread as private or social.
PRIVATE_WORDS = ["ci passed", "benchmark result", "internal", "private"]
SOCIAL_WORDS = ["thanks", "thank you", "great job", "lgtm", "nice work"]


def thread_drop_reason(threads: DataFrame) -> DataFrame:
    """Add ``drop_reason``; null means the thread is kept."""
    signal = F.coalesce("review_signal", F.lit(""))
    patch = F.coalesce("accepted_change", F.lit(""))
    low = F.lower(signal)
    newlines = F.length(patch) - F.length(F.replace(patch, F.lit("\n"), F.lit("")))
    reason = (
        F.when(_any([F.contains(low, F.lit(w)) for w in PRIVATE_WORDS]), "private_or_ci")
        .when(_any([F.contains(low, F.lit(w)) for w in SOCIAL_WORDS]), "social")
        .when(F.length(strip(signal)) < 10, "short")
        .when(newlines > 200, "patch_too_large")
        .when(F.length(strip(patch)) == 0, "no_patch")
    )
    return threads.withColumn("drop_reason", reason)


def keep_threads(threads: DataFrame) -> DataFrame:
    return thread_drop_reason(threads).filter(F.col("drop_reason").isNull()).drop("drop_reason")


def temporal_examples(threads: DataFrame, *, cutoff: str, source: str = "code_review", prefix: str = "code", min_threads: int = 3) -> DataFrame:
    """I4: examples of ``(repo, cluster)`` packs; merged before ``cutoff`` is train, else heldout.

    Group sizes are counted and joined back, so a large group is never one window partition.
    ``merged_at`` is compared as text (ISO), rows without it go to ``undated_threads``.
    """
    dated = threads.filter(F.col("merged_at").isNotNull())
    sizes = dated.groupBy("repo", "path_cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= min_threads)
    kept = dated.join(sizes.select("repo", "path_cluster"), ["repo", "path_cluster"], "left_semi")
    train = F.col("merged_at") < F.lit(cutoff)
    role = F.when(train, "train").otherwise("heldout")
    safe = F.replace(F.col("repo"), F.lit("/"), F.lit("_"))
    return kept.select(
        F.concat_ws("_", F.lit(prefix), safe, F.col("path_cluster")).alias("pack_id"),
        F.concat_ws("::", safe, role, F.col("thread_id")).alias("example_id"),
        role.alias("role"),
        F.lit(source).alias("source"),
        F.concat(F.col("repo"), F.lit("#"), F.col("pr_number").cast("string")).alias("source_task_id"),
        F.concat(
            F.lit("Repository: "), F.col("repo"), F.lit("\nFile: "), F.col("path"), F.lit("\nReview Comment:\n"), F.col("review_signal"),
            F.lit("\n\nOriginal Code Context:\n"), F.col("before_context"), F.lit("\n"),
        ).alias("task_input"),
        F.when(train, "extracted").alias("output_status"),
        F.when(train, F.col("accepted_change")).alias("output"),
        F.when(train, F.substring(F.sha2("accepted_change", 256), 1, 16)).alias("patch_sha256"),
    )


def undated_threads(threads: DataFrame) -> DataFrame:
    """I4: threads without a merge time, which no cutoff can place."""
    return violation(threads.filter(F.col("merged_at").isNull()), "I4_no_merged_at", "thread_id")


def temporal_audit(examples: DataFrame) -> DataFrame:
    """Per pack, train and heldout rows, heldout rows without output, distinct patches."""
    train = F.col("role") == "train"
    per_patch = examples.groupBy("pack_id", "patch_sha256").agg(
        count_where(train).alias("t"), count_where(~train).alias("h"), count_where(~train & F.col("output").isNull()).alias("hn")
    )
    return per_patch.groupBy("pack_id").agg(
        F.sum("t").alias("train"), F.sum("h").alias("heldout"), F.sum("hn").alias("heldout_null"),
        F.count("patch_sha256").alias("distinct_patches"),
    )
