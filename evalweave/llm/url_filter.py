"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for the rest.

The trees are Spark ML's, trained from labelled urls. All features are column expressions.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.scratch import documents, written

LEXICAL = ["url_length", "host_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "secure", "fragment"]
SUFFIX = ["suffix_pages", "suffix_labelled", "suffix_blocked"]
# Weight of the overall rate in a suffix's rate of blocked urls.
PRIOR_ROWS = 20
# Labelled urls are dealt into folds; the trees see suffix rates from the other folds only.
FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(url, pattern, 2)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule string and action of the longest fitting rule ``(action, host, path)``, or nulls.

    A rule fits its host and all subdomains where the path starts with its path. Of two rules of one
    length the one with the longer host wins.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, at, below in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(below)
        rule, action = F.when(fits, F.lit(at + below)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(action)
    return rule, action


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)
    share = lambda c: F.regexp_count(text, F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))) / size
    signs = F.array_distinct(F.split(text, ""))
    return F.aggregate(F.filter(signs, lambda c: (c != "")), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def lexical_features(urls: DataFrame, url: str) -> DataFrame:
    """Adds ``host``, ``path``, ``suffix`` (last three host labels) and the lexical features."""
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = host_and_path(F.col(url))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    out = urls.withColumns({"host": host, "path": path})
    return out.withColumns(
        {
            "suffix": F.regexp_extract("host", r"([^.]*(?:\.[^.]*){0,2})$", 1),
            "url_length": F.length(text).cast("double"),
            "host_length": F.length("host").cast("double"),
            "labels": count(F.col("host"), r"\.") + 1,
            "depth": count(F.col("path"), "/"),
            "digit_ratio": F.when(F.length(text) > 0, count(text, "[0-9]") / F.length(text)).otherwise(0.0),
            "entropy": _entropy(text),
            "parameters": count(F.regexp_extract(text, r"\?([^#]*)", 1), "="),
            "hyphens": count(F.col("host"), "-"),
            "secure": F.startswith(F.lower(text), F.lit("https:")).cast("double"),
            "fragment": F.contains(text, F.lit("#")).cast("double"),
        }
    )


def _rate(blocks: Column, n: Column, overall: float) -> Column:
    return (F.coalesce(blocks, F.lit(0.0)) + PRIOR_ROWS * overall) / (F.coalesce(n, F.lit(0)) + PRIOR_ROWS)


def out_of_fold(rows: DataFrame, known: DataFrame, overall: float) -> DataFrame:
    """``rows`` of ``known`` with ``suffix_labelled`` and ``suffix_blocked`` counted without their own fold.

    A rate that counts a row's own label would tell the trees that label.
    """
    sums = known.groupBy("suffix", "fold").agg(F.count("*").alias("fold_n"), F.sum("label").alias("fold_blocks"))
    every = sums.groupBy("suffix").agg(F.sum("fold_n").alias("all_n"), F.sum("fold_blocks").alias("all_blocks"))
    n, blocks = F.col("all_n") - F.col("fold_n"), F.col("all_blocks") - F.col("fold_blocks")
    rates = sums.join(every, "suffix").select("suffix", "fold", F.log1p(n).alias("suffix_labelled"), _rate(blocks, n, overall).alias("suffix_blocked"))
    return rows.join(rates, ["suffix", "fold"])


def filter_urls(
    urls: DataFrame,
    labelled: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    *,
    url: str = "url",
    blocked: str = "blocked",
    max_training_rows: int = 20_000,
    trees: int = 10,
    depth: int = 4,
) -> DataFrame:
    """``urls`` with ``host, path, rule, verdict, score``.

    ``labelled`` has urls and a 0/1 column ``blocked``. Suffix statistics count all urls and all
    labelled urls, for the rows that the trees learn from those of the other folds. The trees are fitted
    on the ``max_training_rows`` labelled urls of the smallest url hash, a bounded sample. ``score`` is the trees' probability of a block, and the verdict where
    no rule fits: block from 0.5. Without both labels the score is the overall rate of blocks, 0 where
    nothing is labelled.

    A null url, or one without ``://``, has an empty host and path and is scored like any other.
    Repeated rows get equal verdicts; a very long url is one row of one task. Without urls the result is
    empty. Columns of ``urls`` with the names of results are replaced.
    """
    known = lexical_features(labelled.where(F.col(blocked).isNotNull()).select(url, F.col(blocked).cast("double").alias("label")), url)
    known = written(known.withColumn("fold", F.pmod(F.xxhash64(F.lit(FOLDS), F.col(url)), F.lit(FOLDS))), "labelled-urls")
    overall = known.agg(F.count("*").alias("n"), F.coalesce(F.avg("label"), F.lit(0.0)).alias("rate")).first()
    names = ["host", "path", "rule", "verdict", "score"]
    base = urls.drop(*[c for c in names if c in urls.columns])
    inner = lexical_features(base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("__row"), F.col(url).alias("__url")), "__url")
    rates = known.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("blocks"))
    stats = (
        inner.groupBy("suffix")
        .agg(F.count("*").alias("pages"))
        .join(rates, "suffix", "full")
        .select(
            "suffix",
            F.log1p(F.coalesce("pages", F.lit(0))).alias("suffix_pages"),
            F.log1p(F.coalesce("n", F.lit(0))).alias("suffix_labelled"),
            _rate(F.col("blocks"), F.col("n"), overall.rate).alias("suffix_blocked"),
        )
    )
    stats = written(stats, "suffixes")
    assemble = VectorAssembler(inputCols=LEXICAL + SUFFIX, outputCol="features")
    scored = inner.join(stats, "suffix")
    if 0 < overall.rate < 1:
        sample = known.orderBy(F.xxhash64(url), url, "label").limit(max_training_rows)
        sample = out_of_fold(sample, known, overall.rate).join(stats.select("suffix", "suffix_pages"), "suffix")
        training = written(assemble.transform(sample.select(*LEXICAL, *SUFFIX, "label")).select("features", "label"), "url-training")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, cacheNodeIds=False).fit(training)
        scored = model.transform(assemble.transform(scored)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = scored.withColumn("score", F.lit(float(overall.rate)))
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("__row.*", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")


# The rules of the registered query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op8_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's url ends in the number of its document, whose quality label labels the url."""
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    labels = documents(spark, sf_dir, "labels")
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^?#]*/(\d{1,18})", 1)
    numbered = pages.withColumn("doc_id", F.when(number != "", number.cast("long"))).where("doc_id IS NOT NULL")
    labelled = numbered.join(labels, "doc_id").select("url", (1 - F.col("quality")).alias("blocked"))
    return filter_urls(pages, labelled, RULES).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op8_url_trees": op8_url_trees}
ORACLE: dict[str, str] = {}
