"""Per-document text operators.

All of them are row-local expressions over whole texts: lines, matches and pages stay inside the
row until the final explode, so none of these operators shuffles documents but E7, which joins a
text once to its candidates.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.byte_windows import WindowFilter, literal_windows
from evalweave.functions.expr import col, dedupe_casefold, has_text, id_part, let, strip
from evalweave.functions.patterns import CJK, EVIDENCE_PATTERNS, literals
from evalweave.functions.session import checkpoint_dir

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

# -- E2: private keys in nested JSON ------------------------------------------------------------

# Keys that only private rows may carry.
PRIVATE_KEYS = ["supervision", "judge", "statistics"]
PRIVATE_PREFIX = "private_"


# Tokens of a JSON text that decide where a value stands: strings, brackets, commas.
_TOKEN = r'"(?:[^"\\]++|\\.)*+"|[\[{\]},]'


def _paths(text: Column, private: Callable[[Column], Column]) -> Column:
    """Paths of the private keys of a valid JSON text, by one fold over its tokens.

    The fold keeps the open objects and arrays with the path of the member or item it stands at, so
    neither the plan nor the number of passes depends on how deep the text is nested.
    """
    tokens = F.regexp_extract_all(text, F.lit(f"(?s){_TOKEN}"), F.lit(0))
    level = "struct<array:boolean,at:int,path:string,here:string>"
    start = F.struct(
        F.array().cast(f"array<{level}>").alias("open"),
        F.lit(False).alias("key"),  # whether a string would be a member's name
        F.array().cast("array<string>").alias("found"),
    )

    def step(acc: Column, token: Column) -> Column:
        depth = F.size(acc["open"])
        top = F.when(depth > 0, F.element_at(acc["open"], F.greatest(depth, F.lit(1))))
        below = F.slice(acc["open"], 1, F.greatest(depth - 1, F.lit(0)))
        item = lambda path, at: F.concat(path, F.lit("["), at.cast("string"), F.lit("]"))

        def opened(array: bool) -> Column:
            path = F.coalesce(top["here"], F.lit("$"))
            new = F.struct(
                F.lit(array).alias("array"), F.lit(0).alias("at"), path.alias("path"),
                (item(path, F.lit(0)) if array else path).alias("here"),
            )
            return F.struct(F.concat(acc["open"], F.array(new)).alias("open"), F.lit(not array).alias("key"), acc["found"].alias("found"))

        after = F.struct(
            top["array"].alias("array"), (top["at"] + 1).alias("at"), top["path"].alias("path"),
            F.when(top["array"], item(top["path"], top["at"] + 1)).otherwise(top["path"]).alias("here"),
        )
        comma = F.struct(F.concat(below, F.array(after)).alias("open"), (~top["array"]).alias("key"), acc["found"].alias("found"))
        closed = F.struct(below.alias("open"), F.lit(False).alias("key"), acc["found"].alias("found"))

        def named(name: Column) -> Column:
            path = F.concat(top["path"], F.lit("."), name)
            member = F.struct(top["array"].alias("array"), top["at"].alias("at"), top["path"].alias("path"), path.alias("here"))
            found = F.when(private(name), F.concat(acc["found"], F.array(path))).otherwise(acc["found"])
            return F.struct(F.concat(below, F.array(member)).alias("open"), F.lit(False).alias("key"), found.alias("found"))

        name = F.try_variant_get(F.try_parse_json(token), "$", "string")
        return (
            F.when(token == "{", opened(False))
            .when(token == "[", opened(True))
            .when(token.isin("}", "]"), closed)
            .when(token == ",", comma)
            .when(acc["key"], let(name, named))
            .otherwise(acc)
        )

    return F.aggregate(tokens, start, step, lambda acc: acc["found"])


def private_key_paths(
    df: DataFrame,
    payload: str,
    keys: Sequence[str],
    *,
    private_keys: Sequence[str] = PRIVATE_KEYS,
    prefix: str = PRIVATE_PREFIX,
) -> DataFrame:
    """One row per private key found in the JSON text ``payload``, with its path, at any depth.

    Only texts that could hold such a key, plainly or behind an escape, are read token by token.
    """
    text = col(payload)
    plain = [F.contains(text, F.lit(f'"{k}"')) for k in private_keys] + [F.contains(text, F.lit(f'"{prefix}'))]
    suspect = reduce(or_, [*plain, F.contains(text, F.lit("\\u"))])
    valid = df.filter(suspect & F.try_parse_json(text).isNotNull())
    bad = lambda name: name.isin(*private_keys) | F.startswith(name, F.lit(prefix))
    return valid.select(*keys, F.explode(_paths(text, bad)).alias("path"))


# -- E7: literals ------------------------------------------------------------------------------

def train_literals(examples: DataFrame, *, by: Sequence[str] = ("pack_id",)) -> DataFrame:
    """Distinct literals per pack, from inputs, outputs, ids and material paths.

    ``examples``: ``example_id, source_task_id, task_input, output, material_paths array``.
    """
    ids = F.array_compact(F.array(F.col("example_id"), F.col("source_task_id")))
    found = F.concat(
        literals(F.col("task_input")),
        literals(F.col("output")),
        ids,
        F.coalesce(F.col("material_paths"), F.array().cast("array<string>")),
    )
    out = examples.select(*by, F.explode(F.array_distinct(found)).alias("literal"))
    return out.filter(F.length("literal") >= 3).distinct()


def _keyed_literals(train: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct literals with the number of their rows (``copies``) and the window that keys them.

    That is the window which fewest literals of its pack hold, so that a common beginning such as a scheme
    or an id prefix keys none of them; literals under three bytes have none. Written to the shared folder,
    for the filter of the keys is built before the texts are scanned.
    """
    spark = train.sparkSession
    literals = train.groupBy(*by, "literal").agg(F.count("*").alias("copies"))
    held = literal_windows(literals, "literal", by)
    spread = held.groupBy(*by, "key").agg(F.count("*").alias("n"))
    rarest = held.join(spread, [*by, "key"]).groupBy(*by, "literal").agg(F.min(F.struct("n", "key"))["key"].alias("key"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/literals-{uuid.uuid4().hex}"
    literals.join(rarest, [*by, "literal"], "left").select(*by, "literal", "copies", "key").write.parquet(path)
    return spark.read.parquet(path)


def literal_matches(
    texts: DataFrame,
    train: DataFrame,
    *,
    text: str = "haystack",
    keys: Sequence[str],
    by: Sequence[str] = ("pack_id",),
) -> DataFrame:
    """Literals of the same pack that occur in a text as substrings.

    Comparing every literal with every text of a pack would emit all pairs of a hot pack. Instead
    each literal is keyed by one of its byte windows (3, 4 or 6 long, by its length). A Bloom filter of
    these keys, as large as their number asks for, is broadcast to the scan of the texts, so only
    windows that it holds become rows. They travel without the text; texts are joined once, by
    ``keys``, to the candidates that are left, and ``contains`` decides.
    """
    return _matches(texts, _keyed_literals(train, by), text=text, keys=keys, by=by)


def _matches(texts: DataFrame, literals: DataFrame, *, text: str, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    wide = [*dict.fromkeys([*keys, *by])]
    heads = literals.filter(F.col("key").isNotNull()).select(*by, "literal", "key")
    windows = WindowFilter(heads, by).windows(texts, text, wide, by)
    hits = windows.join(heads, [*by, "key"]).select(*wide, "literal").distinct().alias("h")
    bodies = texts.select(*wide, F.col(text).alias("__text")).alias("t")
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"h.{k}")) for k in wide]
    joined = bodies.join(hits, reduce(and_, [*same, F.contains("t.__text", "h.literal")]))
    return joined.select(*[F.col(f"h.{k}") for k in wide], "literal")


def literal_leakage(
    texts: DataFrame,
    train: DataFrame,
    *,
    text: str = "haystack",
    keys: Sequence[str],
    by: Sequence[str] = ("pack_id",),
    show: int | None = None,
) -> DataFrame:
    """E7 report per text: candidate and match counts, the matches in order, a flag.

    ``show`` shortens the list to its first entries; the count covers all matches.
    """
    wide = [*dict.fromkeys([*keys, *by])]
    literals = _keyed_literals(train, by)
    hits = _matches(texts, literals, text=text, keys=keys, by=by)
    listed = F.array_sort(F.collect_set("literal"))
    per_text = hits.groupBy(*wide).agg(
        F.count("*").alias("matched_literal_count"),
        (listed if show is None else F.slice(listed, 1, show)).alias("matched_literals"),
    )
    per_pack = literals.groupBy(*by).agg(F.sum("copies").alias("candidate_literal_count"))
    out = texts.select(*wide).join(per_text, wide, "left").join(per_pack, list(by), "left")
    return out.select(
        *wide,
        F.coalesce("candidate_literal_count", F.lit(0)).alias("candidate_literal_count"),
        F.coalesce("matched_literal_count", F.lit(0)).alias("matched_literal_count"),
        F.coalesce("matched_literals", F.array().cast("array<string>")).alias("matched_literals"),
        F.col("matched_literal_count").isNotNull().alias("has_literal_leakage"),
    )


# -- E8: evidence inventory ---------------------------------------------------------------------


def evidence_inventory(
    tasks: DataFrame, *, keys: Sequence[str], text: str = "text", max_items: int | None = None, max_text_chars: int | None = None
) -> DataFrame:
    """Concrete facts per task as ``(kind, rank, value)``, first spelling kept, in order.

    The whole text is read unless the caller gives ``max_text_chars``; ``max_items`` bounds
    the length of each list, which is full without it.
    """
    body = F.coalesce(col(text), F.lit(""))
    if max_text_chars is not None:
        body = F.substring(body, 1, max_text_chars)

    def values(kind: str) -> Column:
        pattern, group = EVIDENCE_PATTERNS[kind]
        found = F.regexp_extract_all(body, F.lit("(?Ud)" + pattern), F.lit(group))
        if kind != "number":
            found = F.transform(found, strip)
        if kind == "capitalised":
            found = F.filter(found, lambda m: F.length(m) > 1)
        if kind == "cjk":
            found = F.filter(found, lambda m: m.rlike(CJK))
        return dedupe_casefold(found, max_items)

    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), values(k).alias("values")) for k in EVIDENCE_PATTERNS]
    )
    lists = tasks.select(*keys, F.explode(kinds).alias("k"))
    return lists.select(*keys, F.col("k.kind").alias("kind"), F.posexplode("k.values").alias("rank", "value")).withColumn(
        "rank", F.col("rank") + 1
    )


# -- E9, E11 ------------------------------------------------------------------------------------


def text_stats(text: str | Column) -> Column:
    """sha256, characters, words and CJK characters as a struct; null for a null text."""
    t = col(text)
    words = F.filter(F.split(t, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    return F.when(
        t.isNotNull(),
        F.struct(
            F.sha2(t, 256).alias("sha256"),
            F.length(t).cast("long").alias("chars"),
            F.size(words).cast("long").alias("words"),
            (F.length(t) - F.length(F.regexp_replace(t, CJK, ""))).cast("long").alias("cjk_chars"),
        ),
    )


def truncate_preview(text: str | Column, max_chars: int) -> Column:
    """Cut text with a short marker; a limit of 0 keeps everything."""
    t = col(text)
    if max_chars <= 0:
        return t
    return F.when(F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit("\n...[truncated]"))).otherwise(t)


def truncate_evidence(text: str | Column, max_chars: int) -> Column:
    """Cut text with a marker that names the limit, which must be positive."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    t = col(text)
    marker = F.lit(f"\n\n[TRUNCATED after {max_chars} chars]")
    return F.when(F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), marker)).otherwise(t)


REASONING_END = "</think>\n\n"  # fixed value: the marker behind a reasoning trace


def strip_reasoning(text: str | Column) -> Column:
    """What follows the first reasoning marker, or the whole text."""
    t = col(text)
    at = F.instr(t, REASONING_END)
    return F.when(at > 0, F.substring(t, at + len(REASONING_END), F.length(t))).otherwise(t)


# -- E10: list rules under Markdown sections ------------------------------------------------------

SECTIONS = ["required_rules", "optional_rules", "do_not_generalize_rules"]
_RULE_LINE = r"^(?:[-*+]|\p{Nd}+[.)])\s+"


def _section_of(heading: Column) -> Column:
    title = F.lower(strip(F.regexp_replace(strip(F.regexp_replace(heading, r"^#+\s*", "")), r"[:：]+$", "")))
    has = lambda w: F.contains(title, F.lit(w))
    return (
        F.when(has("required") & has("rule"), SECTIONS[0])
        .when(has("optional") & has("rule"), SECTIONS[1])
        .when(has("do not generalize") | has("do-not-generalize"), SECTIONS[2])
        .otherwise("none")
    )


def section_rule_counts(markdown: str | Column) -> Column:
    """Number of list lines under each rule section, as a struct.

    A fold over the lines carries the current section; no line leaves its row.
    """
    text = F.coalesce(col(markdown), F.lit(""))
    lines = F.filter(
        F.transform(F.split(text, LINE_BREAK), lambda x: F.rtrim(x)),
        lambda x: x.rlike(r"^(?:#{1,6}\s|\s*[-*+\p{Nd}])"),
    )
    start = F.struct(
        F.lit("none").alias("section"), *[F.lit(0).cast("long").alias(s) for s in SECTIONS]
    )

    def step(acc: Column, line: Column) -> Column:
        heading = line.rlike(r"^#{1,6}\s+")
        rule = ~heading & strip(line).rlike(_RULE_LINE)
        return F.struct(
            F.when(heading, _section_of(line)).otherwise(acc["section"]).alias("section"),
            *[
                (acc[s] + F.when(rule & (acc["section"] == s), F.lit(1)).otherwise(F.lit(0)).cast("long")).alias(s)
                for s in SECTIONS
            ],
        )

    return F.aggregate(lines, start, step, lambda acc: F.struct(*[acc[s].alias(s) for s in SECTIONS]))


# -- E13: pages ----------------------------------------------------------------------------------

PAGE_HEADING = r"(?i)^\s*(?:#{1,3}\s*)?Slide\s+\p{Nd}+\s*[:.-]?\s*(.*)$"
_PAGE_MARK = "\x1d"


def _plain(line: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(line, r"[*_`]+", ""), r"\s+", " "))


def page_texts(text: str | Column) -> Column:
    """Pages of a text, cut before every ``Slide N`` heading but the first line.

    Lines are joined with a page mark in front of headings and split at the mark again, so the
    work is linear in the length of the text.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), LINE_BREAK), strip), lambda x: x != "")
    marked = F.transform(
        lines,
        lambda x, i: F.when((i > 0) & x.rlike(PAGE_HEADING), F.concat(F.lit(_PAGE_MARK), _plain(x))).otherwise(_plain(x)),
    )
    return F.split(F.array_join(marked, "\n"), "\n?" + _PAGE_MARK)


def export_pages(
    rows: DataFrame, tasks: DataFrame, *, modes: Sequence[str], text: str = "text", max_pages: int | None = None
) -> DataFrame:
    """Success rows with text, a listed mode and a known task, as one row per page.

    ``max_pages`` is the page limit of the target document, when it has one.
    """
    kept = rows.filter((F.col("status") == "success") & F.col("mode").isin(*modes) & has_text(text))
    known = tasks.select(id_part("pack_id").alias("pack_id"), id_part("task_id").alias("task_id")).distinct()
    joined = kept.join(known, ["pack_id", "task_id"], "left_semi")
    pages = page_texts(text)
    if max_pages is not None:
        pages = F.slice(pages, 1, max_pages)
    return joined.select("seq", "pack_id", "task_id", "mode", F.posexplode(pages).alias("page", "page_text")).withColumn(
        "page", F.col("page") + 1
    )
