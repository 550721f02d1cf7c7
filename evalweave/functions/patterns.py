"""Regular expressions and word lists, and the expressions that apply them.

Python's ``\\d``, ``\\s`` and ``\\b`` know Unicode, so patterns use ``\\p{Nd}`` for digits and rely on
the Unicode-aware default word boundary of Java 17.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that must not reach user-visible text.
PRIVATE_LEAK_PATTERNS = [
    r"\bbenchmark training example\b",
    r"\bprivate supervision\b",
    r"\bconstruction prompt\b",
    r"\bbenchmark rubric\b",
    r"\bjudge metadata\b",
    r"\brubric criteria\b",
    r"\bhidden rubric\b",
    r"\bhidden checklist\b",
    r"\bgrading criteria\b",
    r"\b(private|benchmark|grading)\s+(rubric|checklist|criteria)\b",
    r"\b(rubric|checklist|criteria)\s+(private|benchmark|grading)\b",
    r"\bchecklist groups\b",
    r"\bteacher critique\b",
    r"\bheldout feedback\b",
    r"\bevaluation metadata\b",
    r"benchmark\s*评分标准",
    r"隐藏.*评分标准",
    r"内部.*评分标准",
    r"评审提示",
    r"隐藏.*(rubric|评分|标准|checklist|检查)",
    r"BAILIAN_API_KEY",
    r"OPENAI_API_KEY",
]

# Every match of the patterns above holds, in lower case, one of these; the last four are
# signs that equal i, k or s where case is ignored.
LEAK_PARTS = [
    "benchmark training example", "private supervision", "construction prompt", "judge metadata", "rubric",
    "checklist", "criteria", "teacher critique", "heldout feedback", "evaluation metadata", "评分标准", "评审提示",
    "隐藏", "_api_key", "\u0130", "\u0131", "\u017f", "\u212a",
]

# Token pattern and stop words of the phrase overlap report.
TOKEN_PATTERN = r"[A-Za-z][A-Za-z0-9_+-]*|\p{Nd}+(?:\.\p{Nd}+)?|[一-鿿]"
STOPWORDS = [
    "a", "an", "and", "are", "as", "be", "by", "for", "from", "in",
    "is", "it", "of", "on", "or", "that", "the", "this", "to", "with",
]

# At least three capitalised words in a row. Java takes a stack frame per word for the plain pattern, so runs
# of three or more words between white space or colons, however long, go by possessive repeats, which need
# none: words up to the last one that ends at a word border behind its first letter, to that one's last such
# border. Where three words only count if cut at hyphens, the plain pattern stays; it spans two such words.
_CORE = r"[A-Z][&.-]*+[A-Za-z0-9]++\b(?:[&.-]++[A-Za-z0-9]++\b)*+"
_BARE = r"(?:[A-Z][&.-]++(?:\s++|:))*+"
_NEXT = r"[&.-]*+(?:\s++|:)" + _BARE
_NAMES = (
    r"\b(?:(?:[A-Z][A-Za-z0-9&.-]++(?:\s++|:)){2}" + _BARE
    + rf"(?:{_CORE}(?:{_NEXT}{_CORE})*+(?:{_NEXT}[A-Z][&.-]++\b|[&.-]++\b)?+|[A-Z][&.-]++\b)"
    + r"|(?:[A-Z][A-Za-z0-9&.-]+(?:\s+|[-:])){2,60}[A-Z][A-Za-z0-9&.-]+\b)"
)

# Literals that identify one particular sample, and the characters cut off around them.
LITERAL_PATTERNS = [
    r"\b\p{Nd}{4}[-/年]\p{Nd}{1,2}(?:[-/月]\p{Nd}{1,2}日?)?\b",
    r"\b\p{Nd}{1,2}[-/]\p{Nd}{1,2}[-/]\p{Nd}{2,4}\b",
    r"\b\p{Nd}+(?:\.\p{Nd}+)?%\b",
    r"\b\p{Nd}+(?:\.\p{Nd}+)?(?:-\p{Nd}+(?:\.\p{Nd}+)?){1,4}\b",
    r"\b\p{Nd}+(?:\.\p{Nd}+)?\s*(?:元|万元|亿元|USD|RMB|dollars?|slides?|pages?)\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"https?://[^\s)]+",
    r"(?:^|[\s\"'`])(?:data|artifacts|runs|notes|docs|src|scripts|/Users)/[^\s\"'`)]+",
    _NAMES,
    r"(?<![一-鿿A-Za-z0-9])[一-鿿A-Za-z0-9]+(?:报告|论文|白皮书|合同|招标书|演示文稿|讲义|教材|章节|公司|大学|学院)",
]
LITERAL_TRIM = " \t\n\"'`.,;:()[]{}"

# Kinds of concrete evidence in a task, with the pattern's capture group.
EVIDENCE_PATTERNS = {
    "number": (r"\b\p{Nd}+(?:[.,:/-]\p{Nd}+)*(?:%|[A-Za-z]+)?\b", 0),
    "quoted": (r"[\"'“”‘’《》](.*?)[\"'“”‘’《》]", 1),
    "capitalised": (r"\b(?:[A-Z][A-Za-z0-9&+.-]*)(?:\s+[A-Z][A-Za-z0-9&+.-]*){0,5}\b", 0),
    "cjk": (r"[一-鿿A-Za-z0-9·-]{2,20}", 0),
}
CJK = r"[一-鿿]"


# Letter case, classes such as ``\\s`` and line ends (only the line feed) as Unicode text needs them.
UNICODE = "(?iUd)"


def pattern_hits(text: Column, patterns: Sequence[str] = PRIVATE_LEAK_PATTERNS) -> Column:
    """The patterns found in ``text``, in list order, case-insensitive.

    A plain search for what every match holds goes over the text first (for other lists than the
    fixed one, one alternation); only texts that pass pay for the single patterns.
    """
    text = F.coalesce(text, F.lit(""))
    each = F.array_compact(
        F.array(*[F.when(text.rlike(UNICODE + p), F.lit(p)) for p in patterns])
    )
    if set(patterns) <= set(PRIVATE_LEAK_PATTERNS):
        any_hit = reduce(or_, [F.contains(F.lower(text), F.lit(part)) | F.contains(text, F.lit(part)) for part in LEAK_PARTS])
    else:
        any_hit = text.rlike(UNICODE + "|".join(f"(?:{p})" for p in patterns))
    return F.when(any_hit, each).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Lower-case tokens in reading order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.transform(found, F.lower)


def _gram_pattern(n: int) -> str:
    """Over tokens joined by one space: every n-gram as group 1, but those of stop words only."""
    stop = "(?:" + "|".join(STOPWORDS) + ")"
    follows = "{" + str(n - 1) + "}"
    return rf"(?:^| )(?!{stop}(?: {stop}){follows}(?: |$))(?=(\S+(?: \S+){follows})(?: |$))"


def content_grams(toks: Column, n: int) -> Column:
    """n-grams with a content word, in order, joined by one space; repeats are kept.

    One look-ahead pattern over the joined tokens yields all overlapping n-grams in one pass,
    without a lambda per token.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    return F.regexp_extract_all(F.array_join(toks, " "), F.lit(_gram_pattern(n)), F.lit(1))


def text_content_grams(text: Column, n: int) -> Column:
    """``content_grams`` straight from a text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))
    if n <= 0:
        raise ValueError("n must be positive")
    return F.regexp_extract_all(F.lower(F.array_join(found, " ")), F.lit(_gram_pattern(n)), F.lit(1))


def literals(text: Column) -> Column:
    """Distinct sample-specific literals of at least three characters."""
    text = F.coalesce(text, F.lit(""))
    found = F.flatten(
        F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in LITERAL_PATTERNS])
    )
    cut = F.transform(found, lambda m: F.btrim(m, F.lit(LITERAL_TRIM)))
    return F.array_distinct(F.filter(cut, lambda m: F.length(m) >= 3))
