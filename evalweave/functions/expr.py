"""Small column expressions shared by the operators.

Every helper takes and returns a Column, so it stays inside the JVM plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that counts when text is stripped, as Unicode has it.
BLANKS = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_list(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def id_part(c: str | Column) -> Column:
    """A key part as text; a missing one becomes the empty string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def label(c: str | Column, default: str = "unknown") -> Column:
    """A label as text; null and the empty string become ``default``."""
    text = col(c).cast("string")
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(text)


def strip(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def has_text(c: str | Column) -> Column:
    """True where the text is present and not blank (never null)."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def is_finite(c: str | Column) -> Column:
    """True for a finite number, false for null, NaN and infinities."""
    value = col(c)
    return F.coalesce(
        ~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), F.lit(False)
    )


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as double, null on a zero or null denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def slug(c: str | Column) -> Column:
    """File-name-safe key: other runs to ``_``, collapsed, trimmed, never empty."""
    text = F.regexp_replace(strip(c), r"[^A-Za-z0-9._-]+", "_")
    text = F.btrim(F.regexp_replace(text, r"_+", "_"), F.lit("_"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("item")).otherwise(text)


def count_where(cond: Column) -> Column:
    """Number of rows where ``cond`` holds; 0, not null, on an empty group."""
    return F.count(F.when(cond, F.lit(1)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Inside a lambda an outer expression is evaluated again for every element; bound as a lambda
    variable it is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def dedupe_casefold(values: Column, limit: int | None = None) -> Column:
    """The first distinct strings by lower case, keeping the first spelling and the order."""

    def pick(pair: Column) -> Column:
        kept = F.array_distinct(pair["folded"])
        if limit is not None:
            kept = F.slice(kept, 1, limit)
        return F.transform(
            kept,
            lambda v: F.element_at(pair["values"], F.array_position(pair["folded"], v).cast("int")),
        )

    def fold(kept: Column) -> Column:
        return let(
            F.struct(kept.alias("values"), F.transform(kept, lambda v: F.lower(v)).alias("folded")), pick
        )

    return let(F.filter(values, lambda v: F.length(v) > 0), fold)


def sorted_join(values: Column, sep: str = ",") -> Column:
    return F.array_join(F.array_sort(values), sep)
