"""Two-level prefix scans, so that one large group is never sorted in one task.

A plain ``row_number() over (partition by g order by k)`` sends a whole group to one task. Here
every group is cut into blocks of consecutive order keys. The scan runs inside the blocks, the
block totals (one row per block) are scanned in their turn, and an equi-join adds the offset.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


def blocked_scan(
    df: DataFrame,
    group: Sequence[str],
    pos: str,
    value: Column,
    out: str,
    *,
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the earlier rows of the group (exclusive)."""
    return blocked_scans(df, group, pos, {out: value}, block=block)


def blocked_scans(
    df: DataFrame, group: Sequence[str], pos: str, values: Mapping[str, Column], *, block: int = DEFAULT_BLOCK
) -> DataFrame:
    """Add, per name of ``values``, the sum of its column over the earlier rows of the group (exclusive).

    ``pos`` is an integer that is unique within the group; it may have gaps. ``block`` is the
    width of a block in units of ``pos``, which bounds the rows of a block. A group whose
    positions span N blocks sends N small rows to the second scan.
    """
    blk = "__blk"
    val = {out: f"__val_{i}" for i, out in enumerate(values)}
    zero = lambda c: F.coalesce(c, F.lit(0))
    keyed = df.withColumn(blk, F.floor(F.col(pos) / F.lit(block)).cast("long")).withColumns(
        {val[out]: zero(value).cast("long") for out, value in values.items()}
    )
    before = (W.unboundedPreceding, -1)
    in_block = W.partitionBy(*group, blk).orderBy(pos).rowsBetween(*before)
    totals = keyed.groupBy(*group, blk).agg(*[F.sum(v).alias(v) for v in val.values()])
    across = W.partitionBy(*group).orderBy(blk).rowsBetween(*before)
    offsets = totals.select(*group, blk, *[zero(F.sum(v).over(across)).alias(f"{v}_outer") for v in val.values()])
    scanned = keyed.withColumns({f"{v}_inner": zero(F.sum(v).over(in_block)) for v in val.values()})
    joined = scanned.join(offsets, [*group, blk], "left")
    sums = {out: (F.col(f"{v}_inner") + F.col(f"{v}_outer")).cast("long") for out, v in val.items()}
    return joined.withColumns(sums).drop(blk, *[x for v in val.values() for x in (v, f"{v}_inner", f"{v}_outer")])
