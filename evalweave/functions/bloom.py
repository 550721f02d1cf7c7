"""A Bloom filter of keys that stands beside a scan, so that only rows that may find a partner are shuffled."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a filter. With more keys it lets more through; results stay the same.
FILTER_BITS = 1 << 23


class KeyFilter:
    """A Bloom filter of the rows of ``keys``, by a hash of ``columns``.

    It is built by aggregation, 64 bits a row, into one array of ``bits`` / 64 numbers. ``words`` is that
    array as a scalar subquery, to stand beside the scan as column ``__words``; called with a hash, the
    filter says whether its row may be there. Each row sets two bits.
    """

    def __init__(self, keys: DataFrame, columns: Sequence[str], bits: int = FILTER_BITS):
        self.bits = bits
        at = keys.select(F.explode(F.array(*self._places(F.xxhash64(*columns)))).alias("at"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
        none = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("set"))
        words = at.select(F.floor(F.col("at") / 64).cast("int").alias("word"), one.alias("set")).unionByName(none)
        words = words.groupBy("word").agg(F.bit_or("set").alias("set"))  # all words, one row each
        self.words = words.agg(F.array_sort(F.collect_list(F.struct("word", "set"))).alias("w")).select("w.set").scalar()

    def _places(self, hashed: Column) -> list[Column]:
        return [F.pmod(hashed, F.lit(self.bits)), F.pmod(F.shiftright(hashed, 24), F.lit(self.bits))]

    def __call__(self, hashed: Column) -> Column:
        bit = lambda p: F.getbit(F.get("__words", F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
        return reduce(and_, [bit(p) for p in self._places(hashed)])
