"""Short byte windows of texts as numbers, for substring search by equi-join.

Windows are cut from UTF-8 bytes with NumPy, all positions of a batch at once: a string lies in a text just
if its bytes do. A literal is keyed by windows of the size that its length allows, a text by those of all
sizes that pass a Bloom filter of the literals' keys. Equal windows have equal numbers; the caller decides
by the strings themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZES = (3, 4, 6)
# Bytes looked at in one go, whatever texts they belong to.
CHUNK = 1 << 18
# Windows of one literal that may key it, spread over its length: any of them would do.
CHOICE = 256
# Filter bits per key, and the filter's size as a power of two.
BITS_PER_KEY, LEAST, MOST = 16, 16, 28
# Odd numbers that spread a window over 64 bits, one per test.
SPREAD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row begins in them, with the end."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), at


def _windows(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per size, the windows at all positions as numbers that also tell the size."""
    one = data.astype(np.uint64)
    two = (one[:-1] << np.uint64(8)) | one[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    numbers = {3: (two[:-1] << np.uint64(8)) | one[2:], 4: four, 6: (four[:-2] << np.uint64(16)) | two[4:]}
    for size in SIZES:
        yield size, numbers[size] | np.uint64(size << 56)


def _places(mixed: np.ndarray, test: int, power: int) -> np.ndarray:
    return (mixed * SPREAD[test]) >> np.uint64(64 - power)


def _mixed(numbers: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Windows mixed with a hash of their group, high bits into low ones."""
    mixed = (numbers ^ group) * SPREAD[0]
    return mixed ^ (mixed >> np.uint64(29))


def _found(batch: pa.RecordBatch, choose) -> pa.RecordBatch:
    """The other columns of the rows with each distinct ``key`` that ``choose`` leaves in a row's ``__text``."""
    data, at = _bytes(batch.column("__text"))
    group = batch.column("__group").to_numpy().view(np.uint64)
    rows, keys = [], []
    for begin in range(int(at[0]), int(at[-1]), CHUNK):
        end = min(begin + CHUNK + max(SIZES) - 1, int(at[-1]))
        first, last = np.searchsorted(at, begin, "right") - 1, np.searchsorted(at, end, "left")
        lengths = np.diff(np.clip(at[first : last + 1], begin, end))
        groups = np.repeat(group[first:last], lengths)
        for size, numbers in _windows(data[begin:end]):
            numbers = numbers[:CHUNK]
            kept = choose(numbers, groups[: len(numbers)])
            row = np.searchsorted(at, kept + begin, "right") - 1
            inside = kept + begin + size <= at[row + 1]
            rows.append(row[inside])
            keys.append(numbers[kept[inside]])
    row, key = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (keys, np.uint64)))
    pairs = np.unique(np.rec.fromarrays([row, key])) if len(row) else np.rec.fromarrays([row, key])
    others = [i for i, name in enumerate(batch.schema.names) if name not in ("__text", "__group")]
    taken = [batch.column(i).take(pa.array(pairs.f0)) for i in others]
    return pa.RecordBatch.from_arrays([*taken, pa.array(pairs.f1.view(np.int64))], [*(batch.schema.names[i] for i in others), "key"])


def _schema(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns) + ", key long"


def literal_windows(literals: DataFrame, literal: str, by: Sequence[str]) -> DataFrame:
    """``by, literal, key``: windows of each literal in the largest size it has room for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _bytes(batch.column(literal))
            rows, keys = [], []
            for row, (begin, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                size = next((s for s in reversed(SIZES) if s <= end - begin), None)
                if size is None:
                    continue
                text, room = data[begin:end].tobytes(), end - begin - size + 1
                cut = {text[i : i + size] for i in range(0, room, -(-room // CHOICE))}
                rows += [row] * len(cut)
                keys += [int.from_bytes(c, "big") | size << 56 for c in cut]
            taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(keys, pa.int64())], [*batch.schema.names, "key"])

    columns = [*by, literal]
    return literals.select(*columns).filter(F.col(literal).isNotNull()).mapInArrow(run, _schema(literals, columns))


class WindowFilter:
    """A Bloom filter of ``keys`` (``by``, ``key``) whose size grows with their number; four bits a key.

    It is built by aggregation; only its set words reach the driver, which broadcasts them to the scans.
    """

    def __init__(self, keys: DataFrame, by: Sequence[str]):
        spark = keys.sparkSession
        wanted = max(1, keys.count() * BITS_PER_KEY)
        self.power = power = min(MOST, max(LEAST, (wanted - 1).bit_length()))

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                group, key = (batch.column(c).to_numpy().view(np.uint64) for c in ("__group", "key"))
                mixed = _mixed(key, group)
                at = np.concatenate([_places(mixed, t, power) for t in range(len(SPREAD))])
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64))], ["at"])

        at = keys.select(F.xxhash64(*by).alias("__group"), "key").mapInArrow(places, "at long")
        bit = F.call_function("shiftleft", F.lit(1), (F.col("at") % 8).cast("int"))
        words = at.groupBy(F.floor(F.col("at") / 8).cast("int").alias("word")).agg(F.bit_or(bit).alias("set")).toArrow()
        bits = np.zeros(1 << (power - 3), np.uint8)
        bits[words.column("word").to_numpy()] = words.column("set").to_numpy()
        self.bits = spark.sparkContext.broadcast(bits)

    def windows(self, texts: DataFrame, text: str, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
        """``columns`` and ``key`` of the distinct windows of each text that the filter lets through."""
        held, power = self.bits, self.power

        def choose(numbers: np.ndarray, groups: np.ndarray) -> np.ndarray:
            bits, mixed, left = held.value, _mixed(numbers, groups), None
            for test in range(len(SPREAD)):
                at = _places(mixed, test, power)
                hit = np.flatnonzero((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
                mixed, left = mixed[hit], hit if left is None else left[hit]
            return left

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _found(batch, choose)

        body = F.coalesce(F.col(text), F.lit("")).alias("__text")
        return texts.select(*columns, F.xxhash64(*by).alias("__group"), body).mapInArrow(run, _schema(texts, columns))
