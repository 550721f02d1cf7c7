"""Documents in chunks, and keys of chunks that meet by value.

A chunk holds the texts of about a megabyte of documents as one compressed run of bytes, so array
code sees many documents at once and a shuffle moves few, dense rows. Keys (hashes of pieces of
text) travel as packed arrays, once per chunk whatever their number of occurrences: a key that a
third of all documents share costs one entry per chunk. They meet in buckets, of which there are
more the more text there is, and what each bucket finds goes back to the chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.scratch import written
from evalweave.llm.tokens import drop_encoders, slices

CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20
NO_ID = -(1 << 63)  # stands for a null id: the smallest
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CHUNK_SCHEMA = "chunk long, doc_ids binary, sizes binary, blob binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


def salt(number: int) -> np.uint64:
    """A constant that sets apart what ``number`` counts."""
    return np.uint64(number * int(C1) & (1 << 64) - 1)


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def loose(raw: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype)


@dataclass
class Chunk:
    """Texts of some documents: bytes (with 64 zero bytes to spare), and where each document lies."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def size(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def words64(self) -> np.ndarray:
        """The eight bytes from each position, as a little-endian number."""
        return np.ndarray(len(self.data) - 7, "<u8", self.data, 0, (1,))

    @classmethod
    def of(cls, ids: bytes, sizes: bytes, blob: bytes) -> Chunk:
        size = np.frombuffer(sizes, "<i8")
        ends = np.cumsum(size)
        raw = zstandard.ZstdDecompressor().decompress(blob)
        return cls(np.frombuffer(ids, "<i8"), ends - size, ends, np.frombuffer(raw, np.uint8))


def chunked(docs: DataFrame, text: str, doc: str) -> DataFrame:
    """The chunks of all documents, written to the shared folder; no shuffle.

    A chunk's number is fixed by the writing. Null texts are empty, null ids ``NO_ID``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                sizes = np.array([len(t) for t in texts], "<i8")
                ids = np.asarray(part.column("doc")).astype("<i8")
                blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts) + bytes(64))
                row = [pa.array([number], pa.int64()), *[pa.array([x], pa.binary()) for x in (ids.tobytes(), sizes.tobytes(), blob)]]
                yield pa.RecordBatch.from_arrays(row, ["chunk", "doc_ids", "sizes", "blob"])
                number += 1

    plain = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).cast("string").alias("text"))
    return written(plain.mapInArrow(run, CHUNK_SCHEMA), "chunks", codec="uncompressed")


def bucket_count(chunks: DataFrame) -> int:
    """Buckets for the text of ``chunks``: one per ``BUCKET_BYTES`` stored, at least as many as shuffle partitions."""
    stored = chunks.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0)).alias("b")).first().b
    return max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(stored) // BUCKET_BYTES))


@dataclass
class Keys:
    """Distinct keys of a chunk in bucket order. ``inverse`` maps occurrences to keys."""

    one: np.ndarray
    two: np.ndarray
    low: np.ndarray
    high: np.ndarray
    inverse: np.ndarray
    bounds: np.ndarray  # of the buckets that occur
    buckets: np.ndarray

    @classmethod
    def of(cls, one: np.ndarray, two: np.ndarray, low: np.ndarray, high: np.ndarray, count: int, add: bool = False) -> Keys:
        """``low`` and ``high`` become the smallest and largest of a key; with ``add``, ``low`` the sum."""
        order = np.lexsort((two, one)) if len(two) else np.argsort(one, kind="stable")
        k1, k2 = one[order], two[order] if len(two) else two
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | ((k2[1:] != k2[:-1]) if len(two) else False)
        first = np.flatnonzero(new)
        if len(first):
            low = (np.add if add else np.minimum).reduceat(low[order], first)
            high = np.maximum.reduceat(high[order], first) if len(high) else high
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        k1, k2 = k1[first], k2[first] if len(two) else k2
        bucket = ((k1 >> np.uint64(20)) % np.uint64(count)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        bounds = np.flatnonzero(np.diff(bucket[by], prepend=-1)) if len(by) else np.zeros(0, np.int64)
        return cls(
            k1[by], k2[by] if len(two) else k2, low[by], high[by] if len(high) else high, place[inverse],
            np.append(bounds, len(by)), bucket[by][bounds],
        )

    def rows(self, chunk: int) -> pa.RecordBatch:
        cut = lambda a, i: a[self.bounds[i] : self.bounds[i + 1]] if len(a) else a
        n = len(self.buckets)
        columns = [pa.array([chunk] * n, pa.int64()), pa.array(self.buckets, pa.int64())]
        columns += [pa.array([cut(a, i).tobytes() for i in range(n)], pa.binary()) for a in (self.one, self.two)]
        columns += [pa.array([squeeze(cut(a, i)) for i in range(n)], pa.binary()) for a in (self.low, self.high)]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "one", "two", "low", "high"])

    def spread(self, answers: list[tuple[int, bytes, bytes]], default: int) -> np.ndarray:
        """Per key what its bucket answered, else ``default``."""
        out = np.full(len(self.one), default, np.int64)
        start = dict(zip(self.buckets.tolist(), self.bounds[:-1].tolist()))
        for bucket, at, value in answers:
            out[loose(at, "<u4").astype(np.int64) + start[bucket]] = loose(value, "<i8")
        return out


KEY_SCHEMA = "chunk long, bucket long, one binary, two binary, low binary, high binary"
ANSWER_SCHEMA = "chunk long, bucket long, at binary, value binary"


def _answer(rule: str, one, two, low, high) -> tuple[np.ndarray, np.ndarray]:
    """Which entries get an answer, and the answers."""
    order = np.lexsort((two, one)) if len(two) else np.argsort(one)
    k1 = one[order]
    new = np.ones(len(k1), bool)
    new[1:] = k1[1:] != k1[:-1]
    if len(two):
        k2 = two[order]
        new[1:] |= k2[1:] != k2[:-1]
    first = np.flatnonzero(new)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    if rule == "count":
        total = np.add.reduceat(low[order], first)[group]
        return total >= 2, total
    least = np.minimum.reduceat(low[order], first)[group]
    if rule == "older":
        return least < high, least
    return least < np.maximum.reduceat(high[order], first)[group], least


def meet(keys: DataFrame, rule: str) -> DataFrame:
    """Answers to the keys of all chunks, for entries that ``rule`` selects.

    ``older``: the smallest id that holds the key, where smaller than the entry's largest.
    ``shared``: the same, where two different ids hold the key. ``count``: the sum of ``low`` from 2.
    """
    types = {"one": "<u8", "two": "<u4"}

    def settle(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        raw = {k: [np.frombuffer(x, t) for x in rows[k]] for k, t in types.items()}
        raw |= {k: [loose(x, "<i8") for x in rows[k]] for k in ("low", "high")}
        joined = [np.concatenate(raw[k]) for k in ("one", "two", "low", "high")]
        chosen, value = _answer(rule, *joined)
        ends = np.cumsum([len(x) for x in raw["one"]])
        out: dict[str, list] = {"chunk": [], "bucket": [], "at": [], "value": []}
        for chunk, bucket, a, b in zip(rows["chunk"], rows["bucket"], [0, *ends[:-1].tolist()], ends.tolist()):
            at = np.flatnonzero(chosen[a:b])
            if len(at):
                for name, x in zip(out, (chunk, bucket, squeeze(at.astype("<u4")), squeeze(value[a:b][at].astype("<i8")))):
                    out[name].append(x)
        return pa.table(out, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("at", pa.binary()), ("value", pa.binary())]))

    return keys.groupBy("bucket").applyInArrow(settle, ANSWER_SCHEMA)


def with_answers(chunks: DataFrame, **answers: DataFrame) -> DataFrame:
    """``chunks`` with a list of answers per name; a chunk without answers has an empty list."""
    tagged = None
    for name, df in answers.items():
        one = df.select("chunk", F.lit(name).alias("name"), F.struct("bucket", "at", "value").alias("answer"))
        tagged = one if tagged is None else tagged.unionByName(one)
    lists = tagged.groupBy("chunk").agg(*[F.collect_list(F.when(F.col("name") == n, F.col("answer"))).alias(n) for n in answers])
    return chunks.join(lists, "chunk", "left")


def per_chunk(df: DataFrame, work: Callable[[int, Chunk, dict], pa.RecordBatch | None], schema: str, names: tuple[str, ...] = ()) -> DataFrame:
    """``work(number, chunk, answers)`` for each chunk; ``answers`` by name as lists of tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                answers = {n: [(a["bucket"], a["at"], a["value"]) for a in get(n) or ()] for n in names}
                out = work(get("chunk"), Chunk.of(get("doc_ids"), get("sizes"), get("blob")), answers)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)
