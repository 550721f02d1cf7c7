"""Benchmark decontamination by pigeonhole edit matching.

A text within e edits of a test item holds at least one of the item's e + 1 pieces unchanged. Every
position of every document is looked up among the pieces' leading bytes, hits are compared in full,
places around them that hold too few of the item's trigrams are left out, and Myers' bit-parallel
algorithm finds the edit distance in the places that remain. The
benchmark is broadcast in blocks of bounded size, and each block meets all documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evalweave.llm.scratch import documents
from evalweave.llm.tokens import drop_encoders, slices

SLICE_BYTES = 2 << 20
STEP = 1 << 20
GRAM = 12
GRAMS = (GRAM, 8, 4, 2, 1)  # a piece is looked up by the longest of these that it holds
FILTER_BITS = 22
BLOCK_BYTES = 8 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0, 9, 10, 11, 12, 13, 32]] = True


def normalised(raw: bytes) -> tuple[bytes, np.ndarray]:
    """A-Z in lower case, runs of ASCII white space as one space, and each byte's place in ``raw``."""
    data = LOWER[np.frombuffer(raw, np.uint8)]
    blank = BLANK[data]
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    keep[:1] = True
    return np.where(blank, np.uint8(32), data)[keep].tobytes(), np.flatnonzero(keep)


def budget(length: int, rate: float, least_piece: int = 1) -> int:
    """Edits allowed for an item: a share of its length, but pieces of ``least_piece`` bytes at least."""
    return max(0, min(int(length * Fraction(str(rate))), length // least_piece - 1))


def piece_bounds(length: int, errors: int) -> list[tuple[int, int]]:
    """The item cut into ``errors`` + 1 pieces of about equal length."""
    cuts = [length * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts, cuts[1:]))


def myers(pattern: bytes, text: bytes) -> list[int]:
    """For each end in ``text``, the least edit distance of ``pattern`` to a substring ending there."""
    size = len(pattern)
    mask, top = (1 << size) - 1, 1 << (size - 1)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    pv, mv, distance, out = mask, 0, size, []
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            distance += 1
        elif mh & top:
            distance -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        out.append(distance)
    return out


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes (one of ``GRAMS``) from each position that has them."""
    n = len(data) - size + 1
    word = lambda at: np.ndarray(n, f"<u{min(size, 8)}", data, at, (1,)).astype(np.uint64)
    mixed = word(0) * np.uint64(0x9E3779B97F4A7C15) ^ (word(max(0, size - 8)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    return (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def _trigrams(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8).astype(np.int32)
    return data[:-2] << 16 | data[1:-1] << 8 | data[2:]


@lru_cache(4096)
def _gram_counts(pattern: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of an item, sorted, and how often it holds each."""
    return np.unique(_trigrams(pattern), return_counts=True)


@dataclass
class Index:
    """Pieces by the hash of their first ``size`` bytes."""

    size: int
    grams: np.ndarray  # sorted, distinct
    pieces: list[list[tuple[int, int, int]]]  # per gram: item, start, end
    seen: np.ndarray

    @classmethod
    def of(cls, size: int, texts: list[bytes], pieces: list[tuple[int, int, int]]) -> Index:
        by_gram = defaultdict(list)
        for i, a, b in pieces:
            by_gram[int(_grams(np.frombuffer(texts[i][a : a + size], np.uint8), size)[0])].append((i, a, b))
        grams = np.array(sorted(by_gram), np.uint64)
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return cls(size, grams, [by_gram[g] for g in grams.tolist()], seen)

    def hits(self, data: np.ndarray) -> Iterator[tuple[list[int], list[int]]]:
        """Places in ``data`` that hold a gram, and the gram's number, in steps."""
        for at in range(0, max(0, len(data) - self.size + 1), STEP):
            hashes = _grams(data[at : at + STEP + self.size - 1], self.size)
            near = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            rank = np.minimum(np.searchsorted(self.grams, hashes[near]), len(self.grams) - 1)
            same = self.grams[rank] == hashes[near]
            yield near[same] + at, rank[same]


@dataclass
class Items:
    """Test items ready for matching."""

    ids: list
    texts: list[bytes]
    errors: list[int]
    indexes: list[Index] = field(default_factory=list)
    short: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple], rate: float) -> Items:
        """Null and blank items are left out."""
        if not 0 <= rate < 1:
            raise ValueError(f"rate {rate}: a share of the item's length, at least 0 and less than 1")
        out = cls([], [], [])
        for ident, text in rows:
            norm = normalised((text or "").encode())[0].strip()
            if norm:
                out.ids.append(ident)
                out.texts.append(norm)
                out.errors.append(budget(len(norm), rate))
        by_size = defaultdict(list)
        for i, (text, errors) in enumerate(zip(out.texts, out.errors)):
            if len(text) < GRAM and not errors:
                out.short.append(i)
                continue
            for a, b in piece_bounds(len(text), errors):
                by_size[next(g for g in GRAMS if g <= b - a)].append((i, a, b))
        out.indexes = [Index.of(size, out.texts, pieces) for size, pieces in by_size.items()]
        return out

    def places(self, text: bytes) -> dict[int, list[int]]:
        """Per item the places where it would start in ``text`` if a piece found there is unmoved."""
        found: dict[int, list[int]] = defaultdict(list)
        for i in self.short:
            at = text.find(self.texts[i])
            while at >= 0:
                found[i].append(at)
                at = text.find(self.texts[i], at + 1)
        return found

    def search(self, texts: list[bytes]) -> list[dict[int, list[int]]]:
        """``places`` of all texts, by a scan of their bytes in steps for each size of gram."""
        out = [self.places(t) if self.short else defaultdict(list) for t in texts]
        if not self.indexes:
            return out
        gap = bytes(GRAM)
        data = np.frombuffer(gap.join(texts) + gap, np.uint8)
        sizes = np.array([len(t) + GRAM for t in texts])
        starts = np.cumsum(sizes) - sizes
        for index in self.indexes:
            for hits, ranks in index.hits(data):
                docs = np.searchsorted(starts, hits, "right") - 1
                for d, place, r in zip(docs.tolist(), (hits - starts[docs]).tolist(), ranks.tolist()):
                    for i, a, b in index.pieces[r]:
                        if texts[d].startswith(self.texts[i][a:b], place):
                            out[d][i].append(place - a)
        return out

    def matches(self, text: bytes, places: dict[int, list[int]]) -> list[tuple[int, int, int, int]]:
        """Per item within its budget: item, distance, start and end of the best match (the first of equals)."""
        out = []
        codes = _trigrams(text)
        for i, diagonals in places.items():
            pattern, errors = self.texts[i], self.errors[i]
            grams, counts = _gram_counts(pattern)
            best = None
            for low, high in _runs(sorted(set(diagonals)), 2 * errors + 1):
                window, stop = max(0, low - errors), min(len(text), high + len(pattern) + errors)
                for first, last in _likely(codes, window, stop, grams, counts, len(pattern), errors):
                    part = text[first:last]
                    distances = myers(pattern, part)
                    least = min(distances)
                    if least <= errors and (best is None or least < best[0]):
                        end = distances.index(least)
                        back = myers(pattern[::-1], part[: end + 1][::-1][: len(pattern) + errors])
                        best = (least, first + end - back.index(min(back)), first + end + 1)
                if best and best[0] == 0:
                    break
            if best:
                out.append((i, *best))
        return out


def _likely(codes: np.ndarray, start: int, stop: int, grams: np.ndarray, counts: np.ndarray, length: int, errors: int) -> Iterator[tuple[int, int]]:
    """The parts of a text's bytes ``start`` to ``stop`` that hold trigrams enough for a match.

    An edit spoils three trigrams of the item at most; all others occur in the match, which has
    ``length`` + ``errors`` bytes at most and so lies in one of the windows of twice that size.
    """
    need = length - 2 - 3 * errors
    if need <= 0:
        yield start, stop
        return
    window = codes[start : max(start, stop - 2)]
    rank = np.minimum(np.searchsorted(grams, window), len(grams) - 1)
    rank[grams[rank] != window] = len(grams)
    step, open_at, until = length + errors, None, 0
    for at in range(0, stop - start, step):
        held = np.zeros(len(grams) + 1, bool)
        held[rank[at : at + 2 * step - 2]] = True
        if counts[held[:-1]].sum() >= need:
            if open_at is not None and at > until:
                yield start + open_at, start + until
                open_at = None
            open_at = at if open_at is None else open_at
            until = min(at + 2 * step, stop - start)
        if at + 2 * step >= stop - start:
            break
    if open_at is not None:
        yield start + open_at, start + until


def _runs(values: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """First and last of each run of sorted values whose steps are at most ``gap``."""
    first = last = values[0]
    for v in values[1:]:
        if v - last > gap:
            yield first, last
            first = v
        last = v
    yield first, last


def _blocks(benchmark: DataFrame, item: str, text: str, rate: float) -> Iterator[Items]:
    """The benchmark in parts of about ``BLOCK_BYTES``; one part is on the driver at a time."""
    rows = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0)).alias("b")).first().b
    parts = -(-int(total) // BLOCK_BYTES)
    for p in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p)
        yield Items.of(sorted(((r.item, r.text) for r in mine.collect()), key=lambda r: (r[0] is None, r[0])), rate)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc: str = "doc_id", item: str = "item_id", item_text: str = "text", rate: float = 0.1
) -> DataFrame:
    """One row per document and test item within its edit budget: ``doc_id, item_id, distance, start, stop``.

    Texts compare as UTF-8 bytes with A-Z lower-cased and runs of ASCII white space (and zero bytes)
    as one space. An item of n bytes allows ``rate`` * n edits, rounded down; ``rate`` is less than 1.
    ``start`` and ``stop`` are bytes of the document's
    text around the best match, the first of equals. Items that repeat are reported each; null,
    empty and blank texts match nothing. A null document id stays null. Repeated documents give
    repeated rows.
    """
    sc = docs.sparkSession.sparkContext
    kinds = docs.schema[doc].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    pairs = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, start long, stop long"
    out = None
    for items in _blocks(benchmark, item, item_text, rate):
        shared = sc.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            drop_encoders()
            items = shared.value
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    both = [normalised((t or "").encode()) for t in part.column("text").to_pylist()]
                    rows = []
                    for at, (places, (norm, origin)) in enumerate(zip(items.search([b[0] for b in both]), both)):
                        for i, distance, start, stop in items.matches(norm, places) if places else ():
                            rows.append((at, items.ids[i], distance, int(origin[start]), int(origin[stop - 1]) + 1))
                    if rows:
                        columns = list(zip(*rows))
                        keys = part.column("doc").take(pa.array(columns[0]))
                        yield pa.RecordBatch.from_arrays(
                            [keys, pa.array(columns[1], item_type), pa.array(columns[2], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[3:]]],
                            ["doc_id", "item_id", "distance", "start", "stop"],
                        )

        found = pairs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = 0.1) -> DataFrame:
    """``docs`` without the rows that hold a test item within its edit budget; no shuffle.

    Rows are judged one by one, so repeated ones go together; null and empty texts stay. Other columns
    pass through, whatever their names. A text of any length is one row of one task.
    """
    names = docs.columns
    at = f"c{names.index(text)}"
    out = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names with dots do not pass mapInArrow
    for items in _blocks(benchmark, item, item_text, rate):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            drop_encoders()
            items = shared.value
            for batch in batches:
                for part in slices(batch, at, SLICE_BYTES):
                    norms = [normalised((t or "").encode())[0] for t in part.column(at).to_pylist()]
                    clean = [not (places and items.matches(n, places)) for n, places in zip(norms, items.search(norms))]
                    yield part.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out.toDF(*names)


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


QUERIES = {"op3_benchmark_leaks": op3_benchmark_leaks}
ORACLE: dict[str, str] = {}
