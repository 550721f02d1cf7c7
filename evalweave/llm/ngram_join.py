"""N-gram Jaccard join: which documents share three quarters of their word shingles.

Sizes bound what must be compared. A shingle of one document alone can add to no overlap, so a
document with too few shared shingles links with nothing. Of the others, one per distinct set goes
on; documents that link must meet in one of their rarest shingles. Each candidate pair is tested by
a merge of its two whole shingle lists, which gives the exact overlap. Among
the documents that meet in a shingle, first each is tested with one pivot; only pairs that are
not connected then are tested pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import chunks as C
from evalweave.llm.components import components
from evalweave.llm.scratch import documents, release, written
from evalweave.llm.tokens import drop_encoders

WORDS = 5
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def run_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of bytes: a sum of mixed eight-byte words that depend on their places."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    count = np.maximum((lengths + 7) // 8, 1)
    owner = np.repeat(np.arange(len(starts)), count)
    first = np.cumsum(count) - count
    j = np.arange(len(owner)) - first[owner]
    value = words[starts[owner] + 8 * j].copy()
    left = np.clip(lengths[owner] - 8 * j, 0, 8)
    part = left < 8
    value[part] &= (np.uint64(1) << (left[part] * 8).astype(np.uint64)) - np.uint64(1)
    mixed = C.mix(value ^ ((j.astype(np.uint64) + np.uint64(seed)) * C.C1))
    return C.mix(np.add.reduceat(mixed, first) + lengths.astype(np.uint64) * C.C2)


def shingles(chunk: C.Chunk, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document index, shingle) of a chunk, sorted by document and shingle."""
    low = C.Chunk(chunk.ids, chunk.starts, chunk.ends, LOWER[chunk.data])
    n = chunk.size
    blank = BLANK[low.data[:n]]
    edge = np.zeros(n + 1, bool)
    edge[chunk.starts] = True
    begins = np.flatnonzero(~blank & (edge[:n] | np.concatenate([[True], blank[:-1]])))
    ends = np.zeros(n + 1, bool)
    ends[chunk.ends] = True
    stops = np.flatnonzero(~blank & (ends[1:] | np.append(blank[1:], True)))
    owner = np.searchsorted(chunk.starts, begins, "right") - 1
    # Empty documents share a start with the next one; the last of equal starts holds the text.
    hashes = run_hashes(low.words64(), begins, stops - begins + 1, 1)
    held = np.bincount(owner, minlength=len(chunk.ids))
    first = np.cumsum(held) - held
    size = np.minimum(np.maximum(held - words + 1, 1), held)  # shingles of each document, with repeats
    total = np.zeros(len(hashes), np.uint64)
    for j in range(words):
        part = C.mix(hashes + C.salt(j + 1))
        total[: len(total) - j] += part[j:]
    at = np.repeat(first, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
    doc = np.repeat(np.arange(len(held)), size)
    value = C.mix(total[at]) if len(at) else np.zeros(0, np.uint64)
    for d in np.flatnonzero((held > 0) & (held < words)).tolist():
        few = sum((int(C.mix(hashes[first[d] + j : first[d] + j + 1] + C.salt(j + 1))[0]) for j in range(held[d])), int(held[d]) * 7919)
        value[np.searchsorted(doc, d)] = C.mix(np.array([few & (1 << 64) - 1], np.uint64))[0]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _keys(chunk: C.Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray, C.Keys]:
    doc, value = shingles(chunk)
    none = np.zeros(0, np.int64)
    return doc, value, C.Keys.of(value, np.zeros(0, "<u4"), np.ones(len(value), np.int64), none, buckets, add=True)


SET_SCHEMA = "doc long, n long, one long, two long, grams binary, useful int"


def _sets(chunks: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """Per document its set's size; where it may link: a hash of the set, and its shared shingles, rarest first.

    ``useful`` is how many of those belong to the prefix in which linked documents must meet.
    """

    def emit(number: int, chunk: C.Chunk, _: dict) -> pa.RecordBatch:
        return _keys(chunk, buckets)[2].rows(number)

    counts = written(C.meet(C.per_chunk(chunks, emit, C.KEY_SCHEMA), "count"), "shingle-counts", codec="uncompressed")
    release(chunks.sparkSession)

    def sets(number: int, chunk: C.Chunk, answers: dict) -> pa.RecordBatch:
        doc, value, keys = _keys(chunk, buckets)
        seen = keys.spread(answers["counts"], 1)[keys.inverse]
        size = np.bincount(doc, minlength=len(chunk.ids))
        shared = seen >= 2
        common = np.bincount(doc[shared], minlength=len(chunk.ids))
        may = (size > 0) & (common * den >= size * num)
        marks = [np.zeros(len(chunk.ids), np.uint64) for _ in range(2)]
        if len(doc):
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            for s, mark in enumerate(marks):
                mark[doc[first]] = np.add.reduceat(C.mix(value + C.salt(s + 11)), first)
        order = np.lexsort((value, seen, doc))
        order = order[shared[order] & may[doc[order]]]
        ends = np.cumsum(np.where(may, common, 0))
        raw = value[order].astype("<u8").tobytes()
        grams = [raw[8 * (e - c) : 8 * e] if m else None for e, c, m in zip(ends.tolist(), common.tolist(), may.tolist())]
        prefix = size - (size * num + den - 1) // den + 1 - (size - common)
        columns = [chunk.ids, size, *[m.view("<i8") for m in marks]]
        return pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns], pa.array(grams, pa.binary()), pa.array(np.maximum(prefix, 0), pa.int32())],
            ["doc", "n", "one", "two", "grams", "useful"],
        )

    return written(C.per_chunk(C.with_answers(chunks, counts=counts), sets, SET_SCHEMA, ("counts",)), "shingle-sets", codec="uncompressed")


def _prefixes(sets: DataFrame) -> DataFrame:
    """One row per representative and shingle of its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        for batch in batches:
            useful = np.asarray(batch.column("useful")).astype(np.int64)
            grams = [np.frombuffer(g, "<i8")[:u] for g, u in zip(batch.column("grams").to_pylist(), useful.tolist())]
            at = pa.array(np.repeat(np.arange(len(grams)), [len(g) for g in grams]))
            gram = pa.array(np.concatenate(grams) if grams else np.zeros(0, "<i8"), pa.int64())
            # Shingles of one document alone are rarer than all others, so they stand before them.
            alone = np.asarray(batch.column("n")) - np.array([len(g) // 8 for g in batch.column("grams").to_pylist()], np.int64)
            place = np.concatenate([np.arange(len(g)) + a for g, a in zip(grams, alone.tolist())]) if grams else alone
            yield pa.RecordBatch.from_arrays(
                [gram, batch.column("doc").take(at), batch.column("n").take(at), pa.array(place.astype(np.int64), pa.int64())], ["gram", "doc", "n", "place"]
            )

    return sets.select("doc", "n", "grams", "useful").mapInArrow(run, "gram long, doc long, n long, place long")


def _tested(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)`` that link, by overlap counts of their sets.

    Both shingle lists of a pair come with it; entries (pair, shingle) of both sides that coincide after
    a sort add one to the pair's overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                sides = [[np.frombuffer(g, "<u8") for g in part.column(c).to_pylist()] for c in ("grams_a", "grams_b")]
                pair = np.concatenate([np.repeat(np.arange(len(s)), [len(g) for g in s]) for s in sides])
                gram = np.concatenate([g for s in sides for g in s] or [np.zeros(0, "<u8")])
                order = np.lexsort((gram, pair))
                pair, gram = pair[order], gram[order]
                both = pair[1:][(pair[1:] == pair[:-1]) & (gram[1:] == gram[:-1])]
                overlap = np.bincount(both, minlength=part.num_rows)
                sizes = [np.asarray(part.column(c)) for c in ("n_a", "n_b")]
                linked = overlap * den >= (sizes[0] + sizes[1] - overlap) * num
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    side = lambda s: sets.select(F.col("doc").alias(s), F.col("grams").alias(f"grams_{s}"), F.col("n").alias(f"n_{s}"))
    met = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    return met.select("a", "b", "grams_a", "n_a", "grams_b", "n_b").mapInArrow(run, "a long, b long")


def _fitting(num: int, den: int):
    """Whether sizes, and the places of a first common shingle, allow a link.

    If two sets first meet at those places of the common order, what follows bounds their overlap.
    A pair that links passes at its first common shingle.
    """
    sizes = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
    most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    return sizes & (most * (num + den) >= (F.col("n_a") + F.col("n_b")) * num)


def _pivots(rows: DataFrame, largest: bool, single: bool, num: int, den: int) -> DataFrame:
    """Pairs of each document with a pivot of its shingle: linear in the size of the group.

    The pivot is the smallest or largest set. With ``single``, each document keeps one of its pivots.
    """
    order = -F.col("n") if largest else F.col("n")
    pick = F.min(F.struct(order.alias("order"), "doc", "n", "place"))
    pivot = rows.groupBy("gram").agg(pick.alias("p"), F.count("*").alias("held")).where("held > 1")
    pivot = pivot.select("gram", F.col("p.doc").alias("a"), F.col("p.n").alias("n_a"), F.col("p.place").alias("place_a"))
    met = rows.join(pivot, "gram").select("a", F.col("doc").alias("b"), "n_a", F.col("n").alias("n_b"), "place_a", F.col("place").alias("place_b"))
    met = met.where((F.col("a") != F.col("b")) & _fitting(num, den))
    if not single:
        return met
    return met.groupBy("b").agg(F.min(F.struct((-F.col("n_a") if largest else F.col("n_a")).alias("order"), "a")).alias("p")).select("p.a", "b")


def similarity_classes(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A document's set holds
    its distinct shingles of five words; with fewer words, the whole sequence as one. Documents link
    when 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest id reachable by
    links, its own included.

    A text that is null, empty or blank has no shingles and links with nothing. Ids are integers; a
    null id is an id of its own, the smallest. Rows that share an id are judged each by its own set
    and share one component.
    """
    spark = docs.sparkSession
    num, den = percent, 100
    chunks = C.chunked(docs, text, doc)
    sets = _sets(chunks, C.bucket_count(chunks), num, den)
    release(spark)
    may = sets.where(F.col("grams").isNotNull())
    members = written(may.select("doc", "one", "two", "n"), "set-members")
    # Equal sets have equal content, so any row stands for its class.
    classes = may.groupBy("one", "two", "n").agg(F.min("doc").alias("doc"), F.first("grams").alias("grams"), F.first("useful").alias("useful"))
    # The smallest id names the class. An id with two texts may name two; both then speak for the id.
    classes = written(classes, "set-classes", codec="uncompressed")
    release(spark)
    rows = written(_prefixes(classes), "prefixes")
    # First one pivot for each document, then, where groups stay apart, another and all of them.
    links, open_rows = None, rows
    for largest, single in ((False, True), (True, True), (False, False), (True, False)):
        found = written(_tested(_pivots(open_rows, largest, single, num, den), classes, num, den), "links")
        links = found if links is None else links.unionByName(found)
        open_rows = written(_open(_labelled(rows, components(links))), "open")
        release(spark)
    left, right = (open_rows.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("doc", "n", "place", "label")]) for s in ("a", "b"))
    rest = left.join(right, "gram").where((F.col("label_a") < F.col("label_b")) & _fitting(num, den))
    third = written(_tested(rest.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")), classes, num, den), "links")
    release(spark)
    # Components of documents: members of one class meet in the class's smallest document.
    own = members.join(classes.select("one", "two", "n", F.col("doc").alias("b")), ["one", "two", "n"]).select(F.col("doc").alias("a"), "b")
    final = components(own.unionByName(links).unionByName(third))
    out = sets.select("doc", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "doc"), "doc", "left")
    key = docs.schema[doc].dataType
    real = lambda c: F.when(c != C.NO_ID, c).cast(key)
    return out.select(real(F.col("doc")).alias("doc_id"), "n_shingles", real(F.coalesce("component", "doc")).alias("component_id"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").select(
        "gram", "doc", "n", "place", F.coalesce("component", "doc").alias("label")
    )


def _open(labelled: DataFrame) -> DataFrame:
    """Rows of the shingles whose documents are not all connected yet."""
    mixed = labelled.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gram")
    return labelled.join(mixed, "gram")


def one_per_group(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", percent: int = 75) -> DataFrame:
    """``docs`` without those that reach a smaller id by links; rows that share an id stay together."""
    found = similarity_classes(docs, text=text, doc=doc, percent=percent)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc] == gone["__gone"], "left_anti")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(documents(spark, sf_dir))


QUERIES = {"op5_ngram_jaccard": op5_ngram_jaccard}
ORACLE: dict[str, str] = {}
