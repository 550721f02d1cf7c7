"""Removal of repeated byte strings by prefix-free parsing and hash classes of windows.

Triggers of a rolling hash cut every text into phrases, so equal stretches of text parse alike. A
phrase with the bytes that follow it, up to the window, is a word of the dictionary. Every window
starts in one phrase and lies in its word. No suffix array is built and nothing is put in corpus
order: only equality of windows counts, and equal hashes stand for it. Three rounds find the smallest document
of each class:

1. words (96-bit hashes) that an earlier document holds: all their windows are old, which settles repetitive text;
2. of the other windows, those whose minimizer (least 64-bit hash of 24 bytes within the window) occurs in
   two documents; equal windows have equal minimizers, so no other window can be old;
3. the remaining windows themselves (96-bit hashes of their bytes).

In every round a chunk of documents sends each of its keys once, so highly repetitive text is cheap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import chunks as C
from evalweave.llm.ngram_join import run_hashes
from evalweave.llm.scratch import documents, release, written

WINDOW = 50
TRIGGER = 8  # bytes that a rolling hash sees
PHRASE_BITS = 6  # a trigger every 64 bytes on average
LONGEST = 4096
MINIMIZER = 24  # a multiple of eight
YOUNGEST = (1 << 63) - 1


class Parse:
    """Phrases of a chunk, and for each the windows that start in it."""

    def __init__(self, chunk: C.Chunk, window: int):
        self.chunk, self.window = chunk, window
        n = chunk.size
        self.words = chunk.words64()
        hashed = C.mix(self.words[:n] * C.C1)
        hit = hashed >> np.uint64(64 - PHRASE_BITS) == 0
        hit[1:] &= ~hit[:-1].copy()  # one trigger in a run of equal bytes
        cut = np.flatnonzero(hit)
        owner = np.searchsorted(chunk.ends, cut, "right")
        cut = cut[cut + TRIGGER <= chunk.ends[owner]] if len(cut) else cut
        full = chunk.starts[chunk.ends > chunk.starts]
        starts = np.unique(np.concatenate([full, cut])).astype(np.int64)
        gaps = np.diff(starts, append=n)
        far = np.flatnonzero(gaps > LONGEST)
        if len(far):  # no triggers for long: cuts at fixed distances, a matter of cost only
            more = [np.arange(starts[i] + LONGEST, starts[i] + gaps[i], LONGEST) for i in far.tolist()]
            starts = np.unique(np.concatenate([starts, *more]))
        self.starts = starts
        self.doc = np.searchsorted(chunk.ends, starts, "right")
        self.ends = np.minimum(np.append(starts[1:], n), chunk.ends[self.doc])
        # One past the last window start of each phrase.
        self.stops = np.maximum(np.minimum(self.ends, chunk.ends[self.doc] - window + 1), starts)
        self.ids = chunk.ids[self.doc]

    def word_keys(self, buckets: int) -> tuple[np.ndarray, C.Keys]:
        """Phrases with windows, and their words' keys."""
        some = np.flatnonzero(self.stops > self.starts)
        length = self.stops[some] - self.starts[some] + self.window - 1
        one = run_hashes(self.words, self.starts[some], length, 1)
        two = (run_hashes(self.words, self.starts[some], length, 1 << 20) >> np.uint64(32)).astype("<u4")
        return some, C.Keys.of(one, two, self.ids[some], self.ids[some], buckets)

    def new_windows(self, answers: list, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Old phrases' windows settled: starts of the other windows, and a mark per old phrase."""
        some, keys = self.word_keys(buckets)
        old = np.zeros(len(self.starts), bool)
        old[some] = keys.spread(answers, YOUNGEST)[keys.inverse] < self.ids[some]
        flags = np.zeros(self.chunk.size + 1, np.int8)
        fresh = ~old & (self.stops > self.starts)
        np.add.at(flags, self.starts[fresh], 1)
        np.add.at(flags, self.stops[fresh], -1)
        return np.flatnonzero(np.cumsum(flags[:-1], dtype=np.int8) > 0), old

    def owner_ids(self, at: np.ndarray) -> np.ndarray:
        return self.chunk.ids[np.searchsorted(self.chunk.ends, at, "right")]

    def minimizers(self, at: np.ndarray) -> np.ndarray:
        """Least hash of ``MINIMIZER`` bytes within each window."""
        n = len(self.words) - MINIMIZER + 8
        grams = np.zeros(n, np.uint64)
        for offset in range(0, MINIMIZER, 8):
            grams = C.mix(grams * C.C1 ^ (self.words[offset : offset + n] + C.C3))
        span, width = self.window - MINIMIZER + 1, 1
        least = grams
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        return np.minimum(least[at], least[at + span - width])

    def minimizer_keys(self, at: np.ndarray, buckets: int) -> tuple[np.ndarray, C.Keys]:
        """Runs of windows with one minimizer and document (run of each window), and the runs' keys."""
        value, ids = self.minimizers(at), self.owner_ids(at)
        new = np.ones(len(at), bool)
        new[1:] = (value[1:] != value[:-1]) | (ids[1:] != ids[:-1])
        first = np.flatnonzero(new)
        return np.cumsum(new) - 1, C.Keys.of(value[first], np.zeros(0, "<u4"), ids[first], ids[first], buckets)

    def window_keys(self, at: np.ndarray, buckets: int) -> C.Keys:
        one, two = np.full(len(at), C.C1), np.full(len(at), C.C2)
        for offset in [*range(0, self.window - 7, 8), self.window - 8]:
            value = self.words[at + offset]
            one, two = C.mix(one ^ value), C.mix(two + value * C.C3)
        ids = self.owner_ids(at)
        return C.Keys.of(one, (two >> np.uint64(32)).astype("<u4"), ids, ids, buckets)

    def candidates(self, answers: dict, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows that the first two rounds leave open, and the old phrases."""
        at, old = self.new_windows(answers["words"], buckets)
        if not len(at):
            return at, old
        run, keys = self.minimizer_keys(at, buckets)
        shared = keys.spread(answers["minimizers"], YOUNGEST)[keys.inverse] != YOUNGEST
        return at[shared[run]], old

    def removed(self, answers: dict, buckets: int) -> np.ndarray:
        """Whether each byte lies in a window that a smaller document holds."""
        at, old = self.candidates(answers, buckets)
        step = np.zeros(self.chunk.size + 1, np.int32)
        np.add.at(step, self.starts[old], 1)
        np.add.at(step, self.stops[old] + self.window - 1, -1)
        if len(at):
            keys = self.window_keys(at, buckets)
            gone = at[keys.spread(answers["windows"], YOUNGEST)[keys.inverse] < self.owner_ids(at)]
            np.add.at(step, gone, 1)
            np.add.at(step, gone + self.window, -1)
        return np.cumsum(step[:-1]) > 0


OUT_SCHEMA = "doc long, n_bytes long, n_removed long, n_spans long, span_starts binary, span_ends binary, kept binary"


def strip_repeats(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Each document's bytes without those covered by a ``window``-byte string of a smaller document.

    One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans``, ``span_starts`` and ``span_ends`` (byte
    offsets of the maximal removed runs, little-endian 64-bit) and ``kept`` (the other bytes). Texts are
    judged as UTF-8 bytes, on the input; strings never cross documents, and overlaps count.

    A null or empty text has no bytes. Ids are integers; a null id is the smallest. Rows that share
    an id are no smaller than each other, so they keep their common strings.
    """
    if not MINIMIZER <= window <= 64:
        raise ValueError(f"windows have {MINIMIZER} to 64 bytes")
    spark = docs.sparkSession
    chunks = C.chunked(docs, text, doc)
    buckets = C.bucket_count(chunks)

    def words(number: int, chunk: C.Chunk, _: dict) -> pa.RecordBatch:
        return Parse(chunk, window).word_keys(buckets)[1].rows(number)

    def minimizers(number: int, chunk: C.Chunk, answers: dict) -> pa.RecordBatch:
        parse = Parse(chunk, window)
        at = parse.new_windows(answers["words"], buckets)[0]
        return parse.minimizer_keys(at, buckets)[1].rows(number)

    def windows(number: int, chunk: C.Chunk, answers: dict) -> pa.RecordBatch:
        parse = Parse(chunk, window)
        return parse.window_keys(parse.candidates(answers, buckets)[0], buckets).rows(number)

    answers: dict[str, DataFrame] = {}
    for name, work, rule in (("words", words, "older"), ("minimizers", minimizers, "shared"), ("windows", windows, "older")):
        source = C.with_answers(chunks, **answers) if answers else chunks
        keys = C.per_chunk(source, work, C.KEY_SCHEMA, tuple(answers))
        answers[name] = written(C.meet(keys, rule), name, codec="uncompressed")
        del source, keys
        release(spark)

    def strip(number: int, chunk: C.Chunk, answers: dict) -> pa.RecordBatch:
        gone = Parse(chunk, window).removed(answers, buckets)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2]
        # A run that touches the next document's is cut at the border.
        inner = chunk.ends[(chunk.ends > 0) & (chunk.ends < chunk.size)]
        inner = np.unique(inner[gone[inner - 1] & gone[inner]]) if len(gone) else inner
        begin, end = np.sort(np.concatenate([begin, inner])), np.sort(np.concatenate([end, inner]))
        data, rows = chunk.data, ([], [], [], [], [], [])
        for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist()):
            low, high = np.searchsorted(begin, a), np.searchsorted(begin, b)
            values = (
                b - a, int(gone[a:b].sum()), int(high - low), (begin[low:high] - a).astype("<i8").tobytes(),
                (end[low:high] - a).astype("<i8").tobytes(), data[a:b][~gone[a:b]].tobytes(),
            )
            for column, value in zip(rows, values):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in OUT_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(chunk.ids, pa.int64()), *[pa.array(r, t) for r, t in zip(rows, types)]], names)

    out = C.per_chunk(C.with_answers(chunks, **answers), strip, OUT_SCHEMA, tuple(answers))
    real = F.when(F.col("doc") != C.NO_ID, F.col("doc")).cast(docs.schema[doc].dataType)
    return out.select(real.alias("doc_id"), *[c.split()[0] for c in OUT_SCHEMA.split(", ")[1:]])


def op4_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_prefix_free": op4_prefix_free}
ORACLE: dict[str, str] = {}
