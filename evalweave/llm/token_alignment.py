"""Alignment of two tokenizers' tokens by diagonal run skipping, and corpus counts of linked ids.

Each text is encoded by a byte-level BPE (A) and by pieces with byte fallback (B). The tokens' ends in
bytes are compared along the current index shift: exponential probing finds how far both end arrays
stay equal and jumps over that one-to-one stretch. Where they part, ends are advanced one by one to the
next common end, which closes an irregular group and sets the new shift.

Texts are cut where neither tokenizer lets a token cross (see ``tokens``). Such a cut is a common end, so a
piece has the same tokens, groups and links wherever it stands: each distinct piece of a chunk of texts is
aligned once, and the texts' figures and hashes are put together from their pieces. A text in which a cut
could matter to either tokenizer is one piece.

Links are counted in three steps. A task writes one row per chunk of texts, with the chunk's distinct id
pairs once, its pieces' links as places in them and its texts as places in the pieces. Only (chunk, pair)
rows are shuffled for the counts; the counts return to the chunk, where the links look them up. So a pair
that every text holds costs one row per chunk, not one per text.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalweave.llm.packing import _path
from evalweave.llm.scratch import documents, written
from evalweave.llm.tokens import JOINT, SIGNS, PieceCache, WordEncoder, slices

# Text bytes per chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
# Chunks of a row group and of a partition of the join; either is held by one task.
GROUP_CHUNKS, TASK_CHUNKS = 2, 4
# Ids that are aligned at once; those of one piece always are.
ALIGN_IDS = 1 << 19
# Bytes of each half of the cache of pieces.
CACHE_BYTES = 40 << 20
# Behind a token: another of its side follows, the last of A's, the last of the group.
SEPARATORS = [",", "|", ";"]
# An id pair is one number: A's id times this, plus B's id.
PAIR_BASE = 1 << 20
# A piece of B's vocabulary in which a text would be cut.
CROSSING = re.compile(r".[ \n]|\n.|[^\W_][.,]", re.DOTALL)


def byte_level_bytes(tokenizer) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    byte_of = {chr(sign): byte for byte, sign in SIGNS.items()}
    added = tokenizer.get_added_tokens_decoder()
    entries = (tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size()))
    return [e.encode() if i in added else bytes(byte_of[c] for c in e or "") for i, e in enumerate(entries)]


def piece_bytes(processor) -> list[bytes]:
    """Bytes of each id of a piece vocabulary: U+2581 is a space, byte pieces are their byte."""
    pieces = ((i, processor.id_to_piece(i)) for i in range(processor.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]


class TokenPair(PieceCache):
    """Both tokenizers with their ids' bytes and decimal forms; lives as long as the Python worker.

    The entry of a piece is the number of A's ids, these ids and B's. It is empty where the tokens of A or B
    do not join to the piece. A's vocabulary holds all bytes and nothing is normalised, so of A's joined
    bytes the length is compared; B's are compared in full.
    """

    def __init__(self, a: str, b: str):
        import sentencepiece

        super().__init__(CACHE_BYTES)
        self.a, self.b = WordEncoder(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a_bytes, self.b_bytes = byte_level_bytes(self.a.tokenizer), piece_bytes(self.b)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # Each id in decimal with each separator behind it, those of B behind those of A.
        self.shown = np.array([f"{i}{s}".encode() for n in (len(self.a_bytes), len(self.b_bytes)) for i in range(n) for s in SEPARATORS], object)
        self.line = self.b.piece_to_id("<0x0A>")
        # Texts that B may encode across a cut; runs of blanks are never cut.
        plain = (x.decode() for i, x in enumerate(self.b_bytes) if not self.b.is_byte(i))
        self.crossing = "|".join(re.escape(x) for x in plain if x.strip(" ") and CROSSING.search(x))

    def _entry(self, want: bytes, a_ids: np.ndarray, b_ids: list[int]) -> bytes:
        if self.a_sizes[a_ids].sum() != len(want) or b"".join(map(self.b_bytes.__getitem__, b_ids)) != want:
            return b""
        return np.concatenate([[len(a_ids)], a_ids, b_ids]).astype("<u4").tobytes()

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """Entries of pieces; B meets them many to a text, behind line feeds, which are tokens of their own."""
        a_of, out = self.a._fresh(words), {}
        for at in range(0, len(words), JOINT):
            part = words[at : at + JOINT]
            b_ids = np.array(self.b.encode("\n" + "\n".join(w.removeprefix("\n") for w in part)), "<u4")
            cuts = np.flatnonzero(b_ids == self.line)
            if len(cuts) != len(part):
                out.update(dict.fromkeys(part, b""))
                continue
            raw, bounds = b_ids.tobytes(), (4 * np.append(cuts, len(b_ids))).tolist()
            # A line feed before a piece is the piece's own if it begins with one.
            b_raw = [raw[s if w[0] == "\n" else s + 4 : e] for w, s, e in zip(part, bounds, bounds[1:])]
            a_raw = [a_of[w] for w in part]
            want = [w.encode() for w in part]
            sizes = np.fromiter(map(len, want), np.int64, len(want))
            same = np.ones(len(part), bool)
            for some, of in ((a_raw, self.a_sizes), (b_raw, self.b_sizes)):
                ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some))) // 4
                joined = np.concatenate([[0], np.cumsum(of[np.frombuffer(b"".join(some), "<u4")])])[ends]
                same &= np.diff(joined, prepend=0) == sizes
            if not same.all() or b"".join(map(self.b_bytes.__getitem__, np.frombuffer(b"".join(b_raw), "<u4").tolist())) != b"".join(want):
                ids = ((np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4").tolist()) for x, y in zip(a_raw, b_raw))
                out.update((w, self._entry(x, *i)) for w, x, i in zip(part, want, ids))
            else:
                out.update((w, (len(x) // 4).to_bytes(4, "little") + x + y) for w, x, y in zip(part, a_raw, b_raw))
        return out

    def direct(self, texts: Sequence[str]) -> list[bytes]:
        """Entries of whole texts, to which A puts a space; an empty text has none."""
        a_raw = self.a.direct([" " + t for t in texts])
        each = zip(texts, a_raw, self.b.encode(list(texts), num_threads=1))
        return [self._entry((" " + t).encode(), np.frombuffer(x, "<u4"), y) if t else b"" for t, x, y in each]

    def encode_pieces(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Entries, the places in them of the texts' pieces one after the other, and each text's number of pieces."""
        column = pc.fill_null(texts, "")
        lists, spaced, whole = self.a.cut(pc.binary_join_element_wise(pa.scalar(" "), column, pa.scalar("")))
        pieces = lists.flatten().dictionary_encode()
        words = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        entries, at = self._ids(words), pieces.indices.to_numpy().astype(np.int64)
        each = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        alone = whole.to_numpy(zero_copy_only=False) | (pc.binary_length(column).to_numpy() == 0)
        if self.crossing:
            alone |= pc.match_substring_regex(spaced, self.crossing).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(each)), each)
        lacking = np.array([bool(w) and not e for w, e in zip(words, entries)], bool)
        alone[owner[lacking[at]]] = True
        if alone.any():
            # The first piece of such a text becomes the text, the others go.
            rows = np.flatnonzero(alone)
            kept = ~alone[owner]
            first = (np.cumsum(each) - each)[rows]
            kept[first] = True
            at[first] = len(entries) + np.arange(len(rows))
            entries = entries + self.direct(column.take(pa.array(rows)).to_pylist())
            at, each = at[kept], np.where(alone, 1, each)
        return entries, at, each


_PAIRS: dict[tuple[str, str], TokenPair] = {}


def token_pair(a: str, b: str) -> TokenPair:
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = TokenPair(a, b)
    return _PAIRS[a, b]


def diagonal_groups(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """Stops of all groups in the tokens of A and of B.

    ``ends_a`` and ``ends_b`` ascend strictly and share their last end; both are empty or neither is.
    """
    n, m = len(ends_a), len(ends_b)
    stops_a: list[int] = []
    stops_b: list[int] = []
    i = j = 0
    while i < n:
        if ends_a[i] == ends_b[j]:
            # Probe ahead at the shift j - i, in doubling steps and then in halving ones.
            # A window is compared as a whole only if its last ends are equal.
            x, y, step = i + 1, j + 1, 2
            while x + step <= n and y + step <= m and ends_a[x + step - 1] == ends_b[y + step - 1] and ends_a[x : x + step] == ends_b[y : y + step]:
                x, y, step = x + step, y + step, 2 * step
            while step > 1:
                step //= 2
                if x + step <= n and y + step <= m and ends_a[x + step - 1] == ends_b[y + step - 1] and ends_a[x : x + step] == ends_b[y : y + step]:
                    x, y = x + step, y + step
            if x == i + 1:
                stops_a.append(x)
                stops_b.append(y)
            else:
                stops_a.extend(range(i + 1, x + 1))
                stops_b.extend(range(j + 1, y + 1))
            i, j = x, y
            if i == n:
                break
        # An irregular group: on to the next common end.
        a, b = ends_a[i], ends_b[j]
        while a != b:
            if a < b:
                i += 1
                a = ends_a[i]
            else:
                j += 1
                b = ends_b[j]
        i, j = i + 1, j + 1
        stops_a.append(i)
        stops_b.append(j)
    return stops_a, stops_b


def _links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and B of all pairs that overlap: one pair behind each end of either side."""
    at = np.searchsorted(ends_a, ends_b)
    ends = np.sort(np.concatenate([ends_a, ends_b[ends_a[at] != ends_b]]), kind="stable")
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def _group_texts(pair: TokenPair, a_ids: np.ndarray, b_ids: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> list[bytes]:
    """All tokens in the order of the groups' text, each with the separator behind it."""
    size_a, size_b = np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
    codes = np.empty(len(a_ids) + len(b_ids), np.int64)
    behind = np.zeros(len(a_ids), np.int64)
    behind[stops_a - 1] = 1
    codes[np.arange(len(a_ids)) + np.repeat(stops_b - size_b, size_a)] = a_ids * len(SEPARATORS) + behind
    behind = np.zeros(len(b_ids), np.int64)
    behind[stops_b - 1] = 2
    codes[np.arange(len(b_ids)) + np.repeat(stops_a, size_b)] = (b_ids + len(pair.a_bytes)) * len(SEPARATORS) + behind
    return pair.shown[codes].tolist()


def align_entries(pair: TokenPair, entries: list[bytes]) -> dict:
    """Per entry ``n_a, n_b, n_groups, n_links``, and per link the id pair, entry by entry; ``groups`` are the groups' texts."""
    flat = np.frombuffer(b"".join(entries), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
    starts, held = np.cumsum(sizes) - sizes, sizes > 0
    n_a = np.zeros(len(entries), np.int64)
    n_a[held] = flat[starts[held]]
    n_b = np.where(held, sizes - 1 - n_a, 0)
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    of_b = place > np.repeat(n_a, sizes)
    a_ids, b_ids = flat[(place > 0) & ~of_b], flat[of_b]
    # Ends run on over all entries, whose own ends are common ends.
    ends_a, ends_b = np.cumsum(pair.a_sizes[a_ids]), np.cumsum(pair.b_sizes[b_ids])
    stops_a, stops_b = (np.array(x, np.int64) for x in diagonal_groups(ends_a.tolist(), ends_b.tolist()))
    shown = _group_texts(pair, a_ids, b_ids, stops_a, stops_b)
    tokens = [0, *np.cumsum(n_a + n_b).tolist()]
    left, right = _links(ends_a, ends_b) if len(a_ids) else (stops_a, stops_b)
    return {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": np.diff(np.searchsorted(stops_a, np.cumsum(n_a), "right"), prepend=0),
        "n_links": np.diff(np.searchsorted(left, np.cumsum(n_a)), prepend=0),
        "pairs": a_ids[left] * PAIR_BASE + b_ids[right],
        "groups": [b"".join(shown[s:e]) for s, e in zip(tokens, tokens[1:])],
    }


def align_texts(pair: TokenPair, texts: pa.Array) -> dict:
    """Per text ``n_a, n_b, n_groups, n_links, hashes`` (of the groups' text) and number of pieces ``n_pieces``.

    ``pieces`` are the texts' pieces as places in the distinct ones, ``piece_links`` the number of links of
    each distinct piece, ``pairs`` the id pair of each of these links.
    """
    entries, at, n_pieces = pair.encode_pieces(texts)
    stops, some, done = np.cumsum(n_pieces), [], 0
    ends = np.cumsum(np.fromiter(map(len, entries), np.int64, len(entries))) // 4
    while done < len(entries):
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + ALIGN_IDS, "right")))
        some.append(align_entries(pair, entries[done:to]))
        done = to
    groups = [g for found in some for g in found.pop("groups")]
    each = {name: np.concatenate([found[name] for found in some]) for name in some[0]}
    pairs = each.pop("pairs")
    parts = map(groups.__getitem__, at.tolist())
    joined = (b"".join(itertools.islice(parts, n)) for n in n_pieces.tolist())
    hashes = [hashlib.sha256(memoryview(x)[:-1]).hexdigest() if x else "" for x in joined]
    figures = {name: _sums(n[at], stops) for name, n in each.items()}
    return figures | {"hashes": hashes, "n_pieces": n_pieces, "pieces": at, "piece_links": each["n_links"], "pairs": pairs}


def _sums(values: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` that end at ``stops``."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[stops], prepend=0)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order; a sort takes less time than the hash table of ``np.unique``."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]]


def _holders(owner: np.ndarray, pieces: np.ndarray, piece_links: np.ndarray, links: np.ndarray, n_pairs: int) -> np.ndarray:
    """Number of texts that hold each pair linked."""
    held = _distinct(owner * max(1, len(piece_links)) + pieces)
    owner, pieces = held // max(1, len(piece_links)), held % max(1, len(piece_links))
    each = piece_links[pieces]
    first = np.cumsum(piece_links) - piece_links
    at = np.arange(each.sum()) + np.repeat(first[pieces] - (np.cumsum(each) - each), each)
    held = _distinct(np.repeat(owner, each) * max(1, n_pairs) + links[at])
    return np.bincount(held % max(1, n_pairs), minlength=n_pairs)


def _chunks(docs: DataFrame, a: str, b: str, text: str, doc: str) -> DataFrame:
    """One row per chunk of texts: its documents' figures and pieces, distinct pairs, and links as places in them."""
    key = docs.schema[doc].dataType.simpleString()
    counts, places = ["n_a", "n_b", "n_groups", "n_links"], ["n_pieces", "pieces", "piece_links", "links"]
    schema = f"chunk long, docs array<{key}>, {', '.join(f'{c} array<long>' for c in counts)}, hashes array<string>, pairs array<long>, holders array<long>, n_pieces binary, pieces binary, piece_links binary, links binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, chunk = token_pair(a, b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                if not part.num_rows:
                    continue
                found = align_texts(pair, part.column("text"))
                hashes = found.pop("hashes")
                pairs, found["links"] = np.unique(found["pairs"], return_inverse=True)
                owner = np.repeat(np.arange(part.num_rows), found["n_pieces"])
                holders = _holders(owner, found["pieces"], found["piece_links"], found["links"], len(pairs))
                lists = [part.column("doc"), *(pa.array(found[c], pa.int64()) for c in counts), pa.array(hashes, pa.string())]
                lists += [pa.array(pairs, pa.int64()), pa.array(holders, pa.int64())]
                columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                columns = [pa.array([chunk], pa.int64()), *columns, *(pa.array([found[c].astype("<u4").tobytes()], pa.binary()) for c in places)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "docs", *counts, "hashes", "pairs", "holders", *places])
                chunk += 1

    return docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def align(docs: DataFrame, *, a: str, b: str, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``.

    ``a`` is a byte-level BPE file, encoding a space and the text; ``b`` a piece model, encoding the text.
    A pair's count is the number of rows of ``docs`` that hold it linked. ``n_best`` counts the links
    whose count is the highest of their A id (ties included), ``count_sum`` adds the counts of all links.

    A text that is null, empty, or whose tokens of A or B do not join to a space and the text has no
    tokens: zeros and an empty hash. Rows that share an id, null included, are rows of their own. A very
    long text is a chunk of its own and held whole by one task. Other columns are not read.
    """
    key = docs.schema[doc].dataType.simpleString()
    chunks = written(_chunks(docs, a, b, text, doc), "aligned-chunks", codec="zstd", group_rows=GROUP_CHUNKS)
    # The join has as many partitions as its chunks need, however few partitions the session has.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chunks.count() // TASK_CHUNKS))
    held = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "p")).select("chunk", "place", "p.pairs", "p.holders")
    totals = held.groupBy("pairs").agg(F.sum("holders").alias("count"))
    # At most one row per id of B stands under an id of A.
    highest = F.max("count").over(W.partitionBy(F.floor(F.col("pairs") / PAIR_BASE)))
    totals = totals.withColumn("best", F.col("count") == highest)
    returned = held.drop("holders").join(totals, "pairs").repartition(parts, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("place", "count", "best")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n).slice(i, 1) for n in batch.schema.names}
                n_pieces, pieces, piece_links, links = (np.frombuffer(row[c][0].as_buffer(), "<u4") for c in ("n_pieces", "pieces", "piece_links", "links"))
                known = row["known"].flatten()
                place = known.field("place").to_numpy()
                count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                count[place] = known.field("count").to_numpy()
                best[place] = known.field("best").to_numpy(zero_copy_only=False)
                sums = [_sums(_sums(v[links], np.cumsum(piece_links, dtype=np.int64))[pieces], np.cumsum(n_pieces, dtype=np.int64)) for v in (best, count)]
                sums = [pa.array(s, pa.int64()) for s in sums]
                columns = [row[c].flatten() for c in ("docs", "n_a", "n_b", "n_groups", "n_links")] + sums + [row["hashes"].flatten()]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    joined = chunks.drop("pairs", "holders").repartition(parts, "chunk").join(returned, "chunk", "left")
    joined = joined.withColumn("known", F.coalesce("known", F.array().cast("array<struct<place:int,count:bigint,best:boolean>>")))
    return joined.mapInArrow(run, f"doc_id {key}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), a=_path("byte_bpe_50k.json"), b=_path("piece_bpe_32k.model"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLE: dict[str, str] = {}
