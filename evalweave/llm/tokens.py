"""Token ids of whole texts with a tokenizer file, piece by piece from a bounded cache.

Byte-level and word-level BPE never let a token cross from a visible character to a following blank,
nor from a letter to a following comma or full stop. So a text may be cut there: its ids are the ids
of its pieces, one after the other. A batch of texts is cut and its pieces are counted by Arrow, so
Python meets each distinct piece of a batch once; most of those come from a cache, the tokenizer sees
the others. Texts in which such a cut could matter (two blanks in a row, other white space, control
characters, a special token's string) go to the tokenizer whole.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Controls, white space other than space and line feed, combining marks that could join a blank, and
# runs of blanks.
IRREGULAR = (
    r"[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{300}-\x{36f}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"
    r"|[ \n][ \n]"
)
# A comma or full stop behind anything but a letter or digit belongs to the piece before it.
SYMBOL_STOP = r"(?:^|[^\pL\pN])[.,]"
CUT = "\x01"
# A sign that is a token of its own between pieces, and how to put it there: for tokenizers that keep
# line feeds, and for those that drop white space. The encoder tries them on each tokenizer.
SEPARATORS = [("\n", "\n"), ("7", " 7 ")]
JOINT = 2000
# A word that is one unit before the merges of either kind of tokenizer, whatever stands around it.
LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
# Signs that byte-level vocabularies write bytes with: visible Latin-1 ones are themselves, the others
# follow from 256 on.
VISIBLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
SIGNS = {b: b for b in VISIBLE} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in VISIBLE)}
# How words are written for the tokenizer's model: as they are, or in lower case without the blank.
WRITINGS = [lambda words: words, lambda words: [w.strip(" ").lower() for w in words]]
# Bytes of each of the cache's two halves, and what an entry takes besides its characters and ids.
CACHE_BYTES = 64 << 20
ENTRY_BYTES = 180


class PieceCache:
    """Ids of pieces of text (little-endian unsigned 32-bit bytes), the pieces met lately from a cache.

    The cache has two halves of ``cache_bytes`` each: when the newer half is full it becomes the older
    one, whose pieces are dropped unless they are met again. Pieces over a thousandth of a half are never
    kept. ``_fresh`` gives the ids of pieces that are not there.
    """

    def __init__(self, cache_bytes: int):
        self.cache_bytes = cache_bytes
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        raise NotImplementedError

    def direct(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of whole texts, without cutting."""
        raise NotImplementedError

    def _keep(self, entries: dict[str, bytes]) -> None:
        new, held, most = self.new, self.held, self.cache_bytes // 1000
        for word, ids in entries.items():
            size = len(word) + len(ids) + ENTRY_BYTES
            if size > most:
                continue
            held += size
            if held > self.cache_bytes:
                self.old, self.new = new, {}
                new, held = self.new, size
            new[word] = ids
        self.held = held

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct pieces; an empty one has none."""
        found = list(map(self.new.get, words))
        again: dict[str, bytes] = {}
        absent: list[int] = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            if (ids := self.old.get(words[i])) is None:
                absent.append(i)
            else:
                again[words[i]] = found[i] = ids
        fresh = self._fresh([w for i in absent if (w := words[i])])
        for i in absent:
            found[i] = fresh[words[i]] if words[i] else b""
        self._keep(again | fresh)
        return found

    def encode_cut(self, lists: pa.ListArray, text: pa.Array, whole: pa.BooleanArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (unsigned 32-bit), and each text's end in them.

        ``lists`` holds the pieces of each text; where ``whole`` is set, the text is encoded as it is.
        """
        pieces = lists.flatten().dictionary_encode()
        # NumPy makes the strings several times faster than ``to_pylist``, which wraps each of them first.
        ids = self._ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        table = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        at = pieces.indices.to_numpy()
        each = sizes[at]
        stop = np.concatenate([[0], np.cumsum(each)])
        flat = table[np.repeat((starts[at] - stop[:-1]).astype(np.int32), each) + np.arange(stop[-1], dtype=np.int32)]
        offsets = lists.offsets.to_numpy().astype(np.int64)
        ends = stop[offsets - offsets[0]][1:]
        rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(rows):
            parts = np.split(flat, ends[:-1])
            for row, raw in zip(rows.tolist(), self.direct(text.take(pa.array(rows)).to_pylist())):
                parts[row] = np.frombuffer(raw, "<u4")
            flat, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return flat, ends


class WordEncoder(PieceCache):
    """``encode(texts)`` gives the ids of each text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        super().__init__(cache_bytes)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([IRREGULAR, *(re.escape(t) for t in special)])
        self.separator = next((c for c in SEPARATORS if self._separates(*c)), None)
        words = [" abc", "Ef", " x", "unlikelyword", " Élan", "fiancée"]
        self.writing = next((w for w in WRITINGS if self._merged(words, w) == self.direct(words)), None)

    def _separates(self, sign: str, between: str) -> bool:
        """Whether pieces joined with ``between`` keep their ids, with one id for ``sign`` between them."""
        mark = self.direct([between.strip(" ")])[0]
        parts = [" abc", ",", " d", " Ef-g", "1", "."]
        return len(mark) == 4 and self.direct([between.join(parts)])[0] == mark.join(self.direct(parts))

    def _merged(self, words: list[str], writing) -> list[bytes]:
        """Ids of words (``LETTERS``) by the tokenizer's model alone."""
        signs = "\n".join(writing(words)).encode().decode("latin-1").translate(SIGNS)
        merge = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in merge(w)]).tobytes() for w in signs.split(chr(SIGNS[10]))]

    def direct(self, texts: Sequence[str]) -> list[bytes]:
        """The tokenizer's own ids, without cutting."""
        coded = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in coded]

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pieces by the tokenizer: words by its model, other pieces many to a text, with separators."""
        out: dict[str, bytes] = {}
        if self.writing and (plain := list(filter(LETTERS.fullmatch, words))):
            out.update(zip(plain, self._merged(plain, self.writing)))
            words = [w for w in words if w not in out]
        joint: list[str] = []
        if self.separator:
            sign, between = self.separator
            joint = [w for w in words if sign not in w and not w[-1].isspace()]
            mark = int.from_bytes(self.direct([between.strip(" ")])[0], "little")
        for at in range(0, len(joint), JOINT):
            part = joint[at : at + JOINT]
            raw = self.direct([between.join(part)])[0]
            cuts = np.flatnonzero(np.frombuffer(raw, "<u4") == mark)
            if len(cuts) == len(part) - 1:
                bounds = zip(part, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)])
                out.update((w, raw[a:b]) for w, a, b in bounds)
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self.direct(rest)))
        return out

    def cut(self, column: pa.Array) -> tuple[pa.ListArray, pa.Array, pa.BooleanArray]:
        """Pieces of each text, the texts, and which are not cut but encoded whole; of these one empty piece."""
        text = pc.fill_null(column, "")
        whole = pc.match_substring_regex(text, self.whole)
        cut = pc.if_else(whole, "", text)
        for blank in (" ", "\n"):
            cut = pc.replace_substring(cut, blank, CUT + blank)
        stops = cut
        for stop in (",", "."):
            stops = pc.replace_substring(stops, stop, CUT + stop)
        return pc.split_pattern(pc.if_else(pc.match_substring_regex(text, SYMBOL_STOP), cut, stops), CUT), text, whole

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (unsigned 32-bit), and each text's end in them.

        A null or empty text has no ids.
        """
        return self.encode_cut(*self.cut(column))

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; a null or empty one has none."""
        if not texts:
            return []
        flat, ends = self.encode_column(pa.array(texts, pa.string()))
        raw, stops = flat.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file; it and its bounded cache live as long as the Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def drop_encoders() -> None:
    """Frees what earlier tasks of this Python worker have left behind, for steps that encode nothing."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` holds at most ``most_bytes`` bytes, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to
