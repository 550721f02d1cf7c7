"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A document's terms are trigrams of character shapes and repeats of the word before. A bounded,
balanced sample of labelled documents gives the space (singular vectors of weighted term counts)
and the neighbours; their vectors are broadcast, and every document takes exact cosines with all of
them, block by block. Neighbours vote with weights that grow with the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.scratch import documents
from evalweave.llm.tokens import drop_encoders, slices

TERMS = 1024
REPEAT_WEIGHT = 2.0
SLICE_BYTES = 2 << 20
STEP = 1 << 20
ROWS = 512


def _shapes() -> np.ndarray:
    """Blank, upper case, letter, digit, line feed, and each other ASCII sign for itself."""
    shape = np.full(256, 2, np.int64)
    for code in range(128):
        sign = chr(code)
        if sign.isupper():
            shape[code] = 1
        elif sign.isdigit():
            shape[code] = 3
        elif sign == "\n":
            shape[code] = 4
        elif sign.isspace():
            shape[code] = 0
        elif not sign.isalpha():
            shape[code] = 5 + code
    return shape


SHAPES = _shapes()


BLANK = (SHAPES == 0) | (SHAPES == 4) | (np.arange(256) == 0)


def _to_blank(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that holds a blank, or the end."""
    while at < len(data):
        found = np.flatnonzero(BLANK[data[at : at + 4096]])
        if len(found):
            return at + int(found[0])
        at += 4096
    return len(data)


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number, modulo 2**64."""
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, 0x9E3779B97F4A7C15, np.uint64)]), dtype=np.uint64)


def term_vectors(texts: list[bytes]) -> np.ndarray:
    """Rows of unit length: square roots of hashed shape trigram counts, then the share of repeats."""
    out = np.zeros((len(texts), TERMS + 2), np.float32)
    data = np.frombuffer(b"".join(t + b"\0\0\0\0\0\0\0\0" for t in texts), np.uint8)
    sizes = np.array([len(t) + 8 for t in texts])
    starts = np.cumsum(sizes) - sizes
    counts = np.zeros(len(texts) * TERMS, np.int64)
    repeats, words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    last_word, last_doc = np.uint64(0), -1
    at = 0
    while at < len(data):
        # A step ends in front of a blank, so no word is cut. Two bytes of the next step follow, so that no
        # trigram is lost between steps.
        n = _to_blank(data, at + STEP) - at
        part = data[at : at + n + 2]
        doc = np.searchsorted(starts, np.arange(at, at + n), "right") - 1
        shape = SHAPES[part]
        whole = np.arange(at, at + n) - starts[doc] < sizes[doc] - 10
        m = min(n, len(part) - 2)
        code = (shape[:m] * 140 + shape[1 : m + 1]) * 140 + shape[2 : m + 2]
        bucket = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
        keep = whole[:m]
        counts += np.bincount(doc[:m][keep] * TERMS + bucket[keep], minlength=len(counts))
        blank = BLANK[part[:n]]
        before = np.concatenate([[at == 0 or BLANK[data[at - 1]]], blank[:-1]])
        first = np.flatnonzero(~blank & before)
        if len(first):
            # A word's hash: a polynomial in its bytes, all of them.
            place = np.arange(n)
            inside = place - np.maximum.accumulate(np.where(~blank & before, place, 0))
            value = np.where(blank, np.uint64(0), (part[:n].astype(np.uint64) + np.uint64(1)) * _powers(int(inside[~blank].max()) + 1)[np.where(blank, 0, inside)])
            word = np.add.reduceat(value, first)
            owner = doc[first]
            same = (word == np.concatenate([[last_word], word[:-1]])) & (owner == np.concatenate([[last_doc], owner[:-1]]))
            repeats += np.bincount(owner[same], minlength=len(texts))
            words += np.bincount(owner, minlength=len(texts))
            last_word, last_doc = word[-1], owner[-1]
        at += n
    hist = np.sqrt(counts.reshape(len(texts), TERMS))
    norm = np.linalg.norm(hist, axis=1, keepdims=True)
    out[:, :TERMS] = hist / np.maximum(norm, 1)
    share = repeats / np.maximum(words - 1, 1)
    out[:, TERMS], out[:, TERMS + 1] = share * REPEAT_WEIGHT, (1 - share) * REPEAT_WEIGHT
    return out


@dataclass
class Neighbours:
    """The latent space and the labelled vectors in it."""

    mean: np.ndarray
    axes: np.ndarray  # (terms, dimensions)
    vectors: np.ndarray  # (labelled, dimensions), unit rows
    labels: np.ndarray

    def project(self, terms: np.ndarray) -> np.ndarray:
        latent = (terms - self.mean) @ self.axes
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def scores(self, terms: np.ndarray, k: int, power: float) -> np.ndarray:
        """Weighted share of label 1 among the ``k`` nearest; 0.5 without any neighbour."""
        out = np.full(len(terms), 0.5)
        k = min(k, len(self.labels))
        if not k:
            return out
        for at in range(0, len(terms), ROWS):
            cosine = self.project(terms[at : at + ROWS]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-9) ** power
            out[at : at + ROWS] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.round(out, 6)


def _term_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_encoders()
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            terms = term_vectors([(t or "").encode() for t in part.column("text").to_pylist()])
            rows = pa.array([row.tobytes() for row in terms], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("label"), rows], ["doc", "label", "terms"])


def fit(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc: str = "doc_id", label: str = "label", max_per_class: int = 2000, dimensions: int = 48
) -> Neighbours:
    """The space and neighbours of at most ``max_per_class`` labelled documents of each label.

    The sample takes the ids of the smallest hash, so it does not depend on partitioning. Of several
    labels of one id the smallest counts; of several texts of one id the one of the smallest hash.
    Rows without id or label are not used. Only the sample's term vectors reach the driver.
    """
    known = labels.where(F.col(doc).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc).alias("doc")).agg(F.min(label).cast("int").alias("label"))
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc"), "doc").limit(max_per_class) for v in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    # The sample is bounded by max_per_class, so it may be broadcast.
    rows = (
        texts.join(F.broadcast(sample), "doc")
        .select("doc", "label", "text")
        .mapInArrow(_term_column, f"doc {docs.schema[doc].dataType.simpleString()}, label int, terms binary")
        .groupBy("doc")
        .agg(F.min(F.struct(F.xxhash64("terms"), "terms", "label")).alias("row"))
        .orderBy("doc")
        .collect()
    )
    if not rows:
        return Neighbours(np.zeros(TERMS + 2, np.float32), np.zeros((TERMS + 2, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    terms = np.stack([np.frombuffer(r.row.terms, np.float32) for r in rows]).astype(np.float64)
    mean = terms.mean(0)
    values, vectors = np.linalg.eigh((terms - mean).T @ (terms - mean))
    axes = vectors[:, np.argsort(-values)[:dimensions]]
    model = Neighbours(mean.astype(np.float32), axes.astype(np.float32), np.zeros((0, 1), np.float32), np.array([r.row.label for r in rows]))
    model.vectors = model.project(terms.astype(np.float32))
    return model


def score(docs: DataFrame, model: Neighbours, *, text: str = "text", out: str = "score", neighbours: int = 25, power: float = 8.0) -> DataFrame:
    """``docs`` with a column ``out``: 0 to 1, higher where label 1 is likelier.

    Null and empty texts are scored as texts without terms. Repeated rows get equal scores; of neighbours
    that are equally near at the border any may vote. A very long text is counted step by step in one task.
    A column named ``out`` is replaced, others pass through, whatever their names. Without documents the
    result is empty.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out])
    names = base.columns
    at = f"c{names.index(text)}"
    base = base.toDF(*[f"c{i}" for i in range(len(names))])  # names with dots do not pass mapInArrow
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        for batch in batches:
            for part in slices(batch, at, SLICE_BYTES):
                terms = term_vectors([(t or "").encode() for t in part.column(at).to_pylist()])
                values = shared.value.scores(terms, neighbours, power)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], [*part.schema.names, "score"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{kept}, score double").toDF(*names, out)


def held_out(doc: str = "doc_id"):
    """Whether an id's label is kept from training; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame) -> Neighbours:
    """The model of the registered query and of the pipeline."""
    return fit(docs, labels.where(~held_out()).withColumnRenamed("quality", "label"))


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, fit_quality(docs, documents(spark, sf_dir, "labels").select("doc_id", "quality")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_quality_knn": op2_quality_knn}
ORACLE: dict[str, str] = {}
