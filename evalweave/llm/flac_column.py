"""Media columns: FLAC streams as a column, decoded to PCM blocks with seekable sample offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import flac
from evalweave.llm.scratch import documents
from evalweave.llm.tokens import slices

SLICE_BYTES = 4 << 20
UNIT = 64


def payloads(docs: DataFrame, *, text: str = "text", unit: int = UNIT) -> DataFrame:
    """Adds ``n_bytes`` and ``payload``: UTF-8 bytes, padded with zeros to a positive multiple of ``unit``."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(raw).cast("long")
    size = F.greatest(F.ceil(n / unit) * unit, F.lit(unit))
    zeros = F.unhex(F.repeat(F.lit("00"), (size - n).cast("int")))
    return docs.withColumns({"n_bytes": n, "payload": F.concat(raw, zeros)})


def encode_media(df: DataFrame, *, payload: str = "payload", media: str = "media") -> DataFrame:
    """Replaces the binary column ``payload`` by its FLAC stream ``media``; other columns pass through.

    A null or empty payload gives a null stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, payload, SLICE_BYTES):
                raw = part.column(payload).to_pylist()
                coded = iter(flac.encode([r for r in raw if r]))
                at = part.schema.get_field_index(payload)
                yield part.set_column(at, payload, pa.array([next(coded) if r else None for r in raw], pa.binary()))

    return df.mapInArrow(run, df.schema).withColumnRenamed(payload, media)


def decode_media(df: DataFrame, *, media: str = "media") -> DataFrame:
    """Adds ``pcm``, ``blocks``, ``feature`` and ``media_error`` to a frame with FLAC streams.

    ``pcm`` holds unsigned 8-bit samples; ``blocks`` lists ``sample_offset, samples, frame_offset``, so a
    sample range maps to the frames that hold it. A stream that breaks the format or fails a
    checksum has a reason in ``media_error`` and nulls; a null stream has nulls only. ``feature``
    describes the samples: root mean square, sign changes and peak. Existing columns of these
    names are replaced.
    """
    added = "pcm binary, blocks array<struct<sample_offset:bigint,samples:bigint,frame_offset:bigint>>, feature string, media_error string"
    base = df.drop("pcm", "blocks", "feature", "media_error")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    triple = pa.list_(pa.struct([("sample_offset", pa.int64()), ("samples", pa.int64()), ("frame_offset", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media, SLICE_BYTES):
                columns: tuple[list, ...] = ([], [], [], [])
                for result in _decoded(part.column(media).to_pylist()):
                    for column, value in zip(columns, result):
                        column.append(value)
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), triple, pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, "pcm", "blocks", "feature", "media_error"])

    return base.mapInArrow(run, f"{kept}, {added}")


def _decoded(streams: list[bytes | None]) -> list[tuple]:
    """Results per stream; if a batch holds a broken stream, each is tried alone."""
    present = [s for s in streams if s is not None]
    try:
        done: list = list(flac.decode(present))
    except (flac.FlacError, IndexError):
        done = [_alone(s) for s in present]
    results = iter(done)
    return [(None,) * 4 if s is None else _row(next(results)) for s in streams]


def _alone(stream: bytes):
    try:
        return flac.decode([stream])[0]
    except (flac.FlacError, IndexError) as exc:
        return str(exc) or "broken stream"


def _row(result) -> tuple:
    if isinstance(result, str):
        return None, None, None, result
    pcm, blocks = result
    return pcm, [dict(zip(("sample_offset", "samples", "frame_offset"), b)) for b in blocks], feature(pcm), None


def feature(pcm: bytes) -> str:
    """Root mean square, share of sign changes and peak of the signed samples."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    if not len(x):
        return "rms=0.000;crossings=0.000;peak=0"
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"rms={np.sqrt(int((x * x).sum()) / len(x)):.3f};crossings={crossings / len(x):.3f};peak={int(np.abs(x).max())}"


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = encode_media(payloads(documents(spark, sf_dir)).select("doc_id", "n_bytes", "payload"))
    pcm = F.col("pcm")
    return decode_media(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length(pcm).cast("long").alias("payload_bytes"),
        F.sha2(pcm, 256).alias("payload_sha256"),
        F.crc32(F.substring(pcm, -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


QUERIES = {"op10_flac_media": op10_flac_media}
ORACLE: dict[str, str] = {}
