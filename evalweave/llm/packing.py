"""Packing by power-of-two decomposition: no padding, and no sequence crosses documents.

A document's ids fall into pieces of the longest sequence length and of the binary digits of the
rest. Each piece is one sequence; sequences of equal length stand together, so batches are uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalweave.llm.scratch import documents, scratch_path
from evalweave.llm.tokens import encoder, slices

SLICE_BYTES = 2 << 20


def decomposition(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: ``longest`` as often as it fits, then falling powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, *, tokenizer: str, end_id: int, text: str = "text", doc: str = "doc_id", longest: int = 4096) -> DataFrame:
    """One row per piece: ``doc_id, doc_tokens, start, length, ids`` (little-endian unsigned 32-bit).

    The ids of a text are followed by ``end_id``; a null or empty text is that id alone. Rows that
    share a document id, null included, are pieced one by one. ``longest`` is a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    key = docs.schema[doc].dataType
    schema = pa.schema([("doc_tokens", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                rows: tuple[list, ...] = ([], [], [], [], [])
                flat, stops = code.encode_column(part.column("text"))
                raw, begin = flat.tobytes(), 0
                for at, stop in enumerate((4 * stops).tolist()):
                    ids, begin = raw[begin:stop] + end, stop
                    n, start = len(ids) // 4, 0
                    for size in decomposition(n, longest):
                        for column, value in zip(rows, (at, n, start, size, ids[4 * start : 4 * (start + size)])):
                            column.append(value)
                        start += size
                keys = part.column("doc").take(pa.array(rows[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, f.type) for c, f in zip(rows[1:], schema)]], ["doc", *schema.names])

    out = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(
        run, f"doc {key.simpleString()}, doc_tokens long, start long, length long, ids binary"
    )
    return out.withColumnRenamed("doc", "doc_id")


def pack(docs: DataFrame, *, derive: dict[str, Column] | None = None, **options) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (always 0), read from the written sequences.

    The sequences are written once, sorted by length within each file, so a reader of one length
    skips the rest. Ids run from 0 without gaps, shortest length first, in file order. With ``derive``,
    columns computed from ``ids`` take its place.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "sequences")
    found = pieces(docs, **options).sortWithinPartitions("length")
    found.write.parquet(path)
    stored = spark.read.schema(found.schema).parquet(path).select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    )
    if derive:
        stored = stored.withColumns(derive).drop("ids")
    # One row per file and length; running totals of lengths, and of the files within a length.
    runs = stored.groupBy("length", "__file").agg(F.count("*").alias("__n"), F.min("__row").alias("__low"))
    lengths = runs.groupBy("length").agg(F.sum("__n").alias("__total"))
    bases = lengths.select("length", (F.sum("__total").over(W.orderBy("length")) - F.col("__total")).alias("__base"))
    within = F.sum("__n").over(W.partitionBy("length").orderBy("__file")) - F.col("__n")
    at = runs.withColumn("__within", within).join(bases, "length").select("length", "__file", (F.col("__base") + F.col("__within") - F.col("__low")).alias("__shift"))
    return (
        stored.join(at, ["length", "__file"])
        .withColumns({"sequence_id": (F.col("__row") + F.col("__shift")).cast("long"), "offset": F.lit(0).cast("long")})
        .drop("__file", "__row", "__shift")
    )


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_digest(docs: DataFrame) -> DataFrame:
    """The packing of the registered query and of the pipeline, with checksums in place of ids."""
    packed = pack(docs, derive={"ids_crc32": F.crc32("ids")}, tokenizer=_path("word_bpe_49k.json"), end_id=2)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(documents(spark, sf_dir))


QUERIES = {"op7_power_of_two_packing": op7_power_of_two_packing}
ORACLE: dict[str, str] = {}
