"""Token ids in binary files: Simple-8b words in blocks, with offsets of documents.

The file format: Parquet files whose rows are blocks of whole documents in ascending id. A block has
``part, block`` (its place in the order), ``doc_ids``, ``id_ends`` and ``word_ends`` (per document,
cumulative, little-endian unsigned 32-bit) and ``words`` (little-endian 64-bit Simple-8b words). Parquet
brings atomic commits, splits and column pruning on any file system that Spark reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalweave.llm import simple8b
from evalweave.llm.packing import _path
from evalweave.llm.scratch import documents, scratch_path
from evalweave.llm.tokens import encoder, slices

# Text bytes per block; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20


def write_ids(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 0, text: str = "text", doc: str = "doc_id") -> None:
    """Writes the ids of all documents, each followed by ``end_id``, in ascending order of ``doc``.

    A null or empty text is the end id alone. A null id comes first; rows that share an id stand in
    the order of their texts. Other columns are not stored.
    """
    key = docs.schema[doc].dataType
    blocks = f"part int, block int, doc_ids array<{key.simpleString()}>, id_ends binary, word_ends binary, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, block = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text", BLOCK_BYTES):
                ids, ends = code.encode_column(rows.column("text"))
                ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, rows.num_rows + 1)
                words, word_ends = simple8b.pack(ids, ends)
                lists = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("doc"))
                binary = [pa.array([x], pa.binary()) for x in (ends.astype("<u4").tobytes(), word_ends.astype("<u4").tobytes(), words.tobytes())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([block], pa.int32()), lists, *binary],
                    ["part", "block", "doc_ids", "id_ends", "word_ends", "words"],
                )
                block += 1

    ordered = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).repartitionByRange(F.col("doc")).sortWithinPartitions("doc", "text")
    ordered.mapInArrow(run, blocks).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of written files; ``start`` counts the ids of all documents before."""
    stored = spark.read.parquet(path)
    key = stored.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ends = np.frombuffer(batch.column("id_ends")[i].as_py(), "<u4").astype(np.int64)
                ids = simple8b.unpack(np.frombuffer(batch.column("words")[i].as_py(), "<u8")).astype("<u4")
                starts = np.concatenate([[0], ends[:-1]])
                keys = batch.column("doc_ids")[i].values
                base = pa.array(starts + batch.column("before")[i].as_py(), pa.int64())
                offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32).tobytes())
                column = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([keys, base, pa.array(ends - starts, pa.int64()), column], ["doc_id", "start", "n_tokens", "ids"])

    # Ids per block, then running totals within a part and over the parts.
    last = F.substring("id_ends", -4, 4)
    n = sum((F.conv(F.substring(F.hex(last), 2 * i + 1, 2), 16, 10).cast("long") * (1 << (8 * i)) for i in range(4)), F.lit(0).cast("long"))
    sizes = stored.select("part", "block", n.alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    over = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    inside = sizes.select("part", "block", (F.sum("n").over(W.partitionBy("part").orderBy("block")) - F.col("n")).alias("inside"))
    before = inside.join(over, "part").select("part", "block", (F.col("inside") + F.col("base")).alias("before"))
    located = stored.join(before, ["part", "block"]).select("before", "doc_ids", "id_ends", "words")
    return located.mapInArrow(run, f"doc_id {key.simpleString()}, start long, n_tokens long, ids binary")


def op6_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    write_ids(documents(spark, sf_dir), path, tokenizer=_path("byte_bpe_50k.json"))
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op6_simple8b_ids": op6_simple8b_ids}
ORACLE: dict[str, str] = {}
