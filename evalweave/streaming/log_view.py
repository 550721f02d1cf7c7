"""Incremental latest-status view of an append-only log.

A file-source stream reads new log segments; one row of state per key holds the latest values.
The log has no event time, so no watermark applies: state is bounded by the number of keys. For a
key space too large for state, ``upsert_stream`` keeps the view in Parquet instead and each batch
only merges its own keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = ("job_id", "prompt_sha256")


def read_log_stream(
    spark: SparkSession, path: str, schema: StructType, *, fmt: str = "json", files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def _keyed(log: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Rows with every key part present."""
    for k in keys:
        log = log.filter(F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    return log


def latest_view(log: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = KEY) -> DataFrame:
    """Latest ``columns`` per key. Works on a stream (update or complete mode) and on a batch."""
    agg = _keyed(log, keys).groupBy(*keys).agg(
        F.max_by(F.struct(*columns), "seq").alias("latest"), F.max("seq").alias("seq"), F.count("*").alias("n_rows")
    )
    return agg.select(*keys, "seq", "n_rows", "latest.*")


# -- the view in files ------------------------------------------------------------------------------

BUCKET_KEYS = 1_000_000
MANIFEST = "batch long, buckets long, bucket long, home string, slot int, n_rows long, retired array<string>"


def _not_found(fault: AnalysisException) -> bool:
    return fault.getCondition() == "PATH_NOT_FOUND"


def _manifest(spark: SparkSession, view_path: str, before: int | None) -> tuple[list[Row], int]:
    """Rows of the newest manifest (of a batch below ``before``), and the folder to write the next one to.

    There are two folders; the next manifest replaces the older one.
    """
    found: list[list[Row]] = []
    for folder in (0, 1):
        try:
            rows = spark.read.schema(MANIFEST).json(f"{view_path}/manifest-{folder}").collect()  # one row per bucket
        except AnalysisException as fault:
            if not _not_found(fault):
                raise
            rows = []
        found.append(rows if rows and (before is None or rows[0].batch < before) else [])
    newest = max((0, 1), key=lambda f: found[f][0].batch if found[f] else -1)
    return found[newest], 1 - newest


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("long")


def _current(spark: SparkSession, view_path: str, manifest: Sequence[Row], keys: Sequence[str], schema: StructType) -> DataFrame | None:
    """The rows of the buckets in ``manifest``; no other file is opened."""
    held = [m for m in manifest if m.n_rows]
    if not held:
        return None
    paths = sorted({f"{view_path}/slot-{m.slot}/home={m.home}" for m in held})
    # A bucket that was split and not touched since still lies in its parent's files, beside former
    # rows of buckets that have files of their own by now.
    place = lambda part: F.regexp_extract("_metadata.file_path", r"/slot-(\d)/home=([^/]*)/[^/]*$", part)
    rows = spark.read.schema(schema).parquet(*paths).select("*", place(1).cast("int").alias("__slot"), place(2).alias("__home"))
    wanted = spark.createDataFrame([(m.bucket, m.home, m.slot) for m in held], "__bucket long, __home string, __slot int")
    on = ["__bucket", "__home", "__slot"]
    return rows.withColumn("__bucket", _bucket(keys, held[0].buckets)).join(wanted, on, "left_semi").drop(*on)


def _latest(rows: DataFrame, keys: Sequence[str], *also: str) -> DataFrame:
    """One row per key: the highest ``seq``; of repeated rows the greatest by value."""
    rest = [c for c in rows.columns if c not in {*keys, *also, "seq"}]
    order = W.partitionBy(*also, *keys).orderBy(F.desc("seq"), *[F.desc(c) for c in rest])
    return rows.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def merge_batch(batch: DataFrame, batch_id: int, view_path: str, *, keys: Sequence[str] = KEY, bucket_keys: int = BUCKET_KEYS) -> None:
    """Brings one micro-batch into the view, see ``upsert_stream``."""
    spark, schema = batch.sparkSession, batch.schema
    manifest, folder = _manifest(spark, view_path, batch_id)
    fresh = _latest(batch, keys)
    fresh.persist()
    try:
        total = sum(m.n_rows for m in manifest) or fresh.count()
        buckets = first = manifest[0].buckets if manifest else 1
        while buckets * bucket_keys < total:
            buckets *= 2
        # After a doubling, bucket b's rows lie in those of b modulo the former number.
        entries = {b: m for m in manifest for b in range(m.bucket, buckets, first)}
        share = lambda n: -(-n * first // buckets)
        entries = {b: Row(batch=batch_id, buckets=buckets, bucket=b, home=m.home, slot=m.slot, n_rows=share(m.n_rows)) for b, m in entries.items()}
        named = F.concat(F.lit(f"{buckets}-"), F.col("__bucket").cast("string"))
        fresh = fresh.withColumn("__bucket", _bucket(keys, buckets))
        touched = {r[0] for r in fresh.select("__bucket").distinct().collect()}  # bucket numbers
        written = {}
        for slot in (0, 1):
            # Buckets whose current files lie in the other slot, so no file is read and replaced at once.
            mine = [b for b in touched if (1 - entries[b].slot if b in entries else 0) == slot]
            if not mine:
                continue
            here = spark.createDataFrame([(b,) for b in mine], "__bucket long")
            rows = fresh.join(here, "__bucket", "left_semi")
            old = _current(spark, view_path, [entries[b] for b in mine if b in entries], keys, schema)
            if old is not None:
                rows = rows.unionByName(old.withColumn("__bucket", _bucket(keys, buckets)))
            merged = _latest(rows.repartition("__bucket"), keys, "__bucket").withColumn("home", named)
            merged.drop("__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("home").parquet(f"{view_path}/slot-{slot}")
            for b in mine:
                written[b] = (f"{buckets}-{b}", slot)
        for slot in (0, 1):
            paths = {b: f"{view_path}/slot-{slot}/home={h}" for b, (h, s) in written.items() if s == slot}
            if paths:
                sizes = spark.read.schema(schema).parquet(*paths.values()).withColumn("__bucket", _bucket(keys, buckets)).groupBy("__bucket").count()
                for r in sizes.collect():  # one row per touched bucket
                    home, at = written[r[0]]
                    entries[r[0]] = Row(batch=batch_id, buckets=buckets, bucket=r[0], home=home, slot=at, n_rows=r[1])
    finally:
        fresh.unpersist()
    live = {m.home for m in entries.values()}
    retired = sorted({m.home for m in manifest} - live)
    out = [(*(m[c] for c in ("batch", "buckets", "bucket", "home", "slot", "n_rows")), retired) for m in entries.values()]
    if out:
        spark.createDataFrame(out, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{view_path}/manifest-{folder}")
    for home in manifest[0].retired if manifest else []:  # named neither by the last manifest nor by this one
        for slot in (0, 1):
            path = f"{view_path}/slot-{slot}/home={home}"
            if home not in live and _has_rows(spark, path, schema):
                spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def upsert_stream(
    log: DataFrame, view_path: str, checkpoint: str, *, keys: Sequence[str] = KEY, bucket_keys: int = BUCKET_KEYS
):
    """Keep the latest row per key under ``view_path``, in buckets of about ``bucket_keys`` keys.

    A manifest (one row per bucket) names the files of each bucket. A micro-batch opens only the
    current files of the buckets its keys fall into, merges by highest ``seq`` and writes them anew
    to the other one of two slots, which replaces the version before the last; then the manifest
    follows. A batch that is run again starts from the manifest before it, whose files are all
    there, so the result does not change. When the keys outgrow the buckets, their number doubles:
    a bucket that has not been touched since stays in its parent's files. Files that no manifest
    names any more are emptied one batch later. Repeated log rows give one row.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, view_path, keys=keys, bucket_keys=bucket_keys)

    return (
        _keyed(log, keys).writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _has_rows(spark: SparkSession, path: str, schema: StructType) -> bool:
    try:
        return not spark.read.schema(schema).parquet(path).isEmpty()
    except AnalysisException as fault:
        if not _not_found(fault):
            raise
        return False


def current_view(spark: SparkSession, view_path: str, schema: StructType, *, keys: Sequence[str] = KEY) -> DataFrame:
    """The view's rows, read from the files that the newest manifest names."""
    manifest, _ = _manifest(spark, view_path, None)
    rows = _current(spark, view_path, manifest, keys, schema)
    return spark.createDataFrame([], schema) if rows is None else rows
