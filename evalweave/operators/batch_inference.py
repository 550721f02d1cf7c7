"""Batch inference over a job table with a caller's function."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT_FIELDS = ("text", "finish_reason", "model")
SCHEMA = (
    "job_id string, prompt_sha256 string, text string, finish_reason string, model string, error string, "
    "duration_seconds double"
)


def run_jobs(jobs: DataFrame, call: Callable[[str], dict[str, Any]], *, concurrency: int) -> DataFrame:
    """Call ``call(prompt)`` for each job on ``concurrency`` partitions.

    ``call`` returns a dict with ``text, finish_reason, model``. An exception becomes the row's
    ``error`` and never fails the job. The result is
    meant to be appended to the log (A3); a rerun then starts from the pending jobs (D2), so lost
    executors only repeat calls that were not yet logged.
    """

    columns = [line.strip().split() for line in SCHEMA.split(",")]
    arrow = pa.schema([(n, pa.float64() if t == "double" else pa.string()) for n, t in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for job in batch.to_pylist():
                start = time.monotonic()
                row: dict[str, Any] = {"job_id": job["job_id"], "prompt_sha256": job["prompt_sha256"]}
                try:
                    result = call(job["prompt"])
                    row.update({f: result.get(f) for f in RESULT_FIELDS})
                except Exception as exc:  # noqa: BLE001 - one failed call is one row
                    row["error"] = f"{type(exc).__name__}: {exc}"
                row["duration_seconds"] = round(time.monotonic() - start, 3)
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    keys = ["job_id", "prompt_sha256"]
    # Hash on the whole key, so that a job with many prompts does not end up in one partition.
    return jobs.select(*keys, "prompt").repartition(concurrency, *[F.col(k) for k in keys]).mapInArrow(run, SCHEMA)
