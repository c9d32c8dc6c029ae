"""Batch and result tables; job states are in :mod:`tideline.sources.states`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tideline.session import materialise


def write_batches(batches: DataFrame, path: str, partition_by: Sequence[str] = ("api_name",)) -> int:
    """Append batches as parquet and return how many were written.

    Folders follow a column of few values, never the job id, whose number grows with the data.
    The count is observed during the write; the batches are not read a second time.
    """
    seen = Observation()
    (
        batches.observe(seen, F.count(F.lit(1)).alias("n_batches"))
        .write.mode("append")
        .partitionBy(*partition_by)
        .parquet(path)
    )
    return seen.get["n_batches"]


def write_results(results: DataFrame, path: str, job: str = "job_id", batch: str = "batch_id") -> None:
    """Batch results as JSON lines under ``<path>/batches`` and merged by job under ``<path>/merged``.

    Merged files hold whole results sorted by job and batch. Ranges over both columns may split a
    large job over several neighbouring files, so no task gathers a whole job.
    """
    kept = materialise(results, "results")
    kept.write.mode("overwrite").json(f"{path}/batches")
    (
        kept.repartitionByRange(job, batch)
        .sortWithinPartitions(job, batch)
        .write.mode("overwrite")
        .json(f"{path}/merged")
    )
