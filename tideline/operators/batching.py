"""Items into batches, and batches into upload groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_GROUP_BYTES = 250 * 1024
MAX_GROUP_COUNT = 10


def assign_batches(items: DataFrame, batch_size: int, pos: str = "pos") -> DataFrame:
    """Batch number and place of each item: position over batch size, the last batch short.

    Positions run on across the files of a job, so batches straddle files. They come from
    :mod:`tideline.operators.ordering`; this step needs no shuffle.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    return items.withColumn("batch_id", F.floor(F.col(pos) / batch_size).cast("long")).withColumn(
        "item_no", (F.col(pos) % batch_size).cast("int")
    )


def collect_batches(items: DataFrame, item: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per batch with its items in order; a group is at most ``batch_size`` items."""
    ordered = F.sort_array(F.collect_list(F.struct("item_no", F.col(item).alias("item"))))
    return items.groupBy(*keys, "batch_id").agg(F.transform(ordered, lambda s: s["item"]).alias("items"))


def batch_totals(items: DataFrame, batch_size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Number of items and batches per job; ``ceil(items / batch_size)``."""
    return (
        items.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_items"))
        .withColumn("n_batches", F.ceil(F.col("n_items") / batch_size).cast("long"))
    )


def _next_start(size: np.ndarray, max_bytes: int, max_count: int) -> np.ndarray:
    """For each place, where the group after the one that starts there begins."""
    padded = np.concatenate([size, np.full(max_count, max_bytes + 1, dtype=np.int64)])
    total = size.astype(np.int64).copy()
    taken = np.ones(len(size), dtype=np.int64)
    open_ = np.ones(len(size), dtype=bool)
    at = np.arange(len(size))
    for step in range(1, max_count):
        following = padded[at + step]
        open_ &= total + following <= max_bytes
        total = np.where(open_, total + following, total)
        taken += open_
    return at + taken


def pack(
    batches: DataFrame,
    job: str = "job_id",
    batch: str = "batch_id",
    size: str = "bytes",
    max_bytes: int = MAX_GROUP_BYTES,
    max_count: int = MAX_GROUP_COUNT,
    chunk: int = 20_000,
) -> DataFrame:
    """Greedy upload groups: in batch order, a group closes when the next body would pass
    ``max_bytes`` or the group holds ``max_count``. Adds ``group_id``; a single body above
    the limit raises. ``batch`` must count 0, 1, 2, ... within the job.

    A job is cut into chunks that are handled in parallel. Where a chunk's first group starts
    depends on the chunk before, but only among its first ``max_count`` places, so each chunk
    works out all of them (:func:`_hops`); chaining these small answers gives the true start
    of every chunk, from which the groups follow. The result equals the one-by-one fold.
    """
    rows = batches.select(
        F.col(job).alias("_job"), F.col(batch).cast("long").alias("_batch"), F.col(size).cast("long").alias("_size")
    ).withColumn("_chunk", F.floor(F.col("_batch") / chunk))
    message = F.concat(F.lit("message size "), F.col("_size").cast("string"), F.lit(f" exceeds {max_bytes}"))
    rows = rows.withColumn(
        "_size", F.when(F.col("_size") <= max_bytes, F.col("_size")).otherwise(F.raise_error(message).cast("long"))
    )
    job_type = batches.schema[job].dataType.simpleString()
    # Each chunk also sees the first rows of the next one, where its last group may end.
    shared = F.array_compact(
        F.array(
            F.col("_chunk"),
            F.when((F.col("_batch") % chunk < max_count) & (F.col("_chunk") > 0), F.col("_chunk") - 1),
        )
    )
    seen = rows.withColumn("_chunk", F.explode(shared))
    hops = seen.groupBy("_job", "_chunk").applyInPandas(
        _hops(chunk, max_bytes, max_count), f"_job {job_type}, _chunk long, entry int, exit int, groups long"
    )
    starts = (
        hops.groupBy("_job", "_chunk")
        .agg(F.map_from_entries(F.collect_list(F.struct("entry", F.struct("exit", "groups")))).alias("hops"))
        .repartition("_job")
        .sortWithinPartitions("_job", "_chunk")
        .mapInPandas(_chain, f"_job {job_type}, _chunk long, entry int, first_group long")
    )
    grouped = (
        seen.join(starts, ["_job", "_chunk"])
        .groupBy("_job", "_chunk")
        .applyInPandas(_number(chunk, max_bytes, max_count), f"_job {job_type}, _batch long, group_id long")
    )
    return batches.join(
        grouped.select(F.col("_job").alias(job), F.col("_batch").alias(batch), "group_id"), [job, batch]
    )


def _hops(chunk: int, max_bytes: int, max_count: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_batch")
        number = int(frame["_chunk"].iloc[0])
        after = _next_start(frame["_size"].to_numpy(), max_bytes, max_count)
        length = int((frame["_batch"] < (number + 1) * chunk).sum())
        exits = np.empty(length, dtype=np.int64)
        groups = np.empty(length, dtype=np.int64)
        for i in range(length - 1, -1, -1):
            j = after[i]
            if j >= length:
                exits[i], groups[i] = j - length, 1
            else:
                exits[i], groups[i] = exits[j], groups[j] + 1
        n = min(max_count, length)
        return pd.DataFrame(
            {
                "_job": frame["_job"].iloc[0],
                "_chunk": number,
                "entry": np.arange(n, dtype=np.int32),
                "exit": exits[:n].astype(np.int32),
                "groups": groups[:n],
            }
        )

    return run


def _chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follow the chunks of each job in order; one small row per chunk, constant memory."""
    job, entry, done = None, 0, 0
    for frame in frames:
        out = []
        for this, number, hops in zip(frame["_job"], frame["_chunk"], frame["hops"]):
            if this != job:
                job, entry, done = this, 0, 0
            out.append((this, number, entry, done))
            hop = dict(hops).get(entry)
            if hop is not None:
                entry, done = hop["exit"], done + hop["groups"]
            else:  # a last chunk shorter than the entry place: swallowed by the group before
                entry = 0
        yield pd.DataFrame(out, columns=["_job", "_chunk", "entry", "first_group"])


def _number(chunk: int, max_bytes: int, max_count: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_batch")
        number, entry = int(frame["_chunk"].iloc[0]), int(frame["entry"].iloc[0])
        after = _next_start(frame["_size"].to_numpy(), max_bytes, max_count)
        length = int((frame["_batch"] < (number + 1) * chunk).sum())
        starts = np.zeros(len(frame), dtype=np.int64)
        i = entry
        while i < length:
            starts[i] = 1
            i = after[i]
        group = int(frame["first_group"].iloc[0]) - 1 + np.cumsum(starts)
        return pd.DataFrame({"_job": frame["_job"], "_batch": frame["_batch"], "group_id": group}).iloc[:length]

    return run

