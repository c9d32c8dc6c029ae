"""Streaming request metrics, in-flight load and asynchronous request status.

The functions take a DataFrame with an event time of type timestamp and work on batches and
streams alike; late rows beyond the watermark are dropped by Spark and counted in its progress.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import ieee_div
from tideline.operators.asyncreq import STATUSES, classify_response, status_columns, status_from, status_of
from tideline.operators.timeseries import DEFAULT_BUCKETS, from_micros, histogram


def event_time(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with time zone; the session runs in UTC."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def request_metrics(
    events: DataFrame,
    window: str = "1 minute",
    delay: str = "1 minute",
    labels: Sequence[str] = ("status_code",),
    buckets: Sequence[float] = DEFAULT_BUCKETS,
) -> DataFrame:
    """Request count and cumulative latency histogram per status and tumbling window."""
    timed = event_time(events).withWatermark("ts", delay).withColumn("window", F.window("ts", window))
    return histogram(timed, ["window", *labels], "duration_s", buckets).select(
        F.col("window.start").alias("window_start"), *labels, "le", "bucket_count", "count", "sum"
    )


def in_flight_reports(samples: DataFrame, interval: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """Mean of the samples in each report interval, per API and pod."""
    timed = event_time(samples).withWatermark("ts", delay)
    return (
        timed.groupBy(F.window("ts", interval).alias("window"), "api_name", "pod")
        .agg(F.avg(F.col("value").cast("double")).alias("value"))
        .select(F.col("window.start").alias("ts"), "api_name", "pod", "value")
    )


def in_flight_load(
    samples: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", delay: str = "10 seconds"
) -> DataFrame:
    """Mean in-flight load per API over sliding windows: sums of all series over the largest count."""
    timed = event_time(samples).withWatermark("ts", delay)
    value = F.col("value").cast("double")
    series = timed.groupBy(F.window("ts", window, slide).alias("window"), "api_name", "pod").agg(
        F.sum(value).alias("s"), F.count(value).alias("n")
    )
    loads = series.groupBy("window", "api_name").agg(F.sum("s").alias("s"), F.max("n").alias("n"))
    return loads.select(
        F.col("window.end").alias("ts"), "api_name", ieee_div(F.col("s"), F.col("n")).alias("avg_in_flight")
    )


def async_status_updates(events: DataFrame, key: str = "request_id") -> DataFrame:
    """Current status of every request seen, for update mode. A status never moves backwards, since
    it is read off the set of markers so far. State is one small row per request: use the RocksDB
    state store for large streams."""
    found = events.groupBy(key).agg(*[c.alias(n) for n, c in status_columns(F.col("marker")).items()])
    status, invalid = status_from()
    return found.select(key, status.alias("status"), invalid.alias("invalid"))


#: Groups of requests whose state is kept together; a checkpoint holds on to it.
BUCKETS = 4096


def tracked_status(
    markers: DataFrame,
    key: str = "request_id",
    keep_s: float = 3600,
    delay_s: float = 600,
    abandon_s: float = 7 * 86400,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``key, ts, status, invalid, late``: changes of status on a stream of ``(key, ts, marker)``, with bounded state.

    As :func:`async_status_updates`, but a request is forgotten ``keep_s`` after its last marker once it has ended, and
    ``abandon_s`` after it if it never does, in event time. Rows are at most ``delay_s`` out of order; older
    ones Spark drops and counts (``numRowsDroppedByWatermark``). A request begins with its ``in_queue`` marker: markers
    without one for ``delay_s`` belong to a request that is forgotten already (or never was) and can't say how it
    stands. They come out as one row with ``late``, their number, and no status; other rows have ``late`` 0. A row without a key
    is a heartbeat that moves the watermark. A request's state is the set of its known markers and one more name. For update mode.

    Python is called per bucket of requests and micro-batch, not per request, which costs far more than its few markers. A call
    holds the tracked requests of a bucket; ``buckets`` must stay the same for a checkpoint.
    """
    timed = event_time(markers).withWatermark("ts", f"{delay_s} seconds").withColumn("us", F.unix_micros("ts"))
    kind = markers.schema[key].dataType.simpleString()
    # Heartbeats stay apart, so that no key stands beside nulls.
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")
    tracked = (
        timed.select(key, "ts", "us", "marker", bucket.alias("_bucket"))
        .groupBy("_bucket")
        .applyInPandasWithState(
            _track(key, keep_s, delay_s, abandon_s),
            f"`{key}` {kind}, us long, status string, invalid boolean, late long",
            f"name array<{kind}>, found array<int>, odd array<string>, n array<long>, last array<long>, told array<string>, due array<long>",
            "update",
            "EventTimeTimeout",
        )
    )
    # A group that tells nothing may come out as a row of nulls.
    told = tracked.filter(F.col(key).isNotNull())
    return told.select(key, from_micros(F.col("us")).alias("ts"), "status", "invalid", "late")


BITS = {name: 1 << i for i, name in enumerate(STATUSES)}
BEGUN, ENDED = BITS["in_queue"], BITS["completed"] | BITS["failed"]


def _track(key: str, keep_s: float, delay_s: float, abandon_s: float):
    columns = [key, "us", "status", "invalid", "late"]

    def due(found: int, last: int) -> int:
        wait_s = delay_s if not found & BEGUN else keep_s if found & ENDED else abandon_s
        return int(last / 1000 + wait_s * 1000)

    def advance(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if group[0] < 0:
            return
        now, out = state.getCurrentWatermarkMs(), []
        # By request: known markers, smallest other name, number, time of the last, status told, timer.
        held = {name: entry for name, *entry in zip(*state.get, strict=True)} if state.exists else {}

        def forget(name) -> None:
            found, _odd, n, last, _told, _timer = held.pop(name)
            if not found & BEGUN:
                out.append((name, last, None, None, n))

        fresh = set()
        for frame in () if state.hasTimedOut else frames:
            for name, marker, us in zip(*(frame[c].tolist() for c in (key, "marker", "us")), strict=True):
                if name not in fresh:
                    fresh.add(name)
                    # What is due is looked at before a request's new rows.
                    if name in held and due(held[name][0], held[name][3]) <= now:
                        forget(name)
                    held.setdefault(name, [0, None, 0, 0, None, 0])
                if marker is None:
                    continue
                entry = held[name]
                entry[2], entry[3] = entry[2] + 1, max(entry[3], int(us))
                if marker in BITS:
                    entry[0] |= BITS[marker]
                else:
                    entry[1] = marker if entry[1] is None else min(entry[1], marker)
        for name in [name for name, entry in held.items() if name not in fresh and entry[5] < now]:
            forget(name)
        for name in fresh:
            entry = held[name]
            found, odd, _n, last, told, _timer = entry
            if found & BEGUN:
                status, invalid = status_of([s for s, bit in BITS.items() if found & bit], odd)
                if told != f"{status}":
                    out.append((name, last, status, invalid, 0))
                    entry[4] = f"{status}"
            entry[5] = max(due(found, last), now + 1)
        if held:
            state.update((list(held), *map(list, zip(*held.values(), strict=True))))
            state.setTimeoutTimestamp(max(min(entry[5] for entry in held.values()), now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=columns)

    return advance


def response_markers(responses: DataFrame, *keys: str) -> DataFrame:
    """Terminal markers from handler responses: ``completed`` only if the response checks out. ``keys`` stay, request_id at least."""
    checked = classify_response(responses)
    return checked.select(*(keys or ["request_id"]), F.when(F.col("reason") == "ok", "completed").otherwise("failed").alias("marker"))


def once_only(messages: DataFrame, key: str = "message_id", delay: str = "1 hour") -> DataFrame:
    """Each message id once within the watermark."""
    return event_time(messages).withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
