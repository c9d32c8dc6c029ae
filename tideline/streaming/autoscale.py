"""The autoscaling fold over a stream of ticks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.autoscale import Decision, with_spec
from tideline.operators.timeseries import from_micros

OUTPUT = "api_name string, ts_us long, current int, recommendation int, request int"
STATE = "current int, started long, ts array<long>, recs array<int>, waiting string"


def stream_decisions(ticks: DataFrame, specs: DataFrame | None = None, delay: str = "1 minute") -> DataFrame:
    """As ``decide``, on a stream whose ticks come at most ``delay`` out of order.

    Ticks wait in the state of their API until the watermark passes them and are then folded in time order, one per
    instant, so the decisions are those of the batch form. Ticks later than that are dropped and counted by Spark
    (``numRowsDroppedByWatermark``). The last ``delay`` is decided when later ticks move the watermark; a row without
    an API is a heartbeat that does just this. State per API: current replicas, first tick, the recommendations of
    the longer stabilisation period, and the ticks of one delay.
    """
    events = with_spec(ticks, specs)
    if "init_replicas" not in events.columns:
        events = events.withColumn("init_replicas", F.col("min_replicas"))
    events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    events = events.withColumn("ts_us", F.unix_micros("ts"))
    folded = events.groupBy("api_name").applyInPandasWithState(_advance, OUTPUT, STATE, "append", "EventTimeTimeout")
    return folded.select("api_name", from_micros(F.col("ts_us")).alias("ts"), "current", "recommendation", "request")


def _advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    if key[0] is None:
        return
    if state.exists:
        current, started, ts, recs, held = state.get
        fold, waiting = Decision(current, started, zip(ts, recs)), {int(r["ts_us"]): r for r in json.loads(held)}
    else:
        fold, waiting = None, {}
    if not state.hasTimedOut:
        for frame in frames:
            for row in frame.drop(columns=["api_name", "ts"]).to_dict("records"):
                plain = {n: None if pd.isna(v) else v.item() if hasattr(v, "item") else v for n, v in row.items()}
                waiting.setdefault(int(row["ts_us"]), plain)
    passed = state.getCurrentWatermarkMs() * 1000
    out = []
    for now in sorted(t for t in waiting if t <= passed):
        row = waiting.pop(now)
        if fold is None:
            fold = Decision(int(row["init_replicas"]))
        before = fold.current
        decided = fold.tick(now, float("nan") if row["avg_in_flight"] is None else row["avg_in_flight"], row)
        if decided is not None:
            out.append((key[0], now, before, *decided))
    later = json.dumps([waiting[t] for t in sorted(waiting)])
    if fold is None:
        first = waiting[min(waiting)]
        state.update((int(first["init_replicas"]), None, [], [], later))
    else:
        state.update((fold.current, fold.started, [int(t) for t, _ in fold.recs], [int(r) for _, r in fold.recs], later))
    if waiting:
        state.setTimeoutTimestamp(min(waiting) // 1000 + 1)
    yield pd.DataFrame(out, columns=["api_name", "ts_us", "current", "recommendation", "request"])
