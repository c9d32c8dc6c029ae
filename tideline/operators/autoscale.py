"""Autoscaling: recommendations from load, stabilisation, and the decision fold."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.timeseries import MICROS, from_micros, micros, with_context

# Defaults of an autoscaling spec.
DEFAULTS = {
    "min_replicas": 1,
    "max_replicas": 100,
    "target_in_flight": 1.0,
    "max_downscale_factor": 0.75,
    "max_upscale_factor": 1.5,
    "downscale_tolerance": 0.05,
    "upscale_tolerance": 0.05,
    "downscale_stabilization_s": 300.0,
    "upscale_stabilization_s": 60.0,
}
TICK_S = 10


def with_spec(ticks: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """Ticks with the spec of their API (one row per API); missing settings take the defaults."""
    if specs is not None:
        ticks = ticks.join(specs, "api_name", "left")
    return ticks.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value)) if name in ticks.columns else F.lit(value)
            for name, value in DEFAULTS.items()
        }
    )


def recommend(ticks: DataFrame, current: str = "current") -> DataFrame:
    """Recommended replicas for each row of :func:`with_spec`; rows without load drop out.

    Load over target, rounded up; held within the tolerances; at most the downscale and upscale
    factor away from the current number (one step is always allowed); within min and max.
    """
    now = F.col(current)
    raw = F.col("avg_in_flight") / F.col("target_in_flight")
    hold = ((raw < now) & (raw > now * (1 - F.col("downscale_tolerance")))) | (
        (raw > now) & (raw < now * (1 + F.col("upscale_tolerance")))
    )
    floor = F.least(now - 1, F.ceil(now * F.col("max_downscale_factor")))
    ceiling = F.greatest(now + 1, F.ceil(now * F.col("max_upscale_factor")))
    wanted = F.when(hold, now).otherwise(F.ceil(raw))
    stepped = F.least(F.greatest(wanted, floor), ceiling)
    bounded = F.least(F.greatest(stepped, F.col("min_replicas")), F.col("max_replicas"))
    return ticks.filter(F.col("avg_in_flight").isNotNull()).withColumn("recommendation", bounded.cast("int"))


def stabilize(recs: DataFrame, period_s: float, kind: str, key: str = "api_name") -> DataFrame:
    """Highest (``down``) or lowest (``up``) recommendation of the trailing period, its ends and the
    row itself included. Adds ``stabilized``; a busy API is cut into time chunks."""
    pick = {"down": F.max, "up": F.min}[kind]
    frame = (
        Window.partitionBy(key, "_chunk")
        .orderBy("_us")
        .rangeBetween(-int(period_s * MICROS), Window.currentRow)
    )
    placed = with_context(recs.withColumn("_us", micros("ts")), F.col("_us"), period_s)
    return (
        placed.withColumn("stabilized", pick("recommendation").over(frame))
        .filter(~F.col("_lent"))
        .drop("_us", "_chunk", "_lent")
    )


def first_wakes(requests: DataFrame, tick_s: int = TICK_S) -> DataFrame:
    """The first request of each API in each tick: no other can wake a sleeping API."""
    width = tick_s * MICROS
    us = micros("ts")
    return (
        requests.groupBy("api_name", (us - F.pmod(us, F.lit(width))).alias("_slot"))
        .agg(F.min("ts").alias("ts"))
        .drop("_slot")
    )


def decide(ticks: DataFrame, specs: DataFrame | None = None, wakes: DataFrame | None = None) -> DataFrame:
    """Replica requests per API, tick by tick: each request is the next tick's current number.

    ``ticks``: api_name, ts, avg_in_flight (null: no metrics yet), at most one per tick interval;
    ``specs`` may add ``init_replicas`` and the settings of :data:`DEFAULTS`. ``wakes`` (of
    :func:`first_wakes`) are requests that scale a sleeping API to 1. The fold streams through
    each API's ticks in time order and keeps only the recommendations of the longer
    stabilisation period; its rows are ticks, whose number grows with time, not with traffic.
    """
    events = ticks.select("api_name", "ts", "avg_in_flight", F.lit("tick").alias("event"))
    if wakes is not None:
        events = events.unionByName(
            wakes.select("api_name", "ts", F.lit(None).cast("double").alias("avg_in_flight"), F.lit("wake").alias("event"))
        )
    events = with_spec(events, specs)
    if "init_replicas" not in events.columns:
        events = events.withColumn("init_replicas", F.col("min_replicas"))
    events = events.withColumn("ts_us", micros("ts")).drop("ts")
    ordered = events.repartition("api_name").sortWithinPartitions("api_name", "ts_us", "event")
    folded = ordered.mapInPandas(_fold, "api_name string, ts_us long, event string, current int, recommendation int, request int")
    return folded.select("api_name", from_micros(F.col("ts_us")).alias("ts"), "event", "current", "recommendation", "request")


class Decision:
    """State of one API: current replicas, first tick, recent recommendations."""

    def __init__(self, current: int, started: int | None = None, recs=()):
        self.current = current
        self.started = started
        self.recs: deque[tuple[int, int]] = deque(recs)

    def wake(self, now: int) -> int | None:
        """A request at a sleeping API: one replica, recorded as a recommendation."""
        if self.current > 0:
            return None
        self.current = 1
        self.recs.append((now, 1))
        return 1

    def tick(self, now: int, load: float | None, spec) -> tuple[int, int] | None:
        """Recommendation and request at ``now`` (micros), or None without load."""
        if self.started is None:
            self.started = now
        if load is None or math.isnan(load):
            return None
        rec = self._recommend(load, spec)
        down = int(spec["downscale_stabilization_s"] * MICROS)
        up = int(spec["upscale_stabilization_s"] * MICROS)
        self.recs.append((now, rec))
        while now - self.recs[0][0] > max(down, up):
            self.recs.popleft()
        request, age = rec, now - self.started
        if request < self.current:
            highest = max(r for t, r in self.recs if now - t <= down)
            request = self.current if age < down else max(request, min(highest, self.current))
        if request > self.current:
            lowest = min(r for t, r in self.recs if now - t <= up)
            request = self.current if age < up else min(request, max(lowest, self.current))
        self.current = request
        return rec, request

    def _recommend(self, load: float, spec) -> int:
        now = self.current
        raw = load / spec["target_in_flight"]
        low, high = now * (1 - spec["downscale_tolerance"]), now * (1 + spec["upscale_tolerance"])
        rec = now if low < raw < now or now < raw < high else math.ceil(raw)
        rec = max(rec, min(now - 1, math.ceil(now * spec["max_downscale_factor"])))
        rec = min(rec, max(now + 1, math.ceil(now * spec["max_upscale_factor"])))
        return int(min(max(rec, spec["min_replicas"]), spec["max_replicas"]))


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    name, state = None, None
    for frame in frames:
        out = []
        for row in frame.to_dict("records"):
            if row["api_name"] != name:
                name, state = row["api_name"], Decision(int(row["init_replicas"]))
            before, now = state.current, row["ts_us"]
            if row["event"] == "wake":
                woke = state.wake(now)
                if woke is not None:
                    out.append((name, now, "wake", before, woke, woke))
                continue
            decided = state.tick(now, row["avg_in_flight"], row)
            if decided is not None:
                out.append((name, now, "tick", before, *decided))
        yield pd.DataFrame(out, columns=["api_name", "ts_us", "event", "current", "recommendation", "request"])
