"""Error cooldown: report an error, then hold back its repeats for ever longer.

The key is the first line of the message (or one key for any message). A key's first report
starts a cooldown of 5 s; a repeat after it is reported and doubles the cooldown, up to 24 h; a key not
seen for 24 h starts anew.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.timeseries import MICROS, from_micros, micros

INITIAL_S, FACTOR, MAX_S, EVICT_S = 5, 2, 24 * 3600, 24 * 3600
ANY_KEY = "<msg>"


class Cooldown:
    """State of one key, in micros. ``see`` tells whether an occurrence is reported."""

    __slots__ = ("reported", "seen", "period")

    def __init__(self, reported: int | None = None, seen: int = 0, period: int = 0):
        self.reported, self.seen, self.period = reported, seen, period

    def see(self, now: int) -> bool:
        if self.reported is None or now - self.seen > EVICT_S * MICROS:
            self.reported, self.seen, self.period = now, now, INITIAL_S * MICROS
            return True
        self.seen = now
        if now - self.reported > self.period:
            self.reported = now
            self.period = min(self.period * FACTOR, MAX_S * MICROS)
            return True
        return False


def error_key(message: Column, any_message: bool = False) -> Column:
    return F.lit(ANY_KEY) if any_message else F.split(message, "\n")[0]


def dedupe_errors(errors: DataFrame, any_message: bool = False) -> DataFrame:
    """The reported occurrences ``(key, ts, cooldown_s)`` of a batch of ``(ts, message)``; rows without a message or time are none.

    Reports form a chain in time, yet a key may hold most of the rows. So rows are first reduced to
    the earliest and latest occurrence per key and 5 seconds, a span in which at most one report
    can fall. Over these, :func:`_candidates` follows the earliest and the latest possible chain;
    only the few spans between the two need their exact times. The final fold reads those times,
    and just the ends of all other spans. The result equals the one-by-one fold over all rows.
    """
    width = INITIAL_S * MICROS
    rows = errors.filter(F.col("message").isNotNull() & F.col("ts").isNotNull())
    rows = rows.select(error_key(F.col("message"), any_message).alias("key"), micros("ts").alias("us"))
    rows = rows.withColumn("span", F.col("us") - F.pmod("us", F.lit(width)))
    spans = rows.groupBy("key", "span").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    marked = (
        spans.repartition("key")
        .sortWithinPartitions("key", "span")
        .mapInPandas(_candidates, "key string, span long")
        .distinct()
    )
    exact = rows.join(marked, ["key", "span"], "left_semi").select("key", "us", F.lit(True).alias("exact")).distinct()
    rest = spans.join(marked, ["key", "span"], "left_anti").select("key", F.col("last").alias("us"), F.lit(False).alias("exact"))
    # A span's first time matters only for gaps, and gaps of a day end in a marked span.
    ordered = exact.unionByName(rest).repartition("key").sortWithinPartitions("key", "us")
    reports = ordered.mapInPandas(_reports, "key string, us long, cooldown_s double")
    return reports.select("key", from_micros(F.col("us")).alias("ts"), "cooldown_s")


class _Chain:
    """A chain of reports over span ends: the earliest or the latest possible one."""

    def __init__(self, late: bool):
        self.late, self.due, self.period = late, None, 0

    def start(self, at: int) -> None:
        self.period = INITIAL_S * MICROS
        self.due = at + self.period

    def step(self, first: int, last: int) -> int | None:
        if last <= self.due:
            return None
        at = first if first > self.due else (last if self.late else self.due + 1)
        self.period = min(self.period * FACTOR, MAX_S * MICROS)
        self.due = at + self.period
        return at


def _candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key = seen = None
    early, late = _Chain(False), _Chain(True)
    waiting: deque[int] = deque()  # early reports whose late counterpart is to come
    held: deque[int] = deque()  # spans since the oldest of them
    for frame in frames:
        out = []
        for this, span, first, last in zip(frame["key"], frame["span"], frame["first"], frame["last"]):
            fresh = this != key
            if fresh or first - seen > EVICT_S * MICROS:
                if waiting:  # the chains may end apart: all spans in between stay open
                    out += [(key, s) for s in held]
                waiting.clear()
                held.clear()
                key = this
                early.start(first)
                late.start(first)
                out.append((this, span))
                seen = last
                continue
            seen = last
            at = early.step(first, last)
            if at is not None:
                waiting.append(span)
            if waiting:
                held.append(span)
            if late.step(first, last) is not None and waiting:
                begun = waiting.popleft()
                out += [(this, s) for s in held if s >= begun]
                while held and (not waiting or held[0] < waiting[0]):
                    held.popleft()
        yield pd.DataFrame(out, columns=["key", "span"])
    if waiting:
        yield pd.DataFrame([(key, s) for s in held], columns=["key", "span"])


def _reports(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state = None, None
    for frame in frames:
        out = []
        for this, us, exact in zip(frame["key"], frame["us"], frame["exact"]):
            if this != key:
                key, state = this, Cooldown()
            if not exact:
                state.seen = us
            elif state.see(us):
                out.append((key, us, state.period / MICROS))
        yield pd.DataFrame(out, columns=["key", "us", "cooldown_s"])


def stream_dedupe_errors(errors: DataFrame, any_message: bool = False, delay: str = "1 minute") -> DataFrame:
    """The same on a stream of ``(ts, message)`` whose rows come at most ``delay`` out of order.

    Rows wait in the state of their key until the watermark passes them and are then folded in time order, so the
    reports are those of the batch form however the rows were dealt to micro-batches. Rows later than that are dropped
    and counted by Spark (``numRowsDroppedByWatermark``). The reports of the last ``delay`` come when later rows move the
    watermark; a row without a message is a heartbeat that does just this. A key's state holds its distinct
    times of one delay, and goes once the key is unseen for 24 hours of event time.
    """
    rows = errors.select(error_key(F.col("message"), any_message).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    if any_message:
        rows = errors.select(F.when(F.col("message").isNotNull(), ANY_KEY).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    # Occurrences at one instant count as one: only the first can be reported.
    folded = (
        rows.withWatermark("ts", delay)
        .withColumn("us", F.unix_micros("ts"))
        .groupBy("key")
        .applyInPandasWithState(
            _advance,
            "key string, us long, cooldown_s double",
            "reported long, seen long, period long, waiting array<long>",
            "append",
            "EventTimeTimeout",
        )
    )
    return folded.select("key", from_micros(F.col("us")).alias("ts"), "cooldown_s")


def _reported(fold: Cooldown, times: np.ndarray) -> Iterator[tuple[int, int]]:
    """(time, period) of the reports among sorted distinct times; what lies between two reports is passed over at once."""
    gaps = np.flatnonzero(np.diff(times, prepend=fold.seen) > EVICT_S * MICROS)
    at = 0
    while at < len(times):
        if fold.reported is not None:
            gap = np.searchsorted(gaps, at)
            after = np.searchsorted(times, fold.reported + fold.period, "right")
            at = max(at, min(after, gaps[gap] if gap < len(gaps) else after))
            fold.seen = int(times[at - 1]) if at else fold.seen
        if at < len(times) and fold.see(int(times[at])):
            yield fold.reported, fold.period
        at += 1


def _advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    if key[0] is None:
        return
    *held, waiting = state.get if state.exists else (None, 0, 0, [])
    # Times stand in arrays: as Python numbers in a set, those of a busy key's micro-batch would take some fifteen times the memory.
    fold, times = Cooldown(*held), [np.array(waiting, "int64")]
    if not state.hasTimedOut:
        times += [frame["us"].astype("int64").to_numpy() for frame in frames]
    times = np.unique(np.concatenate(times))
    passed = state.getCurrentWatermarkMs() * 1000
    here = np.searchsorted(times, passed, "right")
    out = [(key[0], us, period / MICROS) for us, period in _reported(fold, times[:here])]
    times = times[here:]
    # The state is looked at again when its next row is due, or when the key may be forgotten.
    due = (int(times[0]) if len(times) else fold.seen + EVICT_S * MICROS) // 1000 + 1
    if due * 1000 > passed:
        state.update((fold.reported, fold.seen, fold.period, times.tolist()))
        state.setTimeoutTimestamp(due)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["key", "us", "cooldown_s"])
