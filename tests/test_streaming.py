"""Streaming operators: cooldown cases, brute force, and equality with the batch form."""

import datetime as dt
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators.autoscale import decide
from tideline.plans import replay
from tideline.session import fresh_path
from tideline.streaming import autoscale, batches, dedupe, requests

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, message string"


def errors(spark, seconds, message="boom\ntrace"):
    return spark.createDataFrame([(T0 + dt.timedelta(seconds=s), message) for s in seconds], SCHEMA)


def reported(frame):
    return [(r["ts"] - T0).total_seconds() for r in frame.orderBy("ts").collect()]


def as_stream(spark, frame):
    path = fresh_path(spark, "input")
    frame.write.parquet(path)
    return spark.readStream.schema(frame.schema).parquet(path)


DAY = 86400
CASES = [
    ([0, 4, 6, 15, 17], [0, 6, 17]),
    ([0, 5], [0]),
    ([0, 5.000001], [0, 5.000001]),
    ([0, 6, 6 + 25 * 3600, 6 + 25 * 3600 + 6], [0, 6, 6 + 25 * 3600, 6 + 25 * 3600 + 6]),
    ([0, DAY], [0, DAY]),
    ([3, 3, 3], [3]),
]


@pytest.mark.parametrize("seconds, want", CASES)
def test_cooldown(spark, seconds, want):
    assert reported(dedupe.dedupe_errors(errors(spark, seconds))) == want
    stream = dedupe.stream_dedupe_errors(as_stream(spark, errors(spark, seconds).unionByName(HEARTBEAT(spark))))
    assert reported(batches.run_to_end(stream)) == want


@pytest.mark.parametrize("any_message", [False, True])
def test_cooldown_of_rows_without_a_message(spark, any_message):
    rows = errors(spark, [0, 30], None).unionByName(errors(spark, [1, 3, 9])).unionByName(spark.createDataFrame([(None, "boom")], SCHEMA))
    assert reported(dedupe.dedupe_errors(rows, any_message)) == [1, 9]
    assert reported(dedupe.dedupe_errors(errors(spark, [0], None), any_message)) == []


def HEARTBEAT(spark):
    return errors(spark, [400 * DAY], None)


def in_turn(spark, frames):
    """A stream that reads the frames one after the other."""
    path = fresh_path(spark, "turns")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_errors_within_the_delay(spark):
    """Times 0 and 100, then 95 and 90: the stream reports what the batch form does."""
    turns = [errors(spark, [0, 100]), errors(spark, [95, 90]), HEARTBEAT(spark)]
    stream = dedupe.stream_dedupe_errors(in_turn(spark, turns), delay="1 minute")
    want = reported(dedupe.dedupe_errors(errors(spark, [0, 100, 95, 90])))
    assert reported(batches.run_to_end(stream)) == want == [0, 90]


def test_shuffled_errors_over_many_micro_batches(spark):
    rng = random.Random(8)
    times = sorted(rng.choice([1, 3, 7, 20, 400]) * rng.random() + i * 11 for i in range(300))
    frame = errors(spark, times, "a").unionByName(errors(spark, times[::3], "b"))
    stream = replay.out_of_order_stream(frame, fresh_path(spark, "shuffled"), 600, 300)
    got = batches.run_to_end(dedupe.stream_dedupe_errors(stream, delay="300 seconds"))
    want = dedupe.dedupe_errors(frame)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_ticks_within_the_delay(spark):
    schema = "api_name string, ts timestamp_ntz, avg_in_flight double"
    def ticks(*seconds):
        return spark.createDataFrame([("a", T0 + dt.timedelta(seconds=s), 1.0 + s / 7) for s in seconds], schema)

    beat = spark.createDataFrame([(None, T0 + dt.timedelta(days=400), None)], schema)
    turns = [ticks(0, 20), ticks(10, 40), ticks(30, 70), ticks(60, 50), beat]
    got = batches.run_to_end(autoscale.stream_decisions(in_turn(spark, turns)))
    want = decide(ticks(0, 10, 20, 30, 40, 50, 60, 70)).drop("event")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 8


def brute(times):
    state, out = dedupe.Cooldown(), []
    for t in sorted(times):
        if state.see(t):
            out.append(t)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_batch_cooldown_equals_the_fold(spark, seed):
    """Dense, sparse and gappy keys; a busy key is reduced to few exact spans."""
    rng = random.Random(seed)
    times = {}
    for key in range(12):
        at, found = rng.randint(0, 10**7), []
        for _ in range(rng.choice([1, 30, 400])):
            scale = rng.choice([10**4, 10**6, 10**7, 6 * 10**8, 10**11 if rng.random() < 0.05 else 10**9])
            at += rng.randint(0, scale)
            found.append(at)
        times[f"k{key}"] = found
    rows = [(T0 + dt.timedelta(microseconds=t), key) for key, found in times.items() for t in found]
    got = dedupe.dedupe_errors(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {(key, t) for key, found in times.items() for t in brute(found)}
    assert {(r["key"], round((r["ts"] - T0) / dt.timedelta(microseconds=1))) for r in got} == want


def test_busy_key_needs_few_exact_spans():
    import pandas as pd

    width = dedupe.INITIAL_S * 1_000_000
    spans = list(range(0, DAY * 1_000_000, width))
    frame = pd.DataFrame({"key": "k", "span": spans, "first": [s + 10 for s in spans], "last": [s + width - 10 for s in spans]})
    marked = pd.concat(list(dedupe._candidates(iter([frame]))))["span"].nunique()
    assert marked < 100


def test_any_message_uses_one_key(spark):
    frame = errors(spark, [0], "a").unionByName(errors(spark, [1], "b"))
    assert reported(dedupe.dedupe_errors(frame)) == [0, 1]
    assert reported(dedupe.dedupe_errors(frame, any_message=True)) == [0]


def test_request_metrics_equal_the_batch_form(spark):
    rows = [(T0 + dt.timedelta(seconds=i * 7), 200 if i % 3 else 500, i / 100) for i in range(200)]
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, status_code int, duration_s double")
    whole = requests.request_metrics(frame, "1 minute", "1 minute")
    closed = F.lit(rows[-1][0] - dt.timedelta(minutes=2)).cast("timestamp")
    want = sorted(map(tuple, whole.filter(F.col("window_start") <= closed).collect()))
    stream = requests.request_metrics(as_stream(spark, frame), "1 minute", "1 minute")
    assert sorted(map(tuple, batches.run_to_end(stream).collect())) == want and want


def test_status_never_moves_backwards(spark):
    schema = "request_id long, marker string"
    path = fresh_path(spark, "markers")
    state = fresh_path(spark, "markers-state")
    out = {}

    def run():
        stream = spark.readStream.schema(schema).parquet(path)

        def keep(rows, _epoch):
            out.update({r["request_id"]: r["status"] for r in rows.collect()})

        query = requests.async_status_updates(stream).writeStream.outputMode("update")
        query.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()

    for markers, want in (
        ([(1, "in_progress"), (2, "in_queue")], {1: "in_progress", 2: "in_queue"}),
        ([(1, "completed"), (2, "in_progress")], {1: "completed", 2: "in_progress"}),
        ([(1, "in_queue"), (1, "failed"), (2, "failed")], {1: "completed", 2: "failed"}),
    ):
        spark.createDataFrame(markers, schema).write.mode("append").parquet(path)
        run()
        assert out == want


def test_messages_once(spark):
    rows = [(T0 + dt.timedelta(seconds=i), f"m{i % 5}") for i in range(50)]
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, message_id string")
    assert batches.run_to_end(requests.once_only(as_stream(spark, frame))).count() == 5


def batch_sums(spark, path):
    rows = spark.read.parquet(path).orderBy("job", "batch_id").collect()
    return [(r["job"], r["batch_id"], r["result"]) for r in rows]


def whole_batches(counts, size):
    """Sums of the batches of jobs that hold 0, 1, 2, ..."""
    return [
        (job, at // size, str(sum(range(at, min(n, at + size)))))
        for job, n in sorted(counts.items())
        for at in range(0, n, size)
    ]


def arrivals(spark, source, parts):
    """Append (job, first, end) ranges to a source folder, one file each; an end of None closes the job."""
    for job, first, end in parts:
        rows = spark.range(first, end).selectExpr("id AS i", "id AS x") if end else spark.sql(f"SELECT {first}L AS i, NULL AS x")
        rows.selectExpr("i", "cast(x AS long) AS x", f"'{job}' AS job").coalesce(1).write.mode("append").parquet(source)


def run_arrivals(spark, source, path, state, handler=sum):
    stream = spark.readStream.schema("i long, x long, job string").option("maxFilesPerTrigger", 1).parquet(source)
    batches.stream_batches(stream, "i", "x", 4, lambda _c: lambda row: handler(row["items"]), path, state, keys=["job"], bucket=3)


def test_batches_run_on_over_micro_batches_and_restarts(spark):
    source, path, state = (fresh_path(spark, n) for n in ("items", "out", "out-state"))
    first = [("a", 0, 3), ("b", 0, 9), ("a", 3, 5), ("a", 5, 6)]
    arrivals(spark, source, first)
    run_arrivals(spark, source, path, state)
    assert batch_sums(spark, path) == whole_batches({"a": 4, "b": 8}, 4)  # the rest is open
    arrivals(spark, source, [("a", 6, 17), ("c", 0, 2), ("b", 9, None)])
    run_arrivals(spark, source, path, state)
    assert batch_sums(spark, path) == whole_batches({"a": 16, "b": 9}, 4)
    arrivals(spark, source, [("a", 17, None), ("c", 2, None)])
    run_arrivals(spark, source, path, state)
    assert batch_sums(spark, path) == whole_batches({"a": 17, "b": 9, "c": 2}, 4)


def test_a_failed_micro_batch_is_repeated(spark):
    """The results of an epoch are there but its carried rows aren't: the next start repeats it."""
    source, path, state = (fresh_path(spark, n) for n in ("items", "out", "out-state"))
    arrivals(spark, source, [("a", 0, 6)])
    run_arrivals(spark, source, path, state)
    arrivals(spark, source, [("a", 6, 11), ("a", 11, None)])

    kept = batches.drop_path

    def fail(*_):
        raise OSError("lost")

    batches.drop_path = fail  # called after the third epoch's writes, before the stream commits it
    try:
        with pytest.raises(Exception, match="lost"):
            run_arrivals(spark, source, path, state)
    finally:
        batches.drop_path = kept
    run_arrivals(spark, source, path, state)
    assert batch_sums(spark, path) == whole_batches({"a": 11}, 4)


def test_batches_without_a_job(spark):
    source, path, state = (fresh_path(spark, n) for n in ("items", "out", "out-state"))
    arrivals(spark, source, [("a", 0, 5), ("a", 5, 10), ("a", 10, None)])
    stream = spark.readStream.schema("i long, x long, job string").option("maxFilesPerTrigger", 1).parquet(source)
    batches.stream_batches(stream.drop("job"), "i", "x", 4, lambda _c: lambda row: row["items"], path, state)
    rows = spark.read.parquet(path).orderBy("batch_id").collect()
    assert [r["result"] for r in rows] == ["[0, 1, 2, 3]", "[4, 5, 6, 7]", "[8, 9]"]


class _State:
    """The state of one key as a stream hands it over."""

    exists, hasTimedOut, get = True, False, (None, 0, 0, [])

    def __init__(self, watermark_ms):
        self.getCurrentWatermarkMs = lambda: watermark_ms

    def update(self, value):
        self.get = value

    def setTimeoutTimestamp(self, at):
        self.timer = at


def _by_one(times):
    fold = dedupe.Cooldown()
    return [(us, fold.period) for us in times if fold.see(us)], fold


@pytest.mark.parametrize("seed", range(8))
def test_reports_pass_over_what_lies_between(seed):
    draw, at, times = random.Random(seed), 10**15, []
    for _ in range(400):
        at += int(draw.choice([1, 10**6, 5 * 10**6, 6 * 10**7, 86_400 * 10**6, 86_400 * 10**6 + 1]) * draw.choice([1, 1, draw.random()]))
        times.append(at)
    times = sorted(set(times))
    cut = draw.randint(0, len(times))
    want, last = _by_one(times)
    fold = dedupe.Cooldown()
    got = [*dedupe._reported(fold, np.array(times[:cut], "int64")), *dedupe._reported(fold, np.array(times[cut:], "int64"))]
    assert got == want and (fold.reported, fold.seen, fold.period) == (last.reported, last.seen, last.period)


def test_a_busy_key_holds_its_times_in_arrays():
    frames = [pd.DataFrame({"us": range(10**15 + i * 10**10, 10**15 + (i + 1) * 10**10, 500_000)}) for i in range(15)]
    want = _by_one([us for f in frames for us in f["us"]])[0]
    state = _State((10**15 + 15 * 10**10) // 1000)
    tracemalloc.start()
    (found,) = dedupe._advance(("error",), iter(frames), state)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["us"].tolist() == [us for us, _ in want] and state.get[3] == []
    assert peak < 8 * 6 * sum(map(len, frames))
