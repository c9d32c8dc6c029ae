"""Requests tracked with bounded state, against the batch form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import asyncreq
from tideline.plans import replay
from tideline.session import fresh_path
from tideline.streaming import requests

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "request_id long, ts timestamp_ntz, marker string"


def rows(spark, *given):
    return spark.createDataFrame([(r, T0 + dt.timedelta(seconds=s), m) for r, s, m in given], SCHEMA)


def tracked(spark, turns, **options):
    """The update rows of frames read one after the other, and the state rows held after each."""
    frame = turns[0].withColumn("_turn", F.lit(0))
    for i, turn in enumerate(turns[1:], 1):
        frame = frame.unionByName(turn.withColumn("_turn", F.lit(i)))
    stream = replay.in_turn(frame, F.col("_turn"), fresh_path(spark, "turns")).drop("_turn")
    out = []
    query = requests.tracked_status(stream, **options).writeStream.outputMode("update")
    query = query.foreachBatch(lambda batch, _: out.extend(batch.collect())).option("checkpointLocation", fresh_path(spark, "state"))
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    return out, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_a_request_is_forgotten_and_late_markers_are_counted(spark):
    beat = [(None, s, None) for s in (2000, 9000, 20000)]
    out, held = tracked(
        spark,
        [
            rows(spark, (1, 0, "in_queue"), (2, 5, "in_progress"), (3, 7, "in_progress")),
            rows(spark, (1, 20, "completed"), (2, 1, "in_queue")),
            rows(spark, beat[0]),
            rows(spark, (1, 2500, "in_progress"), (1, 2600, "failed"), beat[1]),
            rows(spark, beat[2]),
            rows(spark, (None, 10**6, None)),
        ],
        keep_s=1000,
        delay_s=60,
        abandon_s=5000,
    )
    told = [(r["request_id"], r["status"], r["invalid"], r["late"]) for r in out]
    assert sorted(t[:2] for t in told if not t[3]) == [(1, "completed"), (1, "in_queue"), (2, "in_progress")]
    assert sorted((t[0], t[3]) for t in told if t[3]) == [(1, 2), (3, 1)] and not any(t[1] for t in told if t[3])
    assert held[0] == 3 and held[-1] == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_batch_form(spark, seed):
    draw, given = random.Random(seed), []
    for r in range(60):
        start = draw.randint(0, 5000)
        given.append((r, start, "in_queue"))
        given += [(r, start + draw.randint(0, 200), draw.choice(["in_progress", "completed", "failed", "aaa", "zzz"])) for _ in range(draw.randint(0, 3))]
    frame = rows(spark, *given)
    stream = replay.out_of_order_stream(frame, fresh_path(spark, "late"), 700, 300)
    last = {}
    query = requests.tracked_status(stream, keep_s=600, delay_s=400).writeStream.outputMode("update")

    def keep(batch, _):
        for r in batch.collect():
            assert r["late"] == 0
            last[r["request_id"]] = (r["status"], r["invalid"])

    query.foreachBatch(keep).option("checkpointLocation", fresh_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    want = asyncreq.async_status(spark.range(60).withColumnRenamed("id", "request_id"), frame).collect()
    assert last == {r["request_id"]: (r["status"], r["invalid"]) for r in want}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_requests_share_a_bucket(spark, kind):
    """Python is called, and state kept, per bucket; requests of a bucket begin, end and are forgotten on their own."""
    big = 2**53
    turns = [
        rows(spark, (big + 1, 0, "in_queue"), (big + 2, 5, "in_progress"), (big + 3, 7, "in_queue"), (None, 8, None)),
        rows(spark, (big + 1, 20, "completed"), (big + 2, 1, "in_queue"), (big + 3, 30, "zzz")),
        rows(spark, (None, 2000, None), (big + 3, 1990, "completed")),
        rows(spark, (big + 1, 2500, "failed"), (None, 2400, None)),
        rows(spark, (None, 20000, None)),
        rows(spark, (None, 10**6, None)),
    ]
    turns = [t.withColumn("request_id", F.col("request_id").cast(kind)) for t in turns]
    wanted = dict(keep_s=1000, delay_s=60, abandon_s=5000)
    out, held = tracked(spark, turns, buckets=1, **wanted)
    apart, _ = tracked(spark, turns, **wanted)
    assert sorted(map(str, out)) == sorted(map(str, apart)) and max(held) == 1 and held[-1] == 0
    told = [(int(r["request_id"]) - big, r["status"], r["late"]) for r in out]
    assert sorted(told, key=str) == sorted(
        [(1, "in_queue", 0), (1, "completed", 0), (2, "in_progress", 0), (3, "in_queue", 0), (3, None, 0), (3, "completed", 0), (1, None, 1)], key=str
    )
