"""The state table against a plain dictionary, and what failures and rival writers leave."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tideline.session import fresh_path
from tideline.sources import states
from tideline.sources.states import StateTable

SCHEMA = "job_id long, status string, updated_at long"


def current(table, keys=None):
    return {r["job_id"]: (r["status"], r["updated_at"]) for r in table.read(keys).collect()}


def apply(want, rows):
    for job, status, at in rows:
        if job not in want or at >= want[job][1]:
            want[job] = (status, at)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if not f.startswith(".")}


def test_random_upserts(spark):
    draw, want = random.Random(3), {}
    table = StateTable(spark, fresh_path(spark, "states"))
    for turn in range(11):
        rows = [(j, f"s{turn}", draw.randint(0, 20)) for j in draw.sample(range(40), draw.randint(0, 12))]
        apply(want, rows)
        table.upsert(spark.createDataFrame(rows, SCHEMA).coalesce(1), max_segments=4)
        assert len(table.manifest().segments) <= 5
    assert current(table) == want
    some = sorted(want)[:5] + [999]
    assert current(table, some) == {j: want[j] for j in some if j in want}
    assert table.compact(bucket_rows=7, whole=True)
    (one,) = table.manifest().segments
    assert one.rows == len(want) and one.buckets == -(-sum(1 for _ in want) // 7) or one.buckets > 1
    assert current(table) == want and current(table, some) == {j: want[j] for j in some if j in want}
    plan = table.read(some[:1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan
    assert table.vacuum(keep=1) > 0 and current(table) == want and len(files(table.path + "/manifest")) == 1
    assert not table.compact()


def test_an_upsert_writes_only_its_own_rows(spark):
    table = StateTable(spark, fresh_path(spark, "states"))
    table.upsert(spark.range(500).select(F.col("id").alias("job_id"), F.lit("new").alias("status"), F.lit(1).cast("long").alias("updated_at")))
    before = files(table.path)
    table.upsert(spark.createDataFrame([(7, "done", 2)], SCHEMA))
    after = files(table.path)
    assert before.items() <= after.items()
    assert table.manifest().segments[-1].rows == 1
    assert current(table, [7]) == {7: ("done", 2)}


def test_a_failed_upsert_leaves_the_table(spark, monkeypatch):
    table = StateTable(spark, fresh_path(spark, "states"))
    table.upsert(spark.createDataFrame([(1, "running", 1)], SCHEMA))
    bad = spark.createDataFrame([(1, "gone", 9)], SCHEMA).withColumn("status", F.raise_error("lost executor").cast("string"))
    with pytest.raises(Exception, match="lost executor"):
        table.upsert(bad)
    assert current(table) == {1: ("running", 1)}

    def fail(self, after):
        raise OSError("lost driver")

    with monkeypatch.context() as m:
        m.setattr(StateTable, "_commit", fail)
        with pytest.raises(OSError):
            table.upsert(spark.createDataFrame([(1, "gone", 9)], SCHEMA))
        with pytest.raises(OSError):
            table.compact(whole=True) or table._commit(None)
    assert current(table) == {1: ("running", 1)}
    assert table.vacuum() == 2 and current(table) == {1: ("running", 1)}


def test_rival_writers_both_stay(spark, monkeypatch):
    table = StateTable(spark, fresh_path(spark, "states"))
    table.upsert(spark.createDataFrame([(1, "running", 1)], SCHEMA))
    seen = table.manifest()
    rival = StateTable(spark, table.path)
    rival.upsert(spark.createDataFrame([(2, "rival", 1)], SCHEMA))
    answers = iter([seen])
    real = StateTable.manifest
    monkeypatch.setattr(StateTable, "manifest", lambda self: next(answers, None) or real(self))
    table.upsert(spark.createDataFrame([(3, "mine", 1)], SCHEMA))  # builds on a manifest that is no longer the last
    assert current(table) == {1: ("running", 1), 2: ("rival", 1), 3: ("mine", 1)}


def test_a_reader_keeps_its_version(spark):
    table = StateTable(spark, fresh_path(spark, "states"))
    table.upsert(spark.createDataFrame([(1, "running", 1)], SCHEMA))
    opened = table.read()
    table.upsert(spark.createDataFrame([(1, "done", 2)], SCHEMA))
    table.compact(whole=True)
    assert [r["status"] for r in opened.collect()] == ["running"]
    assert current(table) == {1: ("done", 2)}


def test_functions_and_ties(spark):
    path = fresh_path(spark, "states")
    for status in ("first", "second"):
        states.write_job_state(spark.createDataFrame([(1, status, 5), (None, status, 5)], SCHEMA), path)
    states.write_job_state(spark.createDataFrame([(1, "older", 4)], SCHEMA), path)
    assert {(r["job_id"], r["status"]) for r in states.read_job_state(spark, path).collect()} == {(1, "second"), (None, "second")}
    with pytest.raises(FileNotFoundError):
        states.read_job_state(spark, fresh_path(spark, "none"))
