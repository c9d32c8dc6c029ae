"""Job and request states, metrics merging, routing."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import pods
from tideline.operators import asyncreq, jobs, panels, routing

# (avg, succeeded) partials and their merged average.
MERGES = [
    ([(1.0, 3), (2.0, 1)], 1.25),
    ([(None, 1), (1.0, 1)], 1.0),
    ([(None, 0)], None),
    ([(2.0, 0)], None),
    ([(2.0, 0), (4.0, 2)], 4.0),
    ([(None, 3), (None, 2)], None),
    ([(1.5, 2)], 1.5),
    ([(1.0, 1), (2.0, 1), (3.0, 2)], 2.25),
]


@pytest.mark.parametrize("partials, want", MERGES)
def test_merge_metrics(spark, partials, want):
    rows = [("j", s, 1, a) for a, s in partials]
    df = spark.createDataFrame(rows, "job_id string, succeeded long, failed long, avg_secs double")
    got = jobs.merge_metrics(df, ["job_id"]).collect()[0]
    assert got["avg_secs"] == want
    assert (got["succeeded"], got["failed"]) == (sum(s for _, s in partials), len(partials))


def test_merge_metrics_is_associative(spark):
    rng = random.Random(1)
    rows = [(g, rng.randint(0, 5), 1, rng.choice([None, 1.0, 2.5, 4.0])) for g in range(6) for _ in range(5)]
    df = spark.createDataFrame(rows, "part int, succeeded long, failed long, avg_secs double")
    df = df.withColumn("job_id", F.lit(1))
    once = jobs.merge_metrics(df, ["job_id"]).collect()[0]
    # Averages of parts count only the successes that had one, as their merge does.
    kept = df.filter("avg_secs IS NOT NULL")
    parts = jobs.merge_metrics(kept, ["job_id", "part"])
    twice = jobs.merge_metrics(parts, ["job_id"]).collect()[0]
    assert once["avg_secs"] == pytest.approx(twice["avg_secs"])


@pytest.mark.parametrize(
    "markers, batch, task",
    [
        (["stopped", "succeeded"], "succeeded", "stopped"),
        (["running", "stopped"], "stopped", "stopped"),
        (["enqueuing", "running"], "running", "running"),
        (["spec.json"], "unknown", "unknown"),
        (["worker_oom", "timed_out", "succeeded"], "timed_out", "timed_out"),
        (["worker_error", "worker_oom"], "worker_oom", "worker_oom"),
        (["pending"], "pending", "pending"),
    ],
)
def test_job_state_precedence(spark, markers, batch, task):
    df = spark.createDataFrame([("j", m, i) for i, m in enumerate(markers)], "job_id string, marker string, mtime int")
    assert jobs.job_state(df, ["job_id"]).collect()[0]["status"] == batch
    assert jobs.job_state(df, ["job_id"], jobs.TASK_PRECEDENCE).collect()[0]["status"] == task


@pytest.mark.parametrize(
    "markers, status, invalid",
    [
        ([], "not_found", False),
        (["in_queue"], "in_queue", False),
        (["in_queue", "in_progress"], "in_progress", False),
        (["in_progress", "failed", "completed"], "completed", False),
        (["in_progress", "failed"], "failed", False),
        (["in_progress", "odd"], None, True),
        (["completed", "odd"], "completed", False),
        (["completed", "aaa"], None, True),
    ],
)
def test_async_status(spark, markers, status, invalid):
    ids = spark.createDataFrame([("r",)], "request_id string")
    rows = spark.createDataFrame([("r", m) for m in markers], "request_id string, marker string")
    got = asyncreq.async_status(ids, rows).collect()[0]
    assert (got["status"], got["invalid"]) == (status, invalid)


def container(**given):
    base = dict(running=None, ready=None, waiting=None, exit_code=None, exit_reason=None, last_exit_code=None, last_exit_reason=None)
    return {**base, **given}


READY, WAITING = container(running=True, ready=True), container(waiting="Other")
POD_CASES = [
    (dict(phase="Pending", containers=[]), "Pending"),
    (dict(phase="Pending", containers=[container(waiting="ImagePullBackOff")]), "ErrImagePull"),
    (dict(phase="Pending", containers=[container(waiting="PodInitializing"), READY]), "Creating"),
    (dict(phase="Succeeded", containers=[WAITING]), "Succeeded"),
    (dict(phase="Failed", containers=[container(exit_code=137)]), "Killed"),
    (dict(phase="Failed", containers=[container(exit_code=1, exit_reason="OOMKilled")]), "KilledOOM"),
    (dict(phase="Failed", containers=[container(exit_code=137, last_exit_code=1)]), "Failed"),
    (dict(phase="Failed", containers=[], reason="Evicted", message="node low on resource: memory"), "KilledOOM"),
    (dict(phase="Running", containers=[READY], deleted=True), "Terminating"),
    (dict(phase="Running", containers=[READY], ready="True"), "Ready"),
    (dict(phase="Running", containers=[READY], ready="False"), "NotReady"),
    (dict(phase="Running", containers=[WAITING, READY]), "Pending"),
    (dict(phase="Running", containers=[container(exit_code=0)]), "Succeeded"),
    (dict(phase="Other", containers=[READY]), "Unknown"),
]


@pytest.mark.parametrize("pod, want", POD_CASES)
def test_pod_status(spark, pod, want):
    ready = [dict(type="Ready", status=pod["ready"], changed_at=None)] if "ready" in pod else []
    row = dict(
        pod_id=1, phase=pod["phase"], reason=pod.get("reason"), message=pod.get("message"), deleted=pod.get("deleted", False),
        conditions=ready, init_containers=[], containers=pod["containers"],
    )
    df = spark.createDataFrame([row], pods.POD_SCHEMA)
    now = F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")
    assert df.select(pods.pod_status(now).alias("s")).collect()[0]["s"] == want


def test_stalled_after_fifteen_minutes(spark):
    df = spark.sql(
        """SELECT 'Pending' AS phase, NULL AS reason, NULL AS message, false AS deleted, array() AS init_containers, array() AS containers,
           array(named_struct('type', 'PodScheduled', 'status', 'False', 'changed_at', TIMESTAMP_NTZ'2024-01-01 00:00:00')) AS conditions"""
    )
    kind = spark.createDataFrame([], pods.POD_SCHEMA).schema["containers"].dataType.simpleString()
    df = df.withColumns({c: F.col(c).cast(kind) for c in ("containers", "init_containers")})
    for now, want in (("2024-01-01 00:14:59", "Pending"), ("2024-01-01 00:15:00", "Stalled")):
        status = pods.pod_status(F.lit(now).cast("timestamp_ntz"))
        assert df.select(status.alias("s")).collect()[0]["s"] == want


SPLITS = "splitter string, target string, weight int, shadow boolean"


@pytest.mark.parametrize("weights", [(0, 100), (30, 70), (100, 0), (33, 67)])
def test_every_request_is_routed_once(spark, weights):
    splits = spark.createDataFrame([("s", "a", weights[0], False), ("s", "b", weights[1], False)], SPLITS)
    requests = spark.range(4000).select(F.col("id").alias("request_id"), F.lit("s").alias("splitter"))
    routed = routing.route(requests, splits)
    counts = {r["target"]: r["count"] for r in routed.groupBy("target").count().collect()}
    assert sum(counts.values()) == 4000 and None not in counts
    assert counts.get("a", 0) / 4000 == pytest.approx(weights[0] / 100, abs=0.03)
    assert (weights[0] > 0) == ("a" in counts)


def test_validate_splits(spark):
    rows = [("ok", "a", 30, False), ("ok", "b", 70, False), ("ok", "c", 100, True)]
    rows += [("bad", "a", 30, False), ("bad", "a", 30, False), ("bad", "b", 1, True), ("bad", "c", 1, True)]
    got = {r["splitter"]: r["violations"] for r in routing.validate_splits(spark.createDataFrame(rows, SPLITS)).collect()}
    assert got == {"ok": [], "bad": ["weights", "not_unique", "shadows"]}


def pod(spark, **given):
    """The status of a pod with every column null but the given ones."""
    values = {n: None for n in ("reason", "message", "deleted", "conditions", "init_containers", "containers")}
    row = {"pod_id": 1, **values, **given}
    names = ["pod_id", "phase", "reason", "message", "deleted", "conditions", "init_containers", "containers"]
    df = spark.createDataFrame([tuple(row[n] for n in names)], pods.POD_SCHEMA)
    return df.select(pods.pod_status(F.expr("timestamp_ntz'2024-01-01'"))).first()[0]


def test_pods_without_lists(spark):
    waiting = [(False, False, "ErrImagePull", None, None, None, None)]
    assert pod(spark, phase="Pending") == "Pending"
    assert pod(spark, phase="Running") == "Pending"
    assert pod(spark, phase="Failed") == "Failed"
    assert pod(spark, phase="Pending", containers=waiting) == "ErrImagePull"
    assert pod(spark, phase="Pending", init_containers=waiting) == "ErrImagePull"
    assert pod(spark, phase="Running", containers=[(True, True, None, None, None, None, None)]) == "NotReady"


def test_panel_divisions(spark):
    rows = [(a, b) for a in (0.0, 1.0, -1.0, float("nan"), None) for b in (0.0, 2.0, None)]
    got = spark.createDataFrame(rows, "a double, b double").selectExpr("a", "b", f"{panels.over('a', 'b')} as q").collect()
    nan, inf = float("nan"), float("inf")
    want = [nan, 0.0, None, inf, 0.5, None, -inf, -0.5, None, nan, nan, None, None, None, None]
    assert [repr(r.q) for r in got] == [repr(w) for w in want]
