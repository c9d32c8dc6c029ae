"""Time-series operators: hand-made values and brute force."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tideline import session
from tideline.functions.numeric import INF, ieee_div
from tideline.operators import autoscale, timeseries

T0 = dt.datetime(2024, 1, 1)


def samples(spark, points, key="s"):
    rows = [(key, T0 + dt.timedelta(seconds=s), float(v)) for s, v in points]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double")


def rates(frame, **kw):
    return {int((r["ts"] - T0).total_seconds()): r["value"] for r in timeseries.rate(frame, ["series"], **kw).collect()}


def test_rate_of_a_steady_counter(spark):
    got = rates(samples(spark, [(i * 15, i * 30) for i in range(1, 20)]), range_s=60, step_s=60)
    assert got[120] == pytest.approx(2.0) and got[240] == pytest.approx(2.0)


def test_rate_corrects_resets_and_needs_two_samples(spark):
    got = rates(samples(spark, [(60, 100), (75, 110), (90, 5), (105, 15), (120, 25)]), range_s=60, step_s=60)
    # 10 before the reset, 5 + 10 + 10 after it, over the full minute.
    assert got[120] == pytest.approx(35 / 60)
    assert rates(samples(spark, [(60, 1)]), range_s=60, step_s=60) == {}


def test_rate_does_not_extrapolate_below_zero(spark):
    got = rates(samples(spark, [(110, 0), (120, 10)]), range_s=60, step_s=60)
    assert got[120] == pytest.approx(10 / 60)


def brute_rate(points, at, reach):
    inside = [(t, v) for t, v in points if at - reach <= t <= at]
    if len(inside) < 2:
        return None
    grew = sum(b if b < a else b - a for (_, a), (_, b) in zip(inside, inside[1:]))
    sampled = inside[-1][0] - inside[0][0]
    gap, start, end = sampled / (len(inside) - 1), inside[0][0] - (at - reach), at - inside[-1][0]
    if grew > 0 and sampled * inside[0][1] / grew < start:
        start = sampled * inside[0][1] / grew
    spread = sampled + (start if start < gap * 1.1 else gap / 2) + (end if end < gap * 1.1 else gap / 2)
    return grew * spread / sampled / reach


def test_rate_equals_brute_force_across_chunks(spark):
    rng = random.Random(5)
    times = sorted(rng.sample(range(1, 20000), 600))
    value, points = 0, []
    for t in times:
        value = rng.randint(0, 3) if rng.random() < 0.05 else value + rng.randint(0, 9)
        points.append((t, value))
    got = rates(samples(spark, points), range_s=300, step_s=100)
    want = {at: brute_rate(points, at, 300) for at in range(0, 20400, 100)}
    want = {at: v for at, v in want.items() if v is not None}
    assert set(got) == set(want)
    assert all(got[at] == pytest.approx(want[at]) for at in want)


def test_as_of_equals_brute_force(spark):
    rng = random.Random(6)
    points = sorted(rng.sample(range(0, 10000), 300))
    seen = [(t, rng.random()) for t in sorted(rng.sample(range(0, 10000), 200))]
    frame = samples(spark, [(t, 0) for t in points]).drop("value").withColumn("n", F.lit(1))
    got = timeseries.as_of(frame, samples(spark, seen), ["series"], 60).collect()
    for r in got:
        at = (r["ts"] - T0).total_seconds()
        before = [v for t, v in seen if at - 60 <= t <= at]
        assert r["value"] == (before[-1] if before else None)
    assert len(got) == 300


def test_sampling_reports_zero_for_empty_intervals(spark):
    got = timeseries.sample_in_flight(samples(spark, [(1, 4), (2, 6), (31, 2)]), ["series"], 10).orderBy("ts").collect()
    assert [r["value"] for r in got] == [5.0, 0.0, 0.0, 2.0]


def quantile(spark, q, counts):
    rows = [("x", le, float(c)) for le, c in counts]
    df = spark.createDataFrame(rows, "k string, le double, value double")
    return timeseries.histogram_quantile(q, df, ["k"]).collect()[0]["value"]


def test_histogram_quantile(spark):
    assert quantile(spark, 0.5, [(1.0, 2), (2.0, 4), (INF, 4)]) == 1.0
    assert quantile(spark, 0.75, [(1.0, 2), (2.0, 4), (INF, 4)]) == 1.5
    assert quantile(spark, 0.25, [(1.0, 2), (INF, 2)]) == 0.25
    assert quantile(spark, 0.9, [(1.0, 0), (2.0, 0), (INF, 5)]) == 2.0  # all beyond the last bound
    assert math.isnan(quantile(spark, 0.9, [(1.0, 0), (INF, 0)]))  # no observations
    assert math.isnan(quantile(spark, 0.9, [(1.0, 3)]))  # one bucket
    assert quantile(spark, 0.5, [(1.0, 3), (2.0, 2), (INF, 4)]) == pytest.approx(2 / 3)  # dip is smoothed
    assert quantile(spark, 1.5, [(1.0, 2), (INF, 2)]) == INF


def test_ieee_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 0.0)], "a double, b double")
    got = [r["v"] for r in df.select(ieee_div(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got[0] == INF and got[1] == -INF and math.isnan(got[2]) and got[3] == 1.5 and got[4] is None


# ---- autoscaling

SPEC = dict(
    min_replicas=1, max_replicas=5, target_in_flight=1.0, max_downscale_factor=0.5, max_upscale_factor=1.5,
    downscale_tolerance=0.05, upscale_tolerance=0.05, downscale_stabilization_s=0.0, upscale_stabilization_s=0.0,
)
STEADY = dict(downscale_stabilization_s=1.0, upscale_stabilization_s=1.0)
# spec changes, load, current replicas, earlier recommendations, request
CASES = [
    (dict(min_replicas=0, max_downscale_factor=0.75, **STEADY), 0, 1, [], 1),
    ({}, 2, 5, [5, 2, 2, 2], 3),
    (STEADY, 5, 1, [5, 5, 2, 2], 1),
    ({}, 3, 1, [], 2),
    (STEADY, 5, 2, [2, 2, 2, 5], 2),
    (dict(min_replicas=0, max_downscale_factor=0.75, **STEADY), 3, 2, [0, 1, 2, 3], 2),
]


@pytest.mark.parametrize("changes, load, current, earlier, want", CASES)
def test_decision_cases(changes, load, current, earlier, want):
    step = 250_000
    state = autoscale.Decision(current, None, [(i * step, r) for i, r in enumerate(earlier)])
    _, request = state.tick((len(earlier) + 1) * step, load, {**SPEC, **changes})
    assert request == want


@pytest.mark.parametrize(
    "load, current, want",
    [
        (10.0, 10, 10),
        (9.6, 10, 10),  # within the downscale tolerance
        (9.5, 10, 10),  # at its bound: ceil
        (9.0, 10, 9),
        (10.4, 10, 10),  # within the upscale tolerance
        (10.5, 10, 11),  # at its bound
        (100.0, 10, 15),
        (0.0, 10, 8),
        (0.0, 1, 1),
        (3.0, 0, 1),
        (1000.0, 90, 100),
    ],
)
def test_recommendation_bounds(spark, load, current, want):
    ticks = spark.createDataFrame([("a", load, current)], "api_name string, avg_in_flight double, current int")
    got = autoscale.recommend(autoscale.with_spec(ticks)).collect()
    assert [r["recommendation"] for r in got] == [want]
    state = autoscale.Decision(current)
    assert state.tick(0, load, {**autoscale.DEFAULTS})[0] == want


def test_no_load_gives_no_row(spark):
    ticks = spark.createDataFrame([("a", None, 3)], "api_name string, avg_in_flight double, current int")
    assert autoscale.recommend(autoscale.with_spec(ticks)).count() == 0


def test_sleeping_api_wakes(spark):
    loads = [1.0, 0.0, 0.0, 0.0, 2.0]
    ticks = spark.createDataFrame(
        [("a", T0 + dt.timedelta(seconds=10 * i), load) for i, load in enumerate(loads)],
        "api_name string, ts timestamp_ntz, avg_in_flight double",
    )
    specs = spark.createDataFrame(
        [("a", 0, 1, 0.0, 0.0, 0.0)],
        "api_name string, min_replicas int, init_replicas int, max_downscale_factor double, downscale_stabilization_s double, upscale_stabilization_s double",
    )
    requests = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=s)) for s in (5, 33, 34)], "api_name string, ts timestamp_ntz")
    wakes = autoscale.first_wakes(requests)
    assert wakes.count() == 2
    got = autoscale.decide(ticks, specs, wakes).orderBy("ts").collect()
    assert [(r["event"], r["current"], r["request"]) for r in got] == [
        ("tick", 1, 1),
        ("tick", 1, 0),
        ("tick", 0, 0),
        ("tick", 0, 0),
        ("wake", 0, 1),
        ("tick", 1, 2),
    ]


@pytest.mark.parametrize("range_s, step_s", [(60, 10), (60, 60), (45, 10), (10, 60), (300, 100)])
def test_windows_by_panes_equal_brute_force(spark, range_s, step_s):
    """Samples on and off the grid, at one time, and far apart; ranges of many steps, of parts, of less than one."""
    rng = random.Random(range_s + step_s)
    points = [(rng.choice([rng.randrange(0, 900, 5), rng.randrange(900_000) / 1000]), rng.randrange(9)) for _ in range(150)]
    rows = [("s", T0 + dt.timedelta(seconds=t), float(v)) for t, v in points]
    frame = spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double").repartition(3)
    got = {int((r["ts"] - T0).total_seconds()): r for r in timeseries.over_time(frame, ["series"], range_s, step_s).collect()}
    now = {int((r["ts"] - T0).total_seconds()): r["value"] for r in timeseries.instant(frame, ["series"], step_s, range_s).collect()}
    seen = {}
    for at in range(-step_s, 900 + range_s + step_s, step_s):
        held = [(t, v) for t, v in points if at - range_s <= t <= at]
        if held:
            seen[at] = held
    assert set(got) == set(now) == set(seen)
    for at, held in seen.items():
        values = [v for _, v in held]
        r = got[at]
        assert (r["sum_v"], r["count_v"], r["min_v"], r["max_v"]) == (sum(values), len(values), min(values), max(values))
        assert r["avg_v"] == pytest.approx(sum(values) / len(values)) and now[at] == max(held)[1]


def test_rates_sort_samples_once_and_in_as_many_tasks_as_asked(spark):
    at = [0, 0, 59, 60, 60, 61, 119, 120, 121, 500, 86399, 86400, 86401]
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), float(v)) for s, v in zip(at, [5, 5, 7, 9, 8, 2, 4, 4, 1, 3, 8, 9, 1])]
    samples = spark.createDataFrame(rows, "pod string, ts timestamp_ntz, value double")
    found = timeseries.rate(samples, ["pod"], 90, 60, "increase", tasks=7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(pod#\d+, _chunk#\d+L, 7\)", plan)
    # What reduces samples to panes holds flat values in hash tables; only panes are sorted.
    sorting = [line for line in plan.split("\n") if "SortAggregate" in line]
    assert sorting and not any("_part#" in line.split("functions")[0] for line in sorting)
    assert sorted(found.collect()) == sorted(timeseries.rate(samples, ["pod"], 90, 60, "increase").collect())


def test_more_rows_make_more_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    scan = spark.range(1000 * cores + 1)
    assert session.shares(scan, 1000) == cores + 1 and session.shares(scan, 10**6) == cores
    assert session.spread(scan, cores + 1).rdd.getNumPartitions() == cores + 1 and session.spread(scan) is scan


def test_panes_may_run_over_the_ends_of_chunks(spark):
    rng = random.Random(8)
    points = [(t, rng.randint(0, 500)) for t in sorted(rng.sample(range(1, 3 * 86400), 400))]
    got = rates(samples(spark, points), range_s=7000, step_s=3000)
    for at in range(1800, 3 * 86400, 3000):  # multiples of the step since the epoch
        want = brute_rate(points, at, 7000)
        assert got.get(at) == (want if want is None else pytest.approx(want))
