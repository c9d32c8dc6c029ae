"""Queries for recording rules and dashboard panels."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from tideline.functions.numeric import ieee_div
from tideline.operators import cost, panels
from tideline.operators.panels import Term
from tideline.plans import boards, views
from tideline.plans.q_control import COST_SQL, COST_VIEWS, fitted, priced_nodes
from tideline.plans.q_timeseries import grid_sql, instant_sql, quantile_sql, rate_sql
from tideline.plans.q_timeseries import rounded as rounded_columns
from tideline.plans.registry import query
from tideline.plans.views_sql import view
from tideline.session import materialise, shares

HOUR = 3600
RANGE = STEP = LOOKBACK = 12 * HOUR
EVENTS_PER_TASK = 25_000

COUNTERS = {
    "requests": ["requests_total", "latency_bucket", "latency_sum", "latency_count"],
    "resources": ["cpu_usage"],
    "jobs": [],
    "control": ["request_total", "duration_bucket", "duration_sum"],
    "nodes": [
        "cpu_seconds", "pgmajfault", "disk_io_time", "disk_io_weighted", "disk_read", "disk_written",
        "net_receive", "net_transmit", "net_receive_drop", "net_transmit_drop",
    ],
}
RANGED = {"resources": ["memory_working_set"]}


def board_vectors(spark, sf_dir, name):
    labels, samples = boards.BOARDS[name]
    counters, ranged = COUNTERS[name], RANGED.get(name, [])
    gauges = sorted({metric for metric, _, _ in samples} - set(counters) - set(ranged))
    # CPU series are counted as instants besides their rate.
    gauges += ["cpu_seconds"] if name == "nodes" else []
    # Each event makes up to 21 samples, which are sorted: more events make more tasks, not larger ones.
    tasks = shares(views.table(spark, sf_dir, "events"), EVENTS_PER_TASK)
    samples = boards.board(spark, sf_dir, name, tasks)
    rows = panels.vectors(samples, labels, counters, gauges, ranged, RANGE, STEP, LOOKBACK, tasks)
    # Recorded once, as recording rules are: a board reads its vectors several times.
    return materialise(rows, "vectors")


NUDGE = 1e-9  # settles exact ties, which engines round differently


def rounded(df, digits=6, *names):
    """Rounded to compare; ``value`` unless names are given."""
    if names:
        return rounded_columns(df, digits, *names)
    return df.withColumn("value", F.round(F.col("value") + NUDGE, digits))


def _listed(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


for _name, (_labels, _samples) in boards.BOARDS.items():
    _keys = ", ".join(["metric", *_labels])
    _source = f"(SELECT * FROM v_board_{_name})"
    view(f"v_rate_{_name}", rate_sql(f"(SELECT * FROM v_board_{_name} WHERE metric IN {_listed(COUNTERS[_name] or ['-'])})", _keys, RANGE, STEP), f"v_board_{_name}")
    view(f"v_now_{_name}", instant_sql(_source, _keys, STEP, LOOKBACK), f"v_board_{_name}")
    view(
        f"v_range_{_name}",
        f"SELECT {_keys}, make_timestamp(at_us) AS ts, sum(v) AS s, count(v)::DOUBLE AS n FROM ({grid_sql(_source, _keys, RANGE, STEP)}) GROUP BY {_keys}, at_us",
        f"v_board_{_name}",
    )


def panel_sql(parts: list[tuple[str, str, str]]) -> str:
    """UNION of (panel, series, query giving ts and value with the series' labels)."""
    return " UNION ALL ".join(
        f"SELECT '{panel}' AS panel, {series} AS series, ts, round(value + {NUDGE}, 6) AS value FROM ({sql})"
        for panel, series, sql in parts
    )


def agg(source: str, where: str, by: str, what: str = "sum(value)") -> str:
    keys = f"{by}, ts" if by else "ts"
    return f"SELECT {keys}, {what} AS value FROM {source} WHERE {where} GROUP BY {keys}"


def ratio(a: str, b: str, by: str, expression: str = "a.value / b.value") -> str:
    using = f"{by}, ts" if by else "ts"
    return f"SELECT {using}, {expression} AS value FROM ({a}) a JOIN ({b}) b USING ({using})"


# ---- WIN-11: request panels of the realtime and async boards

API, API_CODE = ("kind", "api"), ("kind", "api", "code")
S_API, S_CODE = "'kind=' || kind || ',api=' || api", "'kind=' || kind || ',api=' || api || ',code=' || code"
SCALED = "kind IN ('RealtimeAPI', 'AsyncAPI')"

REQUEST_TERMS = [
    Term("rate_total", "rate", f"metric = 'requests_total' AND {SCALED}", API),
    Term("rate_2xx", "rate", f"metric = 'requests_total' AND {SCALED} AND code RLIKE '^(?:2.+)$'", API_CODE),
    Term("rate_4xx", "rate", f"metric = 'requests_total' AND {SCALED} AND code RLIKE '^(?:4.+)$'", API_CODE),
    Term("rate_5xx", "rate", f"metric = 'requests_total' AND {SCALED} AND code RLIKE '^(?:5.+)$'", API_CODE),
    Term("in_flight", "instant", "metric = 'in_flight' AND kind = 'RealtimeAPI'", API),
    Term("replicas", "instant", "metric = 'in_flight' AND kind = 'RealtimeAPI' AND container <> 'activator'", API, "count"),
    Term("active", "instant", "metric = 'active' AND kind = 'AsyncAPI'", API),
    Term("queued", "instant", "metric = 'queued' AND kind = 'AsyncAPI'", API),
    Term("available", "instant", "metric = 'replicas_available' AND kind = 'AsyncAPI'", API),
    Term("lat_sum", "rate", f"metric = 'latency_sum' AND {SCALED}", API),
    Term("lat_count", "rate", f"metric = 'latency_count' AND {SCALED}", API),
]
REQUEST_PANELS = {
    **{n: n for n in ["rate_total", "rate_2xx", "rate_4xx", "rate_5xx", "in_flight", "replicas", "active", "queued", "available"]},
    "async_in_flight": "active + queued",
    "mean_latency": panels.over("lat_sum", "lat_count"),
}


def request_sql():
    rate, now = "v_rate_requests", "v_now_requests"
    code = lambda c: agg(rate, f"metric = 'requests_total' AND {SCALED} AND code LIKE '{c}__'", "kind, api, code")
    simple = lambda m, k: agg(now, f"metric = '{m}' AND kind = '{k}'", "kind, api")
    parts = [
        ("rate_total", S_API, agg(rate, f"metric = 'requests_total' AND {SCALED}", "kind, api")),
        *[(f"rate_{c}xx", S_CODE, code(c)) for c in (2, 4, 5)],
        ("in_flight", S_API, simple("in_flight", "RealtimeAPI")),
        ("replicas", S_API, agg(now, "metric = 'in_flight' AND kind = 'RealtimeAPI' AND container <> 'activator'", "kind, api", "count(*)::DOUBLE")),
        ("active", S_API, simple("active", "AsyncAPI")),
        ("queued", S_API, simple("queued", "AsyncAPI")),
        ("available", S_API, simple("replicas_available", "AsyncAPI")),
        ("async_in_flight", S_API, ratio(simple("active", "AsyncAPI"), simple("queued", "AsyncAPI"), "kind, api", "a.value + b.value")),
        ("mean_latency", S_API, ratio(agg(rate, f"metric = 'latency_sum' AND {SCALED}", "kind, api"), agg(rate, f"metric = 'latency_count' AND {SCALED}", "kind, api"), "kind, api")),
    ]
    buckets = f"(SELECT kind, api, ts, CASE le WHEN '+Inf' THEN 'inf'::DOUBLE ELSE le::DOUBLE END AS le, value AS c FROM {rate} WHERE metric = 'latency_bucket' AND {SCALED})"
    parts += [(f"p{int(q * 100)}", S_API, quantile_sql(q, buckets, "kind, api, ts")) for q in (0.99, 0.9, 0.5)]
    return panel_sql(parts)


@query("win_11", request_sql(), "v_rate_requests v_now_requests")
def win_11(spark, sf_dir):
    rows = board_vectors(spark, sf_dir, "requests")
    names = [t.name for t in REQUEST_TERMS]
    found = panels.formulas(panels.evaluate(rows, REQUEST_TERMS), names, REQUEST_PANELS)
    wanted = {"p99": 0.99, "p90": 0.9, "p50": 0.5}
    tails = panels.quantiles(rows, f"metric = 'latency_bucket' AND {SCALED}", API, wanted)
    return rounded(found.unionByName(tails))


# ---- WIN-12: resource panels, the same sixteen on four boards

MIB = "1048576e0"
NOT_POD = "container <> 'POD'"
# The task board counts every container in both parts of its memory panel.
MEMORY_SUM = f"metric = 'memory_working_set' AND ({NOT_POD} OR kind = 'TaskAPI')"
MEMORY_COUNT = "metric = 'memory_working_set' AND (container = 'api' OR kind = 'TaskAPI')"
RESOURCE_TERMS = [
    Term("cpu", "rate", f"metric = 'cpu_usage' AND {NOT_POD}", API),
    Term("cpu_requested", "instant", "metric = 'resource_requests' AND resource = 'cpu'", API),
    Term("mem_sum", "sum_over_time", MEMORY_SUM, API),
    Term("mem_n", "count_over_time", MEMORY_COUNT, API, "avg"),
    Term("mem_requested", "instant", "metric = 'resource_requests' AND resource = 'memory'", API),
    Term("gpu_util", "instant", "metric = 'gpu_util'", API),
    Term("gpus", "instant", "metric = 'gpu_util'", API, "count"),
    Term("fb_used", "instant", "metric = 'fb_used'", API),
    Term("fb_used_n", "instant", "metric = 'fb_used'", API, "count"),
    Term("fb_free", "instant", "metric = 'fb_free'", API),
    Term("pods", "instant", "metric = 'pod_info'", API),
    Term("gpu_pods", "grouped", "metric = 'gpu_util'", API, "count"),
]
def resource_panels(div):
    """The sixteen formulas; ``div`` writes a division."""
    memory, requested = div(div("mem_sum", "mem_n"), MIB), div("mem_requested", MIB)
    return {
        "cpu_used": "cpu",
        "cpu_requested": "cpu_requested",
        "memory_used": memory,
        "memory_requested": requested,
        "gpu_used": "gpu_util / 100",
        "gpu_count": "gpus",
        "gpu_memory_used": "fb_used",
        "gpu_memory_total": "fb_free + fb_used",
        "cpu_used_per_replica": div("cpu", "pods"),
        "cpu_requested_per_replica": div("cpu_requested", "pods"),
        "memory_used_per_replica": div(memory, "pods"),
        "memory_requested_per_replica": div(requested, "pods"),
        "gpu_used_per_gpu": div("gpu_util / 100", "gpus"),
        "gpus_per_replica": div("gpus", "gpu_pods"),
        "gpu_memory_used_per_gpu": div("fb_used", "fb_used_n"),
        "gpu_memory_total_per_gpu": div("fb_free + fb_used", "fb_used_n"),
    }


RESOURCE_PANELS = resource_panels(panels.over)
# DuckDB divides doubles that way by itself.
RESOURCE_SQL = resource_panels(lambda a, b: f"(({a})::DOUBLE / ({b})::DOUBLE)")


def resource_sql():
    sums = f"""
    SELECT kind, api, ts, max(value) FILTER (t = 'cpu') AS cpu, max(value) FILTER (t = 'cpu_requested') AS cpu_requested,
      max(value) FILTER (t = 'mem_sum') AS mem_sum, max(value) FILTER (t = 'mem_n') AS mem_n, max(value) FILTER (t = 'mem_requested') AS mem_requested,
      max(value) FILTER (t = 'gpu_util') AS gpu_util, max(value) FILTER (t = 'gpus') AS gpus, max(value) FILTER (t = 'gpu_pods') AS gpu_pods,
      max(value) FILTER (t = 'fb_used') AS fb_used, max(value) FILTER (t = 'fb_used_n') AS fb_used_n, max(value) FILTER (t = 'fb_free') AS fb_free,
      max(value) FILTER (t = 'pods') AS pods
    FROM (
      SELECT 'cpu' AS t, kind, api, ts, sum(value) AS value FROM v_rate_resources WHERE container <> 'POD' GROUP BY ALL
      UNION ALL SELECT 'mem_sum', kind, api, ts, sum(s) FROM v_range_resources WHERE metric = 'memory_working_set' AND (container <> 'POD' OR kind = 'TaskAPI') GROUP BY ALL
      UNION ALL SELECT 'mem_n', kind, api, ts, avg(n) FROM v_range_resources WHERE metric = 'memory_working_set' AND (container = 'api' OR kind = 'TaskAPI') GROUP BY ALL
      UNION ALL SELECT CASE resource WHEN 'cpu' THEN 'cpu_requested' ELSE 'mem_requested' END, kind, api, ts, sum(value) FROM v_now_resources WHERE metric = 'resource_requests' GROUP BY ALL
      UNION ALL SELECT 'gpu_util', kind, api, ts, sum(value) FROM v_now_resources WHERE metric = 'gpu_util' GROUP BY ALL
      UNION ALL SELECT 'gpus', kind, api, ts, count(*) FROM v_now_resources WHERE metric = 'gpu_util' GROUP BY ALL
      UNION ALL SELECT 'gpu_pods', kind, api, ts, count(DISTINCT pod) FROM v_now_resources WHERE metric = 'gpu_util' GROUP BY ALL
      UNION ALL SELECT 'fb_used', kind, api, ts, sum(value) FROM v_now_resources WHERE metric = 'fb_used' GROUP BY ALL
      UNION ALL SELECT 'fb_used_n', kind, api, ts, count(*) FROM v_now_resources WHERE metric = 'fb_used' GROUP BY ALL
      UNION ALL SELECT 'fb_free', kind, api, ts, sum(value) FROM v_now_resources WHERE metric = 'fb_free' GROUP BY ALL
      UNION ALL SELECT 'pods', kind, api, ts, sum(value) FROM v_now_resources WHERE metric = 'pod_info' GROUP BY ALL
    ) GROUP BY ALL"""
    return "WITH w AS (" + sums + ") " + panel_sql(
        [(p, S_API, f"SELECT kind, api, ts, {e} AS value FROM w WHERE {e} IS NOT NULL") for p, e in RESOURCE_SQL.items()]
    )


@query("win_12", resource_sql(), "v_rate_resources v_now_resources v_range_resources")
def win_12(spark, sf_dir):
    rows = board_vectors(spark, sf_dir, "resources")
    # count(count by pod): one row per pod first, then counted like any other series.
    gpu_pods = rows.filter("form = 'instant' AND metric = 'gpu_util'").groupBy("metric", "kind", "api", "pod", "ts")
    gpu_pods = gpu_pods.agg(F.count("value").cast("double").alias("value")).withColumn("form", F.lit("grouped"))
    rows = rows.unionByName(gpu_pods, allowMissingColumns=True)
    names = [t.name for t in RESOURCE_TERMS]
    return rounded(panels.formulas(panels.evaluate(rows, RESOURCE_TERMS), names, RESOURCE_PANELS))


# ---- WIN-13: job panels of the batch and task boards

JOBS = "kind IN ('BatchAPI', 'TaskAPI')"
JOB_TERMS = [
    Term("succeeded", "instant", f"metric = 'succeeded' AND {JOBS}", API),
    Term("failed", "instant", f"metric = 'failed' AND {JOBS}", API),
    Term("time_sum", "instant", f"metric = 'time_sum' AND {JOBS}", API),
    Term("time_count", "instant", f"metric = 'time_count' AND {JOBS}", API),
    Term("active_jobs", "instant", f"metric = 'job_active' AND {JOBS} AND value <> 0", API, "count"),
    Term("active_workers", "instant", "metric = 'job_active' AND kind = 'BatchAPI'", API),
]
JOB_PANELS = {
    **{n: n for n in ["succeeded", "failed", "active_jobs", "active_workers"]},
    "mean_time": panels.over("time_sum", "time_count"),
}


def job_sql():
    now = "v_now_jobs"
    part = lambda m: agg(now, f"metric = '{m}' AND {JOBS}", "kind, api")
    return panel_sql(
        [
            ("succeeded", S_API, part("succeeded")),
            ("failed", S_API, part("failed")),
            ("active_jobs", S_API, agg(now, f"metric = 'job_active' AND {JOBS} AND value <> 0", "kind, api", "count(*)::DOUBLE")),
            ("active_workers", S_API, agg(now, "metric = 'job_active' AND kind = 'BatchAPI'", "kind, api")),
            ("mean_time", S_API, ratio(part("time_sum"), part("time_count"), "kind, api")),
        ]
    )


@query("win_13", job_sql(), "v_now_jobs")
def win_13(spark, sf_dir):
    rows = board_vectors(spark, sf_dir, "jobs")
    return rounded(panels.formulas(panels.evaluate(rows, JOB_TERMS), [t.name for t in JOB_TERMS], JOB_PANELS))


# ---- WIN-14: control-plane panels

QUIET = "verb NOT RLIKE '^(?:WATCH|CONNECT)$'"
OUTSIDE = "client NOT RLIKE '^(?:kubelet.*|kube-scheduler.*|kube-controller.*|kube-apiserver.*|kube-proxy.*)$'"
CONTROL_TERMS = [
    Term("rate_total", "rate", "metric = 'request_total'"),
    Term("inflight", "instant", "metric = 'inflight'", ("resource",)),
    Term("duration", "rate", f"metric = 'duration_sum' AND {QUIET}"),
    Term("errors", "rate", "metric = 'duration_bucket' AND code RLIKE '^(?:^(?:4..)$|^(?:5..)$)$'", ("code",)),
    Term("by_verb", "rate", "metric = 'request_total'", ("verb",)),
    Term("by_resource", "rate", "metric = 'request_total'", ("resource",)),
    Term("by_client", "rate", f"metric = 'request_total' AND {OUTSIDE}", ("client",)),
    Term("by_instance", "rate", "metric = 'request_total'", ("instance",)),
]
POSITIVE = ["errors", "by_client", "by_instance"]
CONTROL_PANELS = {
    t.name: f"CASE WHEN {t.name} > 0 THEN {t.name} END" if t.name in POSITIVE else t.name for t in CONTROL_TERMS
}


def control_sql():
    rate = "v_rate_control"
    quiet = "verb NOT IN ('WATCH', 'CONNECT')"
    total = "metric = 'request_total'"
    positive = lambda sql: f"SELECT * FROM ({sql}) WHERE value > 0"
    buckets = lambda keys: (
        f"(SELECT {keys} ts, CASE le WHEN '+Inf' THEN 'inf'::DOUBLE ELSE le::DOUBLE END AS le, value AS c FROM {rate} WHERE metric = 'duration_bucket' AND {quiet})"
    )
    return panel_sql(
        [
            ("rate_total", "''", agg(rate, total, "")),
            ("inflight", "'resource=' || resource", agg("v_now_control", "metric = 'inflight'", "resource")),
            ("duration", "''", agg(rate, f"metric = 'duration_sum' AND {quiet}", "")),
            ("errors", "'code=' || code", positive(agg(rate, "metric = 'duration_bucket' AND code >= '400' AND code < '600'", "code"))),
            ("by_verb", "'verb=' || verb", agg(rate, total, "verb")),
            ("by_resource", "'resource=' || resource", agg(rate, total, "resource")),
            ("by_client", "'client=' || client", positive(agg(rate, f"{total} AND client NOT LIKE 'kube%'", "client"))),
            ("by_instance", "'instance=' || instance", positive(agg(rate, total, "instance"))),
            ("p99", "''", quantile_sql(0.99, buckets(""), "ts")),
            ("p90_resource", "'resource=' || resource", quantile_sql(0.9, buckets("resource, "), "resource, ts")),
            ("p90_verb", "'verb=' || verb", quantile_sql(0.9, buckets("verb, "), "verb, ts")),
        ]
    )


@query("win_14", control_sql(), "v_rate_control v_now_control")
def win_14(spark, sf_dir):
    rows = board_vectors(spark, sf_dir, "control")
    names = [t.name for t in CONTROL_TERMS]
    found = panels.formulas(panels.evaluate(rows, CONTROL_TERMS), names, CONTROL_PANELS)
    found = found.select("panel", "series", "ts", "value")
    where = f"metric = 'duration_bucket' AND {QUIET}"
    for by, wanted in ((), {"p99": 0.99}), (("resource",), {"p90_resource": 0.9}), (("verb",), {"p90_verb": 0.9}):
        found = found.unionByName(panels.quantiles(rows, where, by, wanted))
    return rounded(found)


# ---- WIN-10: recording rules

DISK = f"device RLIKE '^(?:{boards.DISK_PATTERN})$'"
NODE, DISKS = ("instance",), ("instance", "device")
RULE_TERMS = [
    Term("num_cpu", "cpus", "metric = 'cpu_seconds'", NODE, "count"),
    Term("idle", "rate", "metric = 'cpu_seconds' AND mode = 'idle'", NODE, "avg"),
    Term("load1", "instant", "metric = 'load1'", NODE),
    Term("mem_available", "instant", "metric = 'mem_available'", NODE),
    Term("mem_total", "instant", "metric = 'mem_total'", NODE),
    Term("faults", "rate", "metric = 'pgmajfault'", NODE),
    Term("io_time", "rate", f"metric = 'disk_io_time' AND {DISK}", DISKS),
    Term("io_weighted", "rate", f"metric = 'disk_io_weighted' AND {DISK}", DISKS),
    Term("received", "rate", "metric = 'net_receive' AND device <> 'lo'", NODE),
    Term("sent", "rate", "metric = 'net_transmit' AND device <> 'lo'", NODE),
    Term("received_drop", "rate", "metric = 'net_receive_drop' AND device <> 'lo'", NODE),
    Term("sent_drop", "rate", "metric = 'net_transmit_drop' AND device <> 'lo'", NODE),
    Term("fs_used", "fs_used", "true", DISKS, "max"),
    Term("fs_size", "instant", "metric = 'fs_size' AND fstype <> ''", DISKS, "max"),
]
NODE_RULES = {
    "instance:num_cpu": "num_cpu",
    "instance:cpu_utilisation": "1 - idle",
    "instance:load1_per_cpu": panels.over("load1", "num_cpu"),
    "instance:memory_utilisation": "1 - " + panels.over("mem_available", "mem_total"),
    "instance:pgmajfault": "faults",
    "instance_device:disk_io_time": "io_time",
    "instance_device:disk_io_weighted": "io_weighted",
    "instance:receive_bytes": "received",
    "instance:transmit_bytes": "sent",
    "instance:receive_drop": "received_drop",
    "instance:transmit_drop": "sent_drop",
}
_HELPERS = {"cpu_weighted": "(1 - idle) * num_cpu", "fs_used": "fs_used", "fs_size": "fs_size"}


def recording_rules(spark, sf_dir):
    """Instance rules, and the cluster rules computed from them, as ``panel, series, ts, value``."""
    rows = board_vectors(spark, sf_dir, "nodes")
    now = F.col("form") == "instant"
    cpus = rows.filter(now & (F.col("metric") == "cpu_seconds")).groupBy("metric", "instance", "cpu", "ts")
    cpus = cpus.agg(F.count("value").cast("double").alias("value")).withColumn("form", F.lit("cpus"))
    keys = ["instance", "device", "fstype", "mountpoint", "ts"]
    sizes = rows.filter(now & F.col("metric").isin("fs_size", "fs_avail") & (F.col("fstype") != ""))
    used = F.max(F.when(F.col("metric") == "fs_size", F.col("value"))) - F.max(
        F.when(F.col("metric") == "fs_avail", F.col("value"))
    )
    used = sizes.groupBy(*keys).agg(used.alias("value")).filter(F.col("value").isNotNull())
    rows = rows.unionByName(cpus, allowMissingColumns=True).unionByName(
        used.withColumn("form", F.lit("fs_used")).withColumn("metric", F.lit("fs")), allowMissingColumns=True
    )
    names = [t.name for t in RULE_TERMS]
    per_node = panels.formulas(panels.evaluate(rows, RULE_TERMS), names, {**NODE_RULES, **_HELPERS})

    def total(name):
        return F.sum(F.when(F.col("panel") == name, F.col("value")))

    def mean(name):
        return total(name) / F.nullif(F.count_if(F.col("panel") == name), F.lit(0))

    cluster = {
        "cluster:cpu_utilization": ieee_div(total("cpu_weighted"), total("instance:num_cpu")),
        "cluster:load1": mean("instance:load1_per_cpu"),
        "cluster:memory_utilization": mean("instance:memory_utilisation"),
        "cluster:pgmajfault": total("instance:pgmajfault"),
        "cluster:receive_bytes": total("instance:receive_bytes"),
        "cluster:transmit_bytes": total("instance:transmit_bytes"),
        "cluster:receive_drop": total("instance:receive_drop"),
        "cluster:transmit_drop": total("instance:transmit_drop"),
        "cluster:disk_io_utilization": mean("instance_device:disk_io_time"),
        "cluster:disk_io_saturation": mean("instance_device:disk_io_weighted"),
        "cluster:disk_space_utilization": ieee_div(total("fs_used"), total("fs_size")),
    }
    lined = per_node.groupBy("ts").agg(*[c.alias(f"c{i}") for i, c in enumerate(cluster.values())])
    pairs = [F.struct(F.lit(n).alias("panel"), F.col(f"c{i}").alias("value")) for i, n in enumerate(cluster)]
    totals = lined.select("ts", F.lit("").alias("series"), F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())
    kept = per_node.filter(F.col("panel").isin(list(NODE_RULES)))
    return kept.select("panel", "series", "ts", "value").unionByName(totals.select("panel", "series", "ts", "value"))


@cache
def rules_sql() -> str:
    rate, now = "v_rate_nodes", "v_now_nodes"
    disk = f"regexp_full_match(device, '{boards.DISK_PATTERN}')"
    one = lambda m: f"SELECT instance, ts, value FROM {now} WHERE metric = '{m}'"
    net = lambda m: agg(rate, f"metric = '{m}' AND device <> 'lo'", "instance")
    s, d = "'instance=' || instance", "'instance=' || instance || ',device=' || device"
    num = agg(now, "metric = 'cpu_seconds'", "instance", "count(DISTINCT cpu)::DOUBLE")
    util = agg(rate, "metric = 'cpu_seconds' AND mode = 'idle'", "instance", "1 - avg(value)")
    load = ratio(one("load1"), num, "instance")
    memory = ratio(one("mem_available"), one("mem_total"), "instance", "1 - a.value / b.value")
    io = lambda m: f"SELECT instance, device, ts, value FROM {rate} WHERE metric = '{m}' AND {disk}"
    parts = [
        ("instance:num_cpu", s, num),
        ("instance:cpu_utilisation", s, util),
        ("instance:load1_per_cpu", s, load),
        ("instance:memory_utilisation", s, memory),
        ("instance:pgmajfault", s, f"SELECT instance, ts, value FROM {rate} WHERE metric = 'pgmajfault'"),
        ("instance_device:disk_io_time", d, io("disk_io_time")),
        ("instance_device:disk_io_weighted", d, io("disk_io_weighted")),
        ("instance:receive_bytes", s, net("net_receive")),
        ("instance:transmit_bytes", s, net("net_transmit")),
        ("instance:receive_drop", s, net("net_receive_drop")),
        ("instance:transmit_drop", s, net("net_transmit_drop")),
    ]
    whole = lambda sql, what="sum(value)": f"SELECT ts, {what} AS value FROM ({sql}) GROUP BY ts"
    mean = "sum(value) / count(*)"
    fs = f"""SELECT instance, device, ts, max(sz - av) AS used, max(sz) AS size FROM (
        SELECT instance, device, fstype, mountpoint, ts, max(value) FILTER (metric = 'fs_size') AS sz, max(value) FILTER (metric = 'fs_avail') AS av
        FROM {now} WHERE metric IN ('fs_size', 'fs_avail') AND fstype <> '' GROUP BY ALL) GROUP BY ALL"""
    weighted = whole(ratio(util, num, "instance", "a.value * b.value"))
    parts += [
        ("cluster:cpu_utilization", "''", ratio(weighted, whole(num), "")),
        ("cluster:load1", "''", whole(load, mean)),
        ("cluster:memory_utilization", "''", whole(memory, mean)),
        ("cluster:pgmajfault", "''", whole(f"SELECT ts, value FROM {rate} WHERE metric = 'pgmajfault'")),
        ("cluster:receive_bytes", "''", whole(net("net_receive"))),
        ("cluster:transmit_bytes", "''", whole(net("net_transmit"))),
        ("cluster:receive_drop", "''", whole(net("net_receive_drop"))),
        ("cluster:transmit_drop", "''", whole(net("net_transmit_drop"))),
        ("cluster:disk_io_utilization", "''", whole(io("disk_io_time"), mean)),
        ("cluster:disk_io_saturation", "''", whole(io("disk_io_weighted"), mean)),
        ("cluster:disk_space_utilization", "''", f"SELECT ts, sum(used) / sum(size) AS value FROM ({fs}) GROUP BY ts"),
    ]
    return panel_sql(parts)


@query("win_10", rules_sql(), "v_rate_nodes v_now_nodes")
def win_10(spark, sf_dir):
    return rounded(recording_rules(spark, sf_dir))


# ---- WIN-15: node panels

CPU = ("instance", "cpu")
NODE_TERMS = [
    Term("idle_rate", "rate", "metric = 'cpu_seconds' AND mode = 'idle'", CPU),
    Term("idle_count", "many", "metric = 'cpu_seconds'", CPU),
    *[Term(m, "instant", f"metric = '{m}'", NODE) for m in ("load1", "load5", "load15")],
    Term("cpus", "instant", "metric = 'cpu_seconds' AND mode = 'idle'", NODE, "count"),
    *[Term(m, "instant", f"metric = '{m}'", NODE) for m in ("mem_total", "mem_free", "mem_buffers", "mem_cached", "mem_available")],
    *[Term(m, "rate", f"metric = '{m}' AND {DISK}", DISKS) for m in ("disk_read", "disk_written", "disk_io_time")],
    *[Term(m, "rate", f"metric = '{m}' AND device <> 'lo'", DISKS) for m in ("net_receive", "net_transmit")],
    Term("fs_used", "fs_used", "true", NODE),
    Term("fs_free", "fs_free", "true", NODE),
]
NODE_PANELS = {
    "cpu_usage": panels.over("1 - idle_rate", "idle_count"),
    "load1": "load1",
    "load5": "load5",
    "load15": "load15",
    "logical_cores": "cpus",
    "memory_used": "mem_total - mem_free - mem_buffers - mem_cached",
    "memory_buffers": "mem_buffers",
    "memory_cached": "mem_cached",
    "memory_free": "mem_free",
    "memory_usage_percent": "100 - " + panels.over("mem_available", "mem_total") + " * 100",
    "disk_read": "disk_read",
    "disk_written": "disk_written",
    "disk_io_time": "disk_io_time",
    "disk_used": "fs_used",
    "disk_free": "fs_free",
    "network_received": "net_receive",
    "network_transmitted": "net_transmit",
}


def node_sql():
    rate, now = "v_rate_nodes", "v_now_nodes"
    disk = f"regexp_full_match(device, '{boards.DISK_PATTERN}')"
    one = lambda m: f"SELECT instance, ts, value FROM {now} WHERE metric = '{m}'"
    s, c, d = "'instance=' || instance", "'instance=' || instance || ',cpu=' || cpu", "'instance=' || instance || ',device=' || device"
    idle = f"SELECT instance, cpu, ts, value FROM {rate} WHERE metric = 'cpu_seconds' AND mode = 'idle'"
    cores = agg(now, "metric = 'cpu_seconds' AND mode = 'idle'", "instance", "count(*)::DOUBLE")
    mem = f"SELECT instance, ts, t.value - f.value - b.value - c.value AS value FROM ({one('mem_total')}) t JOIN ({one('mem_free')}) f USING (instance, ts) JOIN ({one('mem_buffers')}) b USING (instance, ts) JOIN ({one('mem_cached')}) c USING (instance, ts)"
    fs = f"""SELECT instance, ts, sum(u) AS used, sum(a) AS free FROM (SELECT instance, device, ts, max(sz - av) AS u, max(av) AS a FROM (
        SELECT instance, device, fstype, mountpoint, ts, max(value) FILTER (metric = 'fs_size') AS sz, max(value) FILTER (metric = 'fs_avail') AS av
        FROM {now} WHERE metric IN ('fs_size', 'fs_avail') AND fstype <> '' GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"""
    rates = lambda m, w: f"SELECT instance, device, ts, value FROM {rate} WHERE metric = '{m}' AND {w}"
    return panel_sql(
        [
            ("cpu_usage", c, f"SELECT instance, cpu, ts, (1 - a.value) / b.value AS value FROM ({idle}) a JOIN ({cores}) b USING (instance, ts)"),
            *[(m, s, one(m)) for m in ("load1", "load5", "load15")],
            ("logical_cores", s, cores),
            ("memory_used", s, mem),
            ("memory_buffers", s, one("mem_buffers")),
            ("memory_cached", s, one("mem_cached")),
            ("memory_free", s, one("mem_free")),
            ("memory_usage_percent", s, ratio(one("mem_available"), one("mem_total"), "instance", "100 - a.value / b.value * 100")),
            *[(m, d, rates(m, disk)) for m in ("disk_read", "disk_written", "disk_io_time")],
            ("disk_used", s, f"SELECT instance, ts, used AS value FROM ({fs})"),
            ("disk_free", s, f"SELECT instance, ts, free AS value FROM ({fs})"),
            ("network_received", d, rates("net_receive", "device <> 'lo'")),
            ("network_transmitted", d, rates("net_transmit", "device <> 'lo'")),
        ]
    )


@query("win_15", node_sql(), "v_rate_nodes v_now_nodes")
def win_15(spark, sf_dir):
    rows = board_vectors(spark, sf_dir, "nodes")
    now = F.col("form") == "instant"
    # Many-to-one: each CPU of a node meets the node's number of idle series.
    idle = rows.filter(now & (F.col("metric") == "cpu_seconds") & (F.col("mode") == "idle"))
    counts = idle.groupBy("instance", "ts").agg(F.count("value").cast("double").alias("value"))
    seen = rows.filter("form = 'rate' AND metric = 'cpu_seconds' AND mode = 'idle'").select("metric", "instance", "cpu", "ts")
    many = seen.join(counts, ["instance", "ts"]).withColumn("form", F.lit("many"))
    sizes = rows.filter(now & F.col("metric").isin("fs_size", "fs_avail") & (F.col("fstype") != ""))
    pick = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    volumes = sizes.groupBy("instance", "device", "fstype", "mountpoint", "ts").agg(
        (pick("fs_size") - pick("fs_avail")).alias("used"), pick("fs_avail").alias("free")
    )
    devices = volumes.groupBy("instance", "device", "ts").agg(F.max("used").alias("used"), F.max("free").alias("free"))
    both = F.array(
        F.struct(F.lit("fs_used").alias("form"), F.col("used").alias("value")),
        F.struct(F.lit("fs_free").alias("form"), F.col("free").alias("value")),
    )
    disks = devices.select("instance", "device", "ts", F.inline(both)).filter(F.col("value").isNotNull())
    rows = rows.unionByName(many, allowMissingColumns=True).unionByName(disks, allowMissingColumns=True)
    return rounded(panels.formulas(panels.evaluate(rows, NODE_TERMS), [t.name for t in NODE_TERMS], NODE_PANELS))


# ---- WIN-16: cluster panels

# Pods that belong to the system, by the start of their name.
SYSTEM_PODS = (
    "aws-node|grafana|autoscaler|cluster-autoscaler|coredns|event-exporter|fluent-bit|kube-proxy|"
    "k8s-neuron-scheduler|kube-state-metrics|metrics-server|node-exporter|operator|operator-controller-manager|"
    "prometheus-operator|prometheus-prometheus|prometheus-statsd-exporter|dcgm-exporter|ingressgateway|istiod|"
    "activator|enqueuer|gateway|nvidia-device-plugin-daemonset|neuron-device-plugin-daemonset|async-gateway"
)
CLUSTER_RULES = [
    "cluster:cpu_utilization", "cluster:load1", "cluster:memory_utilization", "cluster:pgmajfault",
    "cluster:receive_bytes", "cluster:transmit_bytes", "cluster:receive_drop", "cluster:transmit_drop",
    "cluster:disk_io_utilization", "cluster:disk_io_saturation", "cluster:disk_space_utilization",
]


@query(
    "win_16",
    f"""
    WITH rules AS ({rules_sql()}), {COST_VIEWS}, costs AS ({COST_SQL})
    SELECT panel, ts, NULL::VARCHAR AS component, value FROM rules WHERE panel IN {_listed(CLUSTER_RULES)}
    UNION ALL SELECT 'instance_count', ts, NULL, count(*)::DOUBLE FROM rules WHERE panel = 'instance:cpu_utilisation' GROUP BY ts
    UNION ALL SELECT 'user_pods', ts, NULL, sum(value) FROM v_now_resources WHERE metric = 'pod_info'
      AND NOT regexp_full_match(CASE WHEN pod IN ('pod-3', 'pod-4') THEN 'operator-' ELSE '' END || pod, '({SYSTEM_PODS})-(.+)') GROUP BY ts
    UNION ALL SELECT 'cost_' || scope, NULL, component, cost FROM costs
    """,
    "v_rate_nodes v_now_nodes v_now_resources v_priced v_fits",
)
def win_16(spark, sf_dir):
    found = rounded(recording_rules(spark, sf_dir))
    ratios = found.filter(F.col("panel").isin(CLUSTER_RULES)).select("panel", "ts", "value")
    instances = (
        found.filter("panel = 'instance:cpu_utilisation'")
        .groupBy("ts")
        .agg(F.count("value").cast("double").alias("value"))
        .select(F.lit("instance_count").alias("panel"), "ts", "value")
    )
    named = F.concat(F.when(F.col("pod").isin("pod-3", "pod-4"), "operator-").otherwise(""), "pod")
    users = (
        board_vectors(spark, sf_dir, "resources")
        .filter("form = 'instant' AND metric = 'pod_info'")
        .filter(~named.rlike(f"^(?:({SYSTEM_PODS})-(.+))$"))
        .groupBy("ts")
        .agg(F.sum("value").alias("value"))
        .select(F.lit("user_pods").alias("panel"), "ts", "value")
    )
    costs = rounded(cost.cost_breakdown(priced_nodes(spark, sf_dir), fitted(spark, sf_dir), 0.5), 4, "cost")
    costs = costs.select(
        F.concat(F.lit("cost_"), "scope").alias("panel"), "component", F.col("cost").alias("value")
    )
    timed = ratios.unionByName(instances).unionByName(users).withColumn("component", F.lit(None).cast("string"))
    return timed.unionByName(costs, allowMissingColumns=True)

