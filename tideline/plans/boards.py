"""Samples for the dashboard boards, derived from the events table.

Each board is a list of (metric, labels, value); labels and values are plain SQL over an
event's columns, so the same text describes the samples to Spark and to the oracle. ``base``
grows with time and wraps where a counter takes it modulo something, so counters reset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.plans import views
from tideline.plans.views_sql import view
from tideline.session import spread

Sample = tuple[str, dict[str, str], str]

LES = {"0.1": 1, "0.5": 2, "1": 4, "+Inf": 5}

REQUEST_LABELS = ["kind", "api", "pod", "container", "code", "le"]
REQUEST_SAMPLES: list[Sample] = [
    ("requests_total", {"code": "code"}, "base % 700000"),
    ("in_flight", {"pod": "pod", "container": "container"}, "k"),
    ("queued", {}, "k * 2"),
    ("active", {}, "k"),
    ("replicas_available", {}, "k % 5"),
    *[("latency_bucket", {"le": f"'{le}'"}, f"(base % 700000) * {n}") for le, n in LES.items()],
    ("latency_sum", {}, "(base * 3) % 700000"),
    ("latency_count", {}, "(base % 700000) * 5"),
]
RESOURCE_LABELS = ["kind", "api", "pod", "container", "resource"]
RESOURCE_SAMPLES: list[Sample] = [
    ("cpu_usage", {"pod": "pod", "container": "container"}, "base % 700000"),
    ("memory_working_set", {"pod": "pod", "container": "container"}, "k * 1048576"),
    ("resource_requests", {"pod": "pod", "resource": "'cpu'"}, "1 + k % 4"),
    ("resource_requests", {"pod": "pod", "resource": "'memory'"}, "(1 + k % 8) * 1048576"),
    ("gpu_util", {"pod": "pod", "container": "container"}, "k"),
    ("fb_used", {"pod": "pod"}, "k * 10"),
    ("fb_free", {"pod": "pod"}, "1000 - k * 10"),
    ("pod_info", {"pod": "pod"}, "1"),
]
JOB_LABELS = ["kind", "api", "job"]
JOB_SAMPLES: list[Sample] = [
    ("succeeded", {}, "k"),
    ("failed", {}, "k % 7"),
    ("time_sum", {}, "k * 13"),
    ("time_count", {}, "k % 5"),
    ("job_active", {"job": "pod"}, "k % 3"),
]
CONTROL_LABELS = ["verb", "resource", "client", "instance", "code", "le"]
_CONTROL = {"verb": "verb", "resource": "resource", "client": "client", "instance": "instance", "code": "code"}
CONTROL_SAMPLES: list[Sample] = [
    ("request_total", _CONTROL, "base % 700000"),
    ("inflight", {"resource": "resource"}, "k"),
    *[("duration_bucket", {**_CONTROL, "le": f"'{le}'"}, f"(base % 700000) * {n}") for le, n in LES.items()],
    ("duration_sum", _CONTROL, "(base * 3) % 700000"),
]
NODE_LABELS = ["instance", "cpu", "mode", "device", "fstype", "mountpoint"]
_DISK = {"device": "device"}
_FS = {"device": "device", "fstype": "fstype", "mountpoint": "mountpoint"}
NODE_SAMPLES: list[Sample] = [
    ("cpu_seconds", {"cpu": "cpu", "mode": "'idle'"}, "(base % 700000) / 200e0"),
    ("cpu_seconds", {"cpu": "cpu", "mode": "'user'"}, "((base * 2) % 700000) / 200e0"),
    ("load1", {}, "k / 10e0"),
    ("load5", {}, "k / 20e0"),
    ("load15", {}, "k / 40e0"),
    ("mem_total", {}, "16000"),
    ("mem_available", {}, "8000 + k * 10"),
    ("mem_free", {}, "4000 + k * 10"),
    ("mem_buffers", {}, "500 + k"),
    ("mem_cached", {}, "1000 + k * 2"),
    ("pgmajfault", {}, "(base * 3) % 700000"),
    ("disk_io_time", _DISK, "(base % 500000) / 300e0"),
    ("disk_io_weighted", _DISK, "(base % 600000) / 300e0"),
    ("disk_read", _DISK, "(base * 7) % 900000"),
    ("disk_written", _DISK, "(base * 5) % 900000"),
    ("net_receive", {"device": "nic"}, "(base * 11) % 900000"),
    ("net_transmit", {"device": "nic"}, "(base * 9) % 900000"),
    ("net_receive_drop", {"device": "nic"}, "base % 300000"),
    ("net_transmit_drop", {"device": "nic"}, "base % 200000"),
    ("fs_size", _FS, "100000"),
    ("fs_avail", _FS, "90000 - k * 100"),
]
# Fixed value: the device names that count as disks.
DISK_PATTERN = "mmcblk.p.+|nvme.+|rbd.+|sd.+|vd.+|xvd.+|dm-.+|dasd.+"

BOARDS = {
    "requests": (REQUEST_LABELS, REQUEST_SAMPLES),
    "resources": (RESOURCE_LABELS, RESOURCE_SAMPLES),
    "jobs": (JOB_LABELS, JOB_SAMPLES),
    "control": (CONTROL_LABELS, CONTROL_SAMPLES),
    "nodes": (NODE_LABELS, NODE_SAMPLES),
}

# Event columns that labels refer to; the text suits both engines.
_CHOICES = {
    "kind": ("user_id % 4", ["RealtimeAPI", "AsyncAPI", "BatchAPI", "TaskAPI"]),
    "container": ("event_id % 4", ["api", "proxy", "activator", "POD"]),
    "verb": ("event_id % 4", ["GET", "LIST", "WATCH", "CONNECT"]),
    "resource": ("user_id % 3", ["pods", "nodes", "jobs"]),
    "client": ("user_id % 5", ["kubelet/v1", "operator", "kube-proxy-x", "prometheus", "dashboard"]),
    "device": ("event_id % 3", ["sda", "nvme0n1", "loop0"]),
    "nic": ("event_id % 2", ["eth0", "lo"]),
    "fstype": ("event_id % 5", ["ext4", "xfs", "", "ext4", "xfs"]),
    "mountpoint": ("user_id % 2", ["/", "/data"]),
    "code": ("event_id % 5", ["200", "201", "404", "500", "503"]),
}


def _case(by: str, names: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE {by} {whens} END"


def _columns(concat) -> dict[str, str]:
    out = {name: _case(by, names) for name, (by, names) in _CHOICES.items()}
    out["api"] = concat("'api-'", "user_id % 5")
    out["pod"] = concat("'pod-'", "user_id % 20")
    out["instance"] = concat("'node-'", "user_id % 8")
    out["cpu"] = concat("''", "event_id % 2")
    return out


def board(spark, sf_dir, name: str, tasks: int | None = None) -> DataFrame:
    """``metric, labels..., ts, value`` of a board; unused labels are empty."""
    labels, samples = BOARDS[name]
    events = spread(views.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "props"), tasks)
    texts = _columns(lambda prefix, number: f"concat({prefix}, cast({number} as string))")
    k = F.get_json_object("props", "$.k").cast("long")
    minutes = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60)
    derived = events.select("ts", k.alias("k"), (minutes * 100 + k).alias("base"), *[F.expr(t).alias(n) for n, t in texts.items()])
    fixed = {label: label for label in ("kind", "api", "instance") if label in labels}
    structs = [
        F.struct(
            F.lit(metric).alias("metric"),
            *[F.expr({**fixed, **given}.get(label, "''")).alias(label) for label in labels],
            F.expr(value).cast("double").alias("value"),
        )
        for metric, given, value in samples
    ]
    return derived.select("ts", F.inline(F.array(*structs)))


def _board_sql(name: str) -> str:
    labels, samples = BOARDS[name]
    texts = _columns(lambda prefix, number: f"{prefix} || ({number})::VARCHAR")
    fixed = {label: label for label in ("kind", "api", "instance") if label in labels}
    derived = ", ".join(f"{t} AS {n}" for n, t in texts.items())
    structs = ", ".join(
        "{'metric': '" + metric + "', "
        + ", ".join(f"'{label}': " + {**fixed, **given}.get(label, "''") for label in labels)
        + f", 'value': ({value})::DOUBLE}}"
        for metric, given, value in samples
    )
    return f"""
    SELECT ts, s.* FROM (SELECT ts, unnest([{structs}]) AS s FROM (
      SELECT ts, k, floor(epoch_us(ts) // 1000000 / 60)::BIGINT * 100 + k AS base, {", ".join(texts)}
      FROM (SELECT *, (props->>'$.k')::BIGINT AS k, {derived} FROM events)))"""


for _name in BOARDS:
    view(f"v_board_{_name}", _board_sql(_name))
