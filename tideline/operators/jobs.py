"""Job states, phases, metrics and listings derived from markers, workers and batch runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Job statuses with the text shown to users.
STATUS_MESSAGES = {
    "pending": "pending",
    "enqueuing": "enqueuing",
    "running": "running",
    "enqueue_failed": "failed while enqueuing",
    "completed_with_failures": "completed with failures",
    "succeeded": "succeeded",
    "unexpected_error": "unexpected error",
    "worker_error": "worker error",
    "worker_oom": "out of memory",
    "timed_out": "timed out",
    "stopped": "stopped",
    "unknown": "unknown",
}
# The statuses of a job that has ended.
COMPLETED = [
    "enqueue_failed",
    "completed_with_failures",
    "succeeded",
    "unexpected_error",
    "worker_error",
    "worker_oom",
    "stopped",
    "timed_out",
]
# Which marker decides, strongest first.
BATCH_PRECEDENCE = [
    "timed_out",
    "worker_oom",
    "worker_error",
    "enqueue_failed",
    "unexpected_error",
    "completed_with_failures",
    "succeeded",
    "stopped",
    "running",
    "enqueuing",
    "pending",
]
TASK_PRECEDENCE = ["stopped"] + [s for s in BATCH_PRECEDENCE if s != "stopped"]

# The states workers are counted by.
WORKER_STATES = [
    "Pending",
    "Creating",
    "NotReady",
    "Ready",
    "Succeeded",
    "ErrImagePull",
    "Terminating",
    "Failed",
    "Killed",
    "KilledOOM",
    "Stalled",
    "Unknown",
]


def _lookup(mapping: dict, key: Column) -> Column:
    """The mapping as a constant expression: null for other keys."""
    entries = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(entries, key)


def job_phase(jobs: DataFrame, status: str = "status") -> DataFrame:
    """Phase flags and user text. ``unknown`` is in no phase; ``pending`` is not in progress."""
    code = F.col(status)
    return jobs.withColumns(
        {
            "not_started": code.isin("pending", "enqueuing"),
            "in_progress": code.isin("enqueuing", "running"),
            "completed": code.isin(COMPLETED),
            "status_message": F.coalesce(_lookup(STATUS_MESSAGES, code), F.lit(STATUS_MESSAGES["unknown"])),
        }
    )


def job_state(markers: DataFrame, keys: Sequence[str], precedence: Sequence[str] = BATCH_PRECEDENCE) -> DataFrame:
    """Status and times per job from its marker files.

    The strongest marker gives the status (``unknown`` without any). End time is that marker's
    time if the job is completed; creation and last update are the first and last marker times.
    One partial aggregate, no join and no window.
    """
    rank = _lookup({name: i for i, name in enumerate(precedence)}, F.col("marker"))
    names = F.array(*[F.lit(name) for name in precedence])
    status = F.coalesce(F.get(names, F.col("_rank")), F.lit("unknown"))
    return (
        markers.withColumn("_r", rank)
        .groupBy(*keys)
        .agg(
            F.min("_r").alias("_rank"),
            F.min_by("mtime", "_r").alias("_final"),
            F.min("mtime").alias("created_at"),
            F.max("mtime").alias("updated_at"),
        )
        .select(
            *keys,
            status.alias("status"),
            "created_at",
            "updated_at",
            F.when(status.isin(COMPLETED), F.col("_final")).alias("ended_at"),
        )
    )


def batch_metrics(batches: DataFrame, keys: Sequence[str] = ("job_id",), failed: Column | None = None) -> DataFrame:
    """Succeeded and failed runs per job and the mean time of the successful ones (null if none)."""
    failures = F.count_if(~F.col("ok")) if failed is None else F.sum(failed)
    return batches.groupBy(*keys).agg(
        F.count_if("ok").alias("succeeded"),
        failures.cast("long").alias("failed"),
        F.avg(F.when(F.col("ok"), F.col("secs"))).alias("avg_secs"),
    )


def merge_metrics(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up partial metrics; averages weigh by successes, and null or unweighted ones count nothing."""
    counts = F.col("avg_secs").isNotNull() & (F.col("succeeded") > 0)
    weight = F.sum(F.when(counts, F.col("succeeded")))
    total = F.sum(F.when(counts, F.col("avg_secs") * F.col("succeeded")))
    return partials.groupBy(*keys).agg(
        F.sum("succeeded").alias("succeeded"),
        F.sum("failed").alias("failed"),
        F.try_divide(total, weight).alias("avg_secs"),
    )


def null_safe_stats(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Min and max over the non-null values, and the sum of their whole parts (0 if none)."""
    return values.groupBy(*keys).agg(
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.coalesce(F.sum(F.col(value).cast("long")), F.lit(0)).alias("int_sum"),
    )


def batch_status(jobs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Status of a batch job from its enqueuing state, worker counts and batch metrics.

    ``jobs``: job_id, enqueuing (not_started | in_progress | failed | done), workers,
    workers_failed, workers_succeeded, workers_active, deadline_exceeded, any_oom, status
    (the previous one, kept when nothing applies). ``metrics`` as of :func:`batch_metrics`; its
    columns stay in the result.
    """
    joined = jobs.join(metrics, "job_id", "left")
    all_failed = F.col("workers_failed") == F.col("workers")
    all_done = F.col("workers_succeeded") == F.col("workers")
    enqueue = (
        F.when(F.col("enqueuing") == "not_started", "pending")
        .when(F.col("enqueuing") == "in_progress", "enqueuing")
        .when(F.col("enqueuing") == "failed", "enqueue_failed")
        .otherwise(F.col("status"))
    )
    status = (
        F.when(
            all_failed,
            F.when(F.col("any_oom"), "worker_oom").when(F.col("deadline_exceeded"), "timed_out").otherwise("worker_error"),
        )
        .when(
            all_done,
            F.when(F.coalesce("failed", F.lit(0)) > 0, "completed_with_failures").otherwise("succeeded"),
        )
        .when(F.col("workers_active") > 0, "running")
        .otherwise(enqueue)
    )
    return joined.withColumn("status", status)


def reconcile_tasks(jobs: DataFrame, workers: DataFrame, now: Column, grace_seconds: int = 10) -> DataFrame:
    """New status of in-progress task jobs.

    ``jobs``: job_id, status, running_since, started_at, timeout_s (nullable). ``workers``: one
    row per job: job_id, failed, succeeded, n_pods, any_oom. A job over its timeout is
    ``timed_out`` even if its worker is gone; worker outcomes count only while it runs.
    """
    joined = jobs.join(workers.withColumn("_found", F.lit(True)), "job_id", "left")
    running = F.col("status") == "running"
    late = now > F.col("running_since") + F.make_dt_interval(secs=F.lit(grace_seconds))
    missing = running & late & F.col("_found").isNull()
    over_time = F.col("timeout_s").isNotNull() & (
        now > F.col("started_at") + F.make_dt_interval(secs=F.col("timeout_s"))
    )
    status = (
        F.when(over_time, "timed_out")
        .when(missing, "unexpected_error")
        .when(running & F.col("any_oom"), "worker_oom")
        .when(running & (F.col("failed") == 1), "worker_error")
        .when(running & (F.col("succeeded") == 1) & (F.col("n_pods") > 0), "succeeded")
        .otherwise(F.col("status"))
    )
    return joined.select(*[c for c in jobs.columns if c != "status"], F.col("status").alias("old_status"), status.alias("status"))


def expire(jobs: DataFrame, now: Column, ttl_seconds: int, completed_at: str = "completed_at") -> DataFrame:
    """Jobs completed at least ``ttl_seconds`` before ``now``."""
    return jobs.filter(
        F.col(completed_at).isNotNull()
        & (F.col(completed_at) <= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    )


def retain(samples: DataFrame, now: Column, days: int = 14, ts: str = "ts") -> DataFrame:
    """Samples within the retention time; the bound reaches the scan."""
    return samples.filter(F.col(ts) > now - F.make_dt_interval(days=F.lit(days)))


def worker_counts(pods: DataFrame, jobs: DataFrame | None = None, job: str = "job_id") -> DataFrame:
    """Workers per job and state. ``pods`` needs ``status`` and ``is_ready``.

    ``jobs`` (job id, failed, parallelism) applies the rule for tasks: once a worker failed,
    the job reports ``Failed = parallelism`` and nothing else.
    """
    state = F.when(F.col("is_ready"), "Ready").when(F.col("status") != "Ready", F.col("status"))
    counted = pods.withColumn("_state", state)
    counts = counted.groupBy(job).agg(*[F.count_if(F.col("_state") == s).cast("int").alias(s) for s in WORKER_STATES])
    if jobs is None:
        return counts
    joined = jobs.select(job, F.col("failed").alias("_failed"), "parallelism").join(counts, job, "left")
    failed = F.col("_failed") > 0

    def column(state: str) -> Column:
        shown = F.col("parallelism") if state == "Failed" else F.lit(0)
        return F.when(failed, shown).otherwise(F.coalesce(state, F.lit(0))).cast("int").alias(state)

    return joined.select(job, *[column(s) for s in WORKER_STATES])


# The states replicas are counted by.
REPLICA_STATES = ["Pending", "Stalled", "Creating", "NotReady", "ErrImagePull", "Failed", "Killed", "KilledOOM", "Unknown"]


def replica_counts(pods: DataFrame, deployments: DataFrame) -> DataFrame:
    """Replica counts per API. ``pods``: api_name, spec_id, status, is_ready; ``deployments``:
    api_name, spec_id (latest), requested. Ready pods of an older spec are out of date;
    terminating ones count for both; other states count for the latest spec only."""
    joined = deployments.join(
        pods.select("api_name", F.col("spec_id").alias("_pod_spec"), "status", "is_ready"), "api_name", "left"
    )
    latest = F.col("_pod_spec") == F.col("spec_id")
    ready, status = F.col("is_ready"), F.col("status")
    terminating = ~ready & (status == "Terminating")
    other = ~ready & latest
    counts = [
        F.count_if((ready & latest) | (other & (status == "Ready"))).alias("Ready"),
        F.count_if(ready & ~latest).alias("ReadyOutOfDate"),
        F.count_if(terminating).alias("Terminating"),
        *[F.count_if(other & (status == s)).alias(s) for s in REPLICA_STATES],
    ]
    totals = joined.groupBy("api_name", "spec_id", "requested").agg(*counts)
    broken = sum((F.col(s) for s in ["ErrImagePull", "Failed", "Killed", "KilledOOM", "Unknown"]), F.lit(0))
    return totals.withColumn("total_failed", broken.cast("long"))


def recent_jobs(files: DataFrame, n: int, api: str = "api_name", job: str = "job_id") -> DataFrame:
    """The ``n`` newest jobs of each API; ids sort newest first, and jobs without ``spec.json`` do not count.

    The rank limit is applied before the shuffle too, so a busy API ships ``n`` rows per task.
    """
    listed = files.groupBy(api, job).agg(
        F.max(F.col("marker") == "spec.json").alias("_has_spec"), F.count(F.lit(1)).alias("n_files")
    )
    order = F.row_number().over(Window.partitionBy(api).orderBy(job))
    return listed.filter("_has_spec").drop("_has_spec").withColumn("place", order).filter(F.col("place") <= n)


def latest_job(jobs: DataFrame, api: str = "api_name") -> DataFrame:
    """Per API: running jobs, and the job that started last (the greatest id among ties).

    Ties are settled per start time first, so both steps are hash aggregates.
    """
    per_start = jobs.groupBy(api, "started_at").agg(
        F.count_if(F.col("status") == "running").alias("_running"), F.max("job_id").alias("job_id")
    )
    return per_start.groupBy(api).agg(
        F.sum("_running").alias("running"),
        F.max_by("job_id", "started_at").alias("latest_job"),
        F.max("started_at").alias("latest_start"),
    )


def api_overview(apis: DataFrame, active: DataFrame, stored: DataFrame) -> DataFrame:
    """For each API its active jobs, else the newest stored one (if any). Columns api_name, job_id, origin."""
    return _fill(apis, active, stored, 1, only_if_none=True)


def api_detail(apis: DataFrame, active: DataFrame, stored: DataFrame, n: int = 10) -> DataFrame:
    """Active jobs, filled up to ``n`` with the newest stored ones that are not active."""
    return _fill(apis, active, stored, n, only_if_none=False)


def _fill(apis: DataFrame, active: DataFrame, stored: DataFrame, n: int, only_if_none: bool) -> DataFrame:
    names = apis.select("api_name").distinct()
    live = active.select("api_name", "job_id").join(names, "api_name", "left_semi")
    others = stored.select("api_name", "job_id").join(names, "api_name", "left_semi")
    if not only_if_none:
        others = others.join(live, ["api_name", "job_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("api_name").orderBy("job_id"))
    newest = others.withColumn("_place", place).filter(F.col("_place") <= n)
    counts = live.groupBy("api_name").agg(F.count(F.lit(1)).alias("_live"))
    fill = newest.join(counts, "api_name", "left").filter(F.col("_place") <= n - F.coalesce("_live", F.lit(0)))
    return live.withColumn("origin", F.lit("active")).unionByName(
        fill.select("api_name", "job_id", F.lit("stored").alias("origin"))
    )


def task_overview(apis: DataFrame, in_progress: DataFrame, stored: DataFrame) -> DataFrame:
    """For each API its newest stored job, and the in-progress jobs besides."""
    names = apis.select("api_name").distinct()
    place = F.row_number().over(Window.partitionBy("api_name").orderBy("job_id"))
    newest = (
        stored.select("api_name", "job_id")
        .join(names, "api_name", "left_semi")
        .withColumn("_place", place)
        .filter("_place = 1")
        .drop("_place")
    )
    more = (
        in_progress.select("api_name", "job_id")
        .join(names, "api_name", "left_semi")
        .join(newest, ["api_name", "job_id"], "left_anti")
    )
    return newest.withColumn("origin", F.lit("stored")).unionByName(more.withColumn("origin", F.lit("in_progress")))


def orphans(expected: DataFrame, actual: DataFrame, key: str = "job_id") -> DataFrame:
    """Keys on one side only: ``missing_worker`` (expected, not there) or ``missing_job``."""
    want, have = expected.select(key).distinct(), actual.select(key).distinct()
    return (
        want.join(have, key, "left_anti")
        .withColumn("problem", F.lit("missing_worker"))
        .unionByName(have.join(want, key, "left_anti").withColumn("problem", F.lit("missing_job")))
    )


def evicted_twice(snapshots: DataFrame, pod: str = "pod_id", number: str = "snapshot_no") -> DataFrame:
    """Evicted pods that the previous snapshot listed as evicted too.

    A pod found twice is taken off the list, so in a longer run of evictions every second
    snapshot reports it. ``snapshots`` holds evicted pods only.
    """
    seen = snapshots.select(pod, number).distinct()
    order = Window.partitionBy(pod).orderBy(number)
    runs = seen.withColumn("_run", F.col(number) - F.row_number().over(order))
    place = F.row_number().over(Window.partitionBy(pod, "_run").orderBy(number))
    return runs.withColumn("_place", place).filter("_place % 2 = 0").select(pod, number)
