"""Queries for execution, job states, asynchronous requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import pods as pod_fn
from tideline.operators import asyncreq, batching, execute, jobs, ordering
from tideline.plans import views
from tideline.plans.registry import query
from tideline.plans.views_sql import view
from tideline.session import fresh_path
from tideline.sources.items import reject_oversize

NOW = "TIMESTAMP '2001-08-01 12:00:00'"


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


# ---- pods with conditions and container states, derived from the customer table

view(
    "v_podspec_raw",
    """
    SELECT c_custkey AS pod_id, c_custkey % 97 AS job_id, c_mktsegment AS api_name, c_custkey % 3 AS spec_id,
      CASE c_custkey % 6 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Succeeded' WHEN 2 THEN 'Failed' WHEN 5 THEN 'Odd'
           ELSE 'Running' END AS phase,
      CASE WHEN c_custkey % 13 = 0 THEN 'Evicted' END AS reason,
      CASE WHEN c_custkey % 2 = 0 THEN 'The node was LOW on resource: memory' ELSE 'disk full' END AS message,
      c_custkey % 17 = 0 AS deleted,
      c_custkey % 4 = 0 AS unscheduled, c_custkey % 40 AS changed_min, c_custkey % 5 = 0 AS ready,
      c_custkey % 9 <> 0 AS has_init, c_custkey % 11 <> 0 AS has_containers,
      [c_custkey // 3 % 9, c_custkey // 5 % 9] AS codes
    FROM customer
    """,
)
# Container codes: 0 ready, 1 not ready, 2 exit 0, 3 exit 137, 4 exit 1 out of memory, 5 earlier exit 143,
# 6 creating, 7 image error, 8 waiting.
view(
    "v_podspec",
    """
    SELECT *, [x for x in codes if has_containers] AS cs,
      list_filter(codes, lambda c: c IN (3, 4, 5)) AS deaths
    FROM v_podspec_raw
    """,
    "v_podspec_raw",
)
view(
    "v_podstatus",
    """
    SELECT *, CASE
        WHEN phase = 'Pending' AND unscheduled AND changed_min <= 15 THEN 'Stalled'
        WHEN phase = 'Pending' THEN CASE WHEN n_all = 0 THEN 'Pending' WHEN of_cs = 'Succeeded' AND has_containers THEN 'Succeeded'
             WHEN NOT has_containers THEN 'Succeeded' ELSE of_cs END
        WHEN phase = 'Succeeded' THEN 'Succeeded'
        WHEN phase = 'Failed' AND reason = 'Evicted' AND message LIKE '%memory%' THEN 'KilledOOM'
        WHEN phase = 'Failed' AND has_containers AND len(deaths) > 0 THEN CASE WHEN deaths[1] = 4 THEN 'KilledOOM' ELSE 'Killed' END
        WHEN phase = 'Failed' THEN 'Failed'
        WHEN phase = 'Running' AND deleted THEN 'Terminating'
        WHEN phase = 'Running' AND ready THEN 'Ready'
        WHEN phase = 'Running' AND of_cs = 'Ready' THEN 'NotReady'
        WHEN phase = 'Running' THEN of_cs
        ELSE 'Unknown' END AS status
    FROM (SELECT *, (CASE WHEN has_init THEN 1 ELSE 0 END) + len(cs) AS n_all,
        CASE WHEN len(cs) = 0 THEN 'Pending' WHEN list_contains(cs, 7) THEN 'ErrImagePull'
             WHEN list_contains(cs, 4) THEN 'KilledOOM' WHEN list_contains(cs, 3) OR list_contains(cs, 5) THEN 'Killed'
             WHEN list_contains(cs, 8) THEN 'Pending' WHEN len(list_filter(cs, lambda c: c <> 2)) = 0 THEN 'Succeeded'
             WHEN list_contains(cs, 6) THEN 'Creating' WHEN list_contains(cs, 1) THEN 'NotReady' ELSE 'Ready' END AS of_cs
      FROM v_podspec)
    """,
    "v_podspec",
)


def pod_specs(spark, sf_dir):
    key = F.col("c_custkey")

    def container(code):
        return F.struct(
            code.isin(0, 1).alias("running"),
            (code == 0).alias("ready"),
            F.when(code == 6, "ContainerCreating").when(code == 7, "ErrImagePull").when(code == 8, "Other").alias("waiting"),
            F.when(code == 2, 0).when(code == 3, 137).when(code == 4, 1).alias("exit_code"),
            F.when(code == 4, "OOMKilled").alias("exit_reason"),
            F.when(code == 5, 143).alias("last_exit_code"),
            F.lit(None).cast("string").alias("last_exit_reason"),
        )

    def condition(kind, holds, minutes):
        at = ntz("2024-01-01 00:00:00") + F.make_dt_interval(mins=minutes)
        return F.struct(
            F.lit(kind).alias("type"), F.when(holds, "True").otherwise("False").alias("status"), at.alias("changed_at")
        )

    containers = F.array(container(F.floor(key / 3) % 9), container(F.floor(key / 5) % 9))
    phase = (
        F.when(key % 6 == 0, "Pending")
        .when(key % 6 == 1, "Succeeded")
        .when(key % 6 == 2, "Failed")
        .when(key % 6 == 5, "Odd")
        .otherwise("Running")
    )
    return views.table(spark, sf_dir, "customer").select(
        key.alias("pod_id"),
        (key % 97).alias("job_id"),
        F.col("c_mktsegment").alias("api_name"),
        (key % 3).alias("spec_id"),
        phase.alias("phase"),
        F.when(key % 13 == 0, "Evicted").alias("reason"),
        F.when(key % 2 == 0, "The node was LOW on resource: memory").otherwise("disk full").alias("message"),
        (key % 17 == 0).alias("deleted"),
        F.array(
            condition("PodScheduled", key % 4 != 0, (key % 40).cast("int")), condition("Ready", key % 5 == 0, F.lit(0))
        ).alias("conditions"),
        F.slice(F.array(container(F.lit(2))), F.lit(1), F.when(key % 9 == 0, 0).otherwise(1)).alias("init_containers"),
        F.slice(containers, F.lit(1), F.when(key % 11 == 0, 0).otherwise(2)).alias("containers"),
    )


def pod_statuses(spark, sf_dir):
    status = pod_fn.pod_status(ntz("2024-01-01 00:30:00"))
    classified = pod_specs(spark, sf_dir).withColumn("status", status)
    return classified.withColumn("is_ready", (F.col("status") == "Ready") & pod_fn.ready_condition())


@query("prj_4", "SELECT pod_id, phase, status FROM v_podstatus", "v_podstatus")
def prj_4(spark, sf_dir):
    return pod_statuses(spark, sf_dir).select("pod_id", "phase", "status")


STATE_COUNTS = ", ".join(f"count(*) FILTER (st = '{s}')::INTEGER AS \"{s}\"" for s in jobs.WORKER_STATES)


@query(
    "agg_5",
    f"""
    WITH w AS (SELECT job_id, CASE WHEN status = 'Ready' AND NOT ready THEN NULL ELSE status END AS st FROM v_podstatus),
    c AS (SELECT job_id, {STATE_COUNTS} FROM w GROUP BY 1)
    SELECT j.job_id, {", ".join(
        f'CASE WHEN j.failed > 0 THEN {"4" if s == "Failed" else "0"} ELSE coalesce(c."{s}", 0) END::INTEGER AS "{s}"'
        for s in jobs.WORKER_STATES)}
    FROM (SELECT DISTINCT o_orderkey % 120 AS job_id, (o_orderkey % 120) % 6 // 5 AS failed FROM orders) j LEFT JOIN c USING (job_id)
    """,
    "v_podstatus",
)
def agg_5(spark, sf_dir):
    key = F.col("o_orderkey") % 120
    job_rows = views.table(spark, sf_dir, "orders").select(
        key.alias("job_id"), F.floor(key % 6 / 5).alias("failed"), F.lit(4).alias("parallelism")
    )
    return jobs.worker_counts(pod_statuses(spark, sf_dir), job_rows.distinct())


@query(
    "agg_6",
    f"""
    SELECT p.api_name, d.spec_id, d.requested,
      count(*) FILTER ((rd AND latest) OR (NOT rd AND latest AND status = 'Ready')) AS "Ready",
      count(*) FILTER (rd AND NOT latest) AS "ReadyOutOfDate",
      count(*) FILTER (NOT rd AND status = 'Terminating') AS "Terminating",
      {", ".join(f"count(*) FILTER (NOT rd AND latest AND status = '{s}') AS \"{s}\"" for s in jobs.REPLICA_STATES)},
      count(*) FILTER (NOT rd AND latest AND status IN ('ErrImagePull', 'Failed', 'Killed', 'KilledOOM', 'Unknown')) AS total_failed
    FROM (SELECT *, status = 'Ready' AND ready AS rd, spec_id = 2 AS latest FROM v_podstatus) p
    JOIN (SELECT DISTINCT c_mktsegment AS api_name, 2::BIGINT AS spec_id, 5 AS requested FROM customer) d ON p.api_name = d.api_name
    GROUP BY 1, 2, 3
    """,
    "v_podstatus",
)
def agg_6(spark, sf_dir):
    names = views.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("api_name")).distinct()
    deployed = names.select("api_name", F.lit(2).cast("long").alias("spec_id"), F.lit(5).alias("requested"))
    return jobs.replica_counts(pod_statuses(spark, sf_dir), deployed)


# ---- batch execution


def _outcome(config):
    """A handler that fails for rejected batches: the row says which."""

    def handler(row):
        if not row["ok_input"]:
            raise ValueError("rejected")
        return round(row["amount"] * config["factor"], 2)

    return handler


def _batch_input(spark, sf_dir):
    return views.batches(spark, sf_dir).select(
        "job_id", F.col("batch_no").alias("batch_id"), F.col("ok").alias("ok_input"), "amount"
    )


@query(
    "exe_1",
    """
    SELECT job_id, batch_no AS batch_id, ok, CASE WHEN ok THEN amount * 2 END AS result,
           CASE WHEN NOT ok THEN 'ValueError: rejected' END AS error
    FROM v_batches
    """,
    "v_batches",
)
def exe_1(spark, sf_dir):
    runs = execute.run_batches(_batch_input(spark, sf_dir), _outcome, {"factor": 2})
    return runs.select("job_id", "batch_id", "ok", F.col("result").cast("double").alias("result"), "error")


@query(
    "exe_2",
    """
    SELECT job_id, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed,
           CASE WHEN count(*) FILTER (NOT ok) > 0 THEN 'completed_with_failures' ELSE 'succeeded' END AS status
    FROM v_batches GROUP BY 1
    """,
    "v_batches",
)
def exe_2(spark, sf_dir):
    runs = execute.run_batches(_batch_input(spark, sf_dir), _outcome, {"factor": 1})
    metrics = jobs.batch_metrics(runs).select("job_id", "succeeded", "failed")
    return metrics.withColumn("status", F.when(F.col("failed") > 0, "completed_with_failures").otherwise("succeeded"))


@query(
    "exe_3",
    """
    SELECT job_id, batch_no AS batch_id, CASE WHEN ok THEN 1 ELSE 3 END AS attempts, NOT ok AS dead_letter,
           CASE WHEN ok THEN 0 ELSE 3 END AS failed_attempts
    FROM v_batches
    """,
    "v_batches",
)
def exe_3(spark, sf_dir):
    runs = execute.run_with_dead_letters(_batch_input(spark, sf_dir), _outcome, 3, {"factor": 1})
    return runs.select("job_id", "batch_id", "attempts", "dead_letter", "failed_attempts")


@query(
    "exe_4",
    """
    SELECT l_linestatus AS state, count(*) AS n_batches, count(*) FILTER (ok) AS n_ok,
           sum((amount * 100)::BIGINT)::BIGINT AS cents
    FROM v_batches GROUP BY 1
    """,
    "v_batches",
)
def exe_4(spark, sf_dir):
    """The hook, called once on the stored results, gives the query's result."""
    runs = views.batches(spark, sf_dir).select("l_linestatus", "ok", "amount")

    def hook(stored):
        return stored.groupBy(F.col("l_linestatus").alias("state")).agg(
            F.count(F.lit(1)).alias("n_batches"),
            F.count_if("ok").alias("n_ok"),
            F.sum(F.round(F.col("amount") * 100).cast("long")).alias("cents"),
        )

    return execute.on_complete(runs, fresh_path(spark, "runs"), hook)


def _second_try(_config):
    """The sum of a batch; every third sum fails on its first try."""
    tried = set()

    def handler(row):
        total = int(sum(row["items"]))
        name = row["job_id"], row["batch_id"]
        if total % 3 == 0 and name not in tried:
            tried.add(name)
            raise RuntimeError("not yet")
        return total

    return handler


BODY_LIMIT = 256 * 1024


@query(
    "job_run",
    f"""
    WITH i AS (SELECT source, strlen(body) AS x, row_number() OVER (PARTITION BY source ORDER BY item_id) - 1 AS pos
               FROM v_items WHERE strlen(body) <= {BODY_LIMIT}),
    b AS (SELECT source, pos // 20 AS batch_id, count(*) AS n, sum(x) AS total FROM i GROUP BY 1, 2)
    SELECT source AS job_id, sum(n)::BIGINT AS n_items, ceil(sum(n) / 20)::BIGINT AS succeeded, 0::BIGINT AS dead,
           count(*) FILTER (total % 3 = 0)::BIGINT AS failed_attempts, sum(total)::BIGINT AS total, 'succeeded' AS status, 1::BIGINT AS hook_calls
    FROM b GROUP BY 1
    """,
    "v_items",
)
def job_run(spark, sf_dir):
    """Jobs from submission to completion, run twice: items, size check, batches of real lists, a handler that needs a
    second try, stored results, and a hook that is called once."""
    items = reject_oversize(views.items(spark, sf_dir), "body", BODY_LIMIT, mode="reject").filter("accepted")
    items = items.select(F.col("source").alias("job_id"), "item_id", F.col("bytes").alias("item"))
    placed = ordering.numbered(items, ["job_id"], ["item_id"], F.floor(F.col("item_id") / 10_000))
    lists = batching.collect_batches(batching.assign_batches(placed, 20), "item", ["job_id"])
    runs = execute.run_with_dead_letters(lists, _second_try, 3, keep=("job_id", "batch_id", "items"))
    path, calls = fresh_path(spark, "job-results"), fresh_path(spark, "hook-calls")

    def hook(stored):
        finished = stored.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
        finished.write.mode("append").parquet(calls)

    for _ in range(2):
        execute.on_complete(runs, path, hook)
    stored = spark.read.parquet(path)
    done = stored.groupBy("job_id").agg(
        F.sum(F.size("items")).cast("long").alias("n_items"),
        F.count_if("ok").alias("succeeded"),
        F.count_if("dead_letter").alias("dead"),
        F.sum("failed_attempts").cast("long").alias("failed_attempts"),
        F.sum(F.col("result").cast("long")).alias("total"),
    )
    hooked = spark.read.parquet(calls).groupBy("job_id").agg(F.count(F.lit(1)).alias("hook_calls"))
    status = F.when(F.col("dead") > 0, "completed_with_failures").otherwise("succeeded")
    return done.withColumn("status", status).join(hooked, "job_id")


@query(
    "exe_5",
    """
    SELECT job_id, batch_id, sum(x)::BIGINT AS total FROM (
      SELECT l_orderkey AS job_id, l_partkey AS x, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
             l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1) // 2 AS batch_id FROM lineitem)
    GROUP BY 1, 2
    """,
)
def exe_5(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    rows = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), *order)
    bucket = F.struct("l_linenumber", F.floor(F.col("l_partkey") / 1000).alias("p"))
    placed = ordering.numbered(rows, ["job_id"], order, bucket)
    lists = batching.collect_batches(batching.assign_batches(placed, 2), "l_partkey", ["job_id"])
    return execute.sum_items(lists).select("job_id", "batch_id", "total")


@query(
    "exe_6",
    """
    WITH d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT label, i, avg(x) AS x FROM d GROUP BY 1, 2),
    s AS (SELECT d.vec_id, c.label, sum(d.x * c.x) AS score FROM d JOIN c USING (i) GROUP BY 1, 2)
    SELECT vec_id, arg_max(label, score)::BIGINT AS class FROM s GROUP BY 1
    """,
)
def exe_6(spark, sf_dir):
    """Vectors classified by the centroid with the highest score."""
    vectors = views.vectors(spark, sf_dir)
    scored = execute.classify(vectors, execute.centroids(vectors))
    return scored.select("vec_id", F.col("class").cast("long").alias("class"))


#: The least accuracy on held-out rows that counts as learned.
ACCURATE = 0.8


@query(
    "exe_7",
    """
    SELECT count(*) FILTER (part > 0) AS n_train, count(*) FILTER (part = 0) AS n_test, true AS accurate
    FROM (SELECT ('0x' || substr(md5('split' || vec_id::VARCHAR), 1, 8))::BIGINT % 4 AS part FROM embeddings)
    """,
)
def exe_7(spark, sf_dir):
    """A classifier of which of a vector's first five components is the largest; the given labels are noise."""
    first = F.slice(F.col("embedding"), 1, 5)
    vectors = views.vectors(spark, sf_dir).withColumn("first", first)
    vectors = vectors.withColumn("label", F.array_position("first", F.array_max("first")))
    scored = execute.train_classifier(vectors, fresh_path(spark, "model"), features="first")
    return scored.select("n_train", "n_test", (F.col("accuracy") >= ACCURATE).alias("accurate"))


@query(
    "exe_8",
    """
    SELECT api_name, count(*) FILTER (o_orderstatus <> 'P') AS succeeded, count(*) FILTER (o_orderstatus = 'P') AS failed,
           avg(CASE WHEN o_orderstatus <> 'P' THEN (job_id % 600)::DOUBLE END) AS avg_secs
    FROM v_jobs GROUP BY 1
    """,
    "v_jobs",
)
def exe_8(spark, sf_dir):
    runs = views.jobs(spark, sf_dir).select(
        "api_name", (F.col("o_orderstatus") != "P").alias("ok"), (F.col("job_id") % 600).cast("double").alias("secs")
    )
    return jobs.batch_metrics(runs, ["api_name"])


# ---- metrics and states


@query(
    "agg_2",
    """
    SELECT job_id, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed,
           avg(secs) FILTER (ok) AS avg_secs
    FROM v_batches GROUP BY 1
    """,
    "v_batches",
)
def agg_2(spark, sf_dir):
    return jobs.batch_metrics(views.batch_runs(spark, sf_dir))


@query(
    "agg_3",
    """
    WITH p AS (SELECT job_id, l_linestatus, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed,
                      avg(secs) FILTER (ok) AS avg_secs FROM v_batches GROUP BY 1, 2)
    SELECT job_id, sum(succeeded)::BIGINT AS succeeded, sum(failed)::BIGINT AS failed,
      round(sum(avg_secs * succeeded) FILTER (avg_secs IS NOT NULL AND succeeded > 0)
        / sum(succeeded) FILTER (avg_secs IS NOT NULL AND succeeded > 0), 5) AS avg_secs
    FROM p GROUP BY 1
    """,
    "v_batches",
)
def agg_3(spark, sf_dir):
    partials = jobs.batch_metrics(views.batch_runs(spark, sf_dir), ["job_id", "l_linestatus"])
    return jobs.merge_metrics(partials, ["job_id"]).withColumn("avg_secs", F.round("avg_secs", 5))


@query(
    "agg_4",
    """
    SELECT job_id, min(v) AS min_value, max(v) AS max_value, coalesce(sum(trunc(v)::BIGINT), 0)::BIGINT AS int_sum
    FROM (SELECT job_id, CASE WHEN ok THEN amount / 7 END AS v FROM v_batches) GROUP BY 1
    """,
    "v_batches",
)
def agg_4(spark, sf_dir):
    rows = views.batch_runs(spark, sf_dir).select("job_id", F.when(F.col("ok"), F.col("amount") / 7).alias("v"))
    return jobs.null_safe_stats(rows, ["job_id"], "v")


def rank_sql(names):
    return "CASE marker " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names)) + " END"


DONE_SQL = "(" + ", ".join(f"'{s}'" for s in jobs.COMPLETED) + ")"

view(
    "v_job_state",
    f"""
    SELECT kind, job_id, coalesce(arg_min(marker, r) FILTER (r IS NOT NULL), 'unknown') AS status,
           min(mtime) AS created_at, max(mtime) AS updated_at, arg_min(mtime, r) FILTER (r IS NOT NULL) AS final_at
    FROM (SELECT 'batch' AS kind, *, {rank_sql(jobs.BATCH_PRECEDENCE)} AS r FROM v_markers
          UNION ALL SELECT 'task', *, {rank_sql(jobs.TASK_PRECEDENCE)} FROM v_markers)
    GROUP BY 1, 2
    """,
    "v_markers",
)


def job_states(spark, sf_dir):
    marks = views.markers(spark, sf_dir)
    batch = jobs.job_state(marks, ["job_id"]).withColumn("kind", F.lit("batch"))
    return batch.unionByName(
        jobs.job_state(marks, ["job_id"], jobs.TASK_PRECEDENCE).withColumn("kind", F.lit("task"))
    )


@query("agg_7", "SELECT kind, job_id, status FROM v_job_state", "v_job_state")
def agg_7(spark, sf_dir):
    return job_states(spark, sf_dir).select("kind", "job_id", "status")


@query(
    "agg_8",
    f"""
    SELECT kind, job_id, created_at, updated_at, CASE WHEN status IN {DONE_SQL} THEN final_at END AS ended_at
    FROM v_job_state
    """,
    "v_job_state",
)
def agg_8(spark, sf_dir):
    return job_states(spark, sf_dir).select("kind", "job_id", "created_at", "updated_at", "ended_at")


MESSAGE_SQL = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in jobs.STATUS_MESSAGES.items()) + " END"


@query(
    "prj_5",
    f"""
    SELECT job_id, status, status IN ('pending', 'enqueuing') AS not_started, status IN ('enqueuing', 'running') AS in_progress,
           status IN {DONE_SQL} AS completed, {MESSAGE_SQL} AS status_message
    FROM v_job_state WHERE kind = 'batch'
    """,
    "v_job_state",
)
def prj_5(spark, sf_dir):
    states = jobs.job_state(views.markers(spark, sf_dir), ["job_id"]).select("job_id", "status")
    return jobs.job_phase(states)


@query(
    "prj_6",
    """
    SELECT pod_id, api_name, kind, 'include' AS mode FROM v_pods WHERE kind IN ('RealtimeAPI', 'AsyncAPI')
    UNION ALL SELECT pod_id, api_name, kind, 'exclude' FROM v_pods WHERE kind NOT IN ('RealtimeAPI')
    """,
    "v_pods",
)
def prj_6(spark, sf_dir):
    from tideline.operators.apis import filter_kind

    rows = views.pods(spark, sf_dir).select("pod_id", "api_name", "kind")
    kept = filter_kind(rows, include=["RealtimeAPI", "AsyncAPI"]).withColumn("mode", F.lit("include"))
    return kept.unionByName(filter_kind(rows, exclude=["RealtimeAPI"]).withColumn("mode", F.lit("exclude")))


@query(
    "prj_9",
    f"""
    SELECT job_id, status FROM v_job_state WHERE kind = 'batch' AND status IN {DONE_SQL}
      AND final_at <= {NOW} - INTERVAL 40 DAY
    """,
    "v_job_state",
)
def prj_9(spark, sf_dir):
    states = jobs.job_state(views.markers(spark, sf_dir), ["job_id"])
    return jobs.expire(states, ntz("2001-08-01 12:00:00"), 40 * 86400, "ended_at").select("job_id", "status")


@query(
    "prj_9_retention",
    "SELECT request_id, ts FROM v_requests WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY",
    "v_requests",
)
def prj_9_retention(spark, sf_dir):
    rows = views.requests(spark, sf_dir).select("request_id", "ts")
    return jobs.retain(rows, ntz("2024-01-31 00:00:00"))


@query(
    "prj_10",
    f"""
    WITH j AS (SELECT job_id, CASE o_orderstatus WHEN 'O' THEN 'running' ELSE 'enqueuing' END AS status,
                 submitted_at AS running_since, submitted_at AS started_at,
                 CASE WHEN job_id % 4 = 0 THEN 86400 * (job_id % 900) END AS timeout_s FROM v_jobs WHERE o_orderstatus <> 'F'),
    w AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN -l_orderkey ELSE l_orderkey END AS job_id, max(l_linenumber) FILTER (l_returnflag = 'R') AS f, count(*) AS n_pods,
                 CASE WHEN count(*) FILTER (l_returnflag = 'R') = 1 THEN 1 ELSE 0 END AS failed,
                 CASE WHEN count(*) FILTER (l_returnflag = 'A') = 1 THEN 1 ELSE 0 END AS succeeded,
                 max(l_quantity) >= 50 AS any_oom
          FROM lineitem GROUP BY 1)
    SELECT job_id, status AS old_status,
      CASE WHEN timeout_s IS NOT NULL AND {NOW} > started_at + to_seconds(timeout_s) THEN 'timed_out'
           WHEN status = 'running' AND {NOW} > running_since + INTERVAL 10 SECOND AND w.n_pods IS NULL THEN 'unexpected_error'
           WHEN status = 'running' AND any_oom THEN 'worker_oom'
           WHEN status = 'running' AND failed = 1 THEN 'worker_error'
           WHEN status = 'running' AND succeeded = 1 AND n_pods > 0 THEN 'succeeded'
           ELSE status END AS status
    FROM j LEFT JOIN w USING (job_id)
    """,
    "v_jobs",
)
def prj_10(spark, sf_dir):
    """A third of the jobs have no workers: theirs carry the label of another job."""
    rows = views.jobs(spark, sf_dir).filter("o_orderstatus <> 'F'")
    job_rows = rows.select(
        "job_id",
        F.when(F.col("o_orderstatus") == "O", "running").otherwise("enqueuing").alias("status"),
        F.col("submitted_at").alias("running_since"),
        F.col("submitted_at").alias("started_at"),
        F.when(F.col("job_id") % 4 == 0, 86400 * (F.col("job_id") % 900)).alias("timeout_s"),
    )
    flag = F.col("l_returnflag")
    workers = (
        views.table(spark, sf_dir, "lineitem")
        .groupBy(F.when(F.col("l_orderkey") % 3 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("job_id"))
        .agg(
            F.count(F.lit(1)).alias("n_pods"),
            (F.count_if(flag == "R") == 1).cast("int").alias("failed"),
            (F.count_if(flag == "A") == 1).cast("int").alias("succeeded"),
            (F.max("l_quantity") >= 50).alias("any_oom"),
        )
    )
    done = jobs.reconcile_tasks(job_rows, workers, ntz("2001-08-01 12:00:00"))
    return done.select("job_id", "old_status", "status")


view(
    "v_job_workers",
    """
    SELECT l_orderkey AS job_id, 2 AS workers, least(2, count(*) FILTER (l_quantity >= 45))::INTEGER AS workers_failed,
           least(2, count(*) FILTER (l_quantity < 25))::INTEGER AS workers_succeeded, 1 AS workers_active,
           max(l_discount) >= 0.1 AS deadline_exceeded, max(l_tax) >= 0.08 AS any_oom
    FROM lineitem GROUP BY 1
    """,
)
BATCH_STATUS_SQL = """
    CASE WHEN workers_failed = workers THEN CASE WHEN any_oom THEN 'worker_oom' WHEN deadline_exceeded THEN 'timed_out'
              ELSE 'worker_error' END
         WHEN workers_succeeded = workers THEN CASE WHEN coalesce(m.failed, 0) > 0 THEN 'completed_with_failures' ELSE 'succeeded' END
         WHEN workers_active > 0 THEN 'running'
         WHEN o_orderstatus = 'P' AND j.job_id % 2 = 0 THEN 'pending' WHEN o_orderstatus = 'P' THEN 'enqueuing'
         WHEN o_orderstatus = 'O' AND j.job_id % 7 = 0 THEN 'enqueue_failed' ELSE 'unknown' END
"""
JOB_REPORT_SQL = f"""
    WITH m AS (SELECT job_id, count(*) AS n_batches, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed,
                      avg(secs) FILTER (ok) AS avg_secs FROM v_batches GROUP BY 1)
    SELECT j.job_id, j.api_name, m.n_batches, m.succeeded, m.failed, m.avg_secs, {BATCH_STATUS_SQL} AS status
    FROM v_jobs j LEFT JOIN v_job_workers w USING (job_id) LEFT JOIN m USING (job_id)
"""


def _job_table(spark, sf_dir):
    """Jobs with enqueuing state and worker counts."""
    quantity = F.col("l_quantity")
    workers = (
        views.table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("job_id"))
        .agg(
            F.lit(2).alias("workers"),
            F.least(F.lit(2), F.count_if(quantity >= 45)).cast("int").alias("workers_failed"),
            F.least(F.lit(2), F.count_if(quantity < 25)).cast("int").alias("workers_succeeded"),
            F.lit(1).alias("workers_active"),
            (F.max("l_discount") >= 0.1).alias("deadline_exceeded"),
            (F.max("l_tax") >= 0.08).alias("any_oom"),
        )
    )
    state = F.col("o_orderstatus")
    enqueuing = (
        F.when((state == "P") & (F.col("job_id") % 2 == 0), "not_started")
        .when(state == "P", "in_progress")
        .when((state == "O") & (F.col("job_id") % 7 == 0), "failed")
        .otherwise("done")
    )
    listed = views.jobs(spark, sf_dir).select(
        "job_id", "api_name", enqueuing.alias("enqueuing"), F.lit("unknown").alias("status")
    )
    return listed.join(workers, "job_id", "left")


@query(
    "prj_11",
    f"SELECT job_id, status FROM ({JOB_REPORT_SQL})",
    "v_jobs v_batches v_job_workers",
)
def prj_11(spark, sf_dir):
    metrics = jobs.batch_metrics(views.batch_runs(spark, sf_dir))
    return jobs.batch_status(_job_table(spark, sf_dir), metrics).select("job_id", "status")


@query("job_report", JOB_REPORT_SQL, "v_jobs v_batches v_job_workers")
def job_report(spark, sf_dir):
    """Per job: batches, successes, failures, mean time, final status."""
    metrics = jobs.batch_metrics(views.batch_runs(spark, sf_dir)).withColumn(
        "n_batches", F.col("succeeded") + F.col("failed")
    )
    report = jobs.batch_status(_job_table(spark, sf_dir), metrics)
    return report.select("job_id", "api_name", "n_batches", "succeeded", "failed", "avg_secs", "status")


@query(
    "load_test",
    """
    SELECT api_name, count(*) AS n_batches, sum(total)::BIGINT AS item_sum, min(n) AS smallest, max(n) AS largest
    FROM (SELECT api_name, batch_id, sum(x) AS total, count(*) AS n FROM (
            SELECT 'batch-' || (l_suppkey % 7)::VARCHAR AS api_name, l_partkey AS x,
                   (row_number() OVER (PARTITION BY l_suppkey % 7 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1) // 20 AS batch_id
            FROM lineitem) GROUP BY 1, 2) GROUP BY 1
    """,
)
def load_test(spark, sf_dir):
    """Batching, the sum handler and its totals over all line items: the load test's shape."""
    rows = views.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("batch-"), (F.col("l_suppkey") % 7).cast("string")).alias("api_name"),
        *["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"],
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    placed = ordering.numbered(rows, ["api_name"], order, F.floor(F.col("l_orderkey") / 5000))
    batches = batching.collect_batches(batching.assign_batches(placed, 20), "l_partkey", ["api_name"])
    totals = execute.sum_items(batches).withColumn("n", F.size("items").cast("long"))
    return totals.groupBy("api_name").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("total").alias("item_sum"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
    )


@query(
    "jon_3",
    """
    WITH e AS (SELECT DISTINCT job_id FROM v_jobs WHERE o_orderstatus = 'O'),
    a AS (SELECT DISTINCT l_orderkey AS job_id FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 30)
    SELECT job_id, 'missing_worker' AS problem FROM e WHERE job_id NOT IN (SELECT job_id FROM a)
    UNION ALL SELECT job_id, 'missing_job' FROM a WHERE job_id NOT IN (SELECT job_id FROM e)
    """,
    "v_jobs",
)
def jon_3(spark, sf_dir):
    expected = views.jobs(spark, sf_dir).filter("o_orderstatus = 'O'").select("job_id")
    lines = views.table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O' AND l_quantity > 30")
    return jobs.orphans(expected, lines.select(F.col("l_orderkey").alias("job_id")))


ASYNC_SQL = """
    SELECT r.request_id, CASE WHEN count(marker) = 0 THEN 'not_found'
        WHEN min(marker) FILTER (marker = 'view!') IS NOT NULL AND (min(marker) FILTER (marker IN ('completed', 'failed')) IS NULL)
        THEN NULL
        ELSE coalesce(min(marker) FILTER (marker IN ('completed', 'failed')),
                      max(marker) FILTER (marker = 'in_progress'), 'in_queue') END AS status,
      coalesce(min(marker) FILTER (marker = 'view!') IS NOT NULL AND (min(marker) FILTER (marker IN ('completed', 'failed')) IS NULL), false) AS invalid
    FROM (SELECT DISTINCT event_id AS request_id FROM events) r
    LEFT JOIN (SELECT CASE WHEN request_id % 40 = 0 THEN -1 - request_id ELSE request_id END AS request_id,
                 CASE WHEN marker = 'in_queue' AND request_id % 50 = 1 THEN 'view!' ELSE marker END AS marker
               FROM v_async) m USING (request_id)
    GROUP BY 1
"""


def _async_states(spark, sf_dir):
    """One request in forty has no markers: they stand under another id."""
    marks, key = views.async_markers(spark, sf_dir), F.col("request_id")
    odd = (F.col("marker") == "in_queue") & (key % 50 == 1)
    marks = marks.select(
        F.when(key % 40 == 0, -1 - key).otherwise(key).alias("request_id"),
        F.when(odd, "view!").otherwise(F.col("marker")).alias("marker"),
    )
    wanted = views.requests(spark, sf_dir).select("request_id")
    return asyncreq.async_status(wanted, marks)


@query("agg_9", ASYNC_SQL, "v_async")
def agg_9(spark, sf_dir):
    return _async_states(spark, sf_dir)


@query(
    "jon_6",
    f"""
    SELECT s.request_id, s.status, CASE WHEN s.status = 'completed' THEN e.props END AS result,
           CASE WHEN s.status = 'completed' THEN e.ts END AS modified_at
    FROM ({ASYNC_SQL}) s LEFT JOIN events e ON e.event_id = s.request_id
    """,
    "v_async",
)
def jon_6(spark, sf_dir):
    results = views.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("props").alias("result"), F.col("ts").alias("modified_at")
    )
    return asyncreq.async_result(_async_states(spark, sf_dir).select("request_id", "status"), results)


@query(
    "prj_8",
    """
    SELECT request_id, CASE WHEN code IS NULL THEN 'unreachable' WHEN code <> 200 THEN 'status'
        WHEN NOT starts_with(coalesce(ctype, ''), 'application/json') THEN 'content_type'
        WHEN NOT json_valid(body) THEN 'not_json' ELSE 'ok' END AS reason,
      CASE WHEN code IS NULL THEN 'unreachable' WHEN code = 200 OR (hook AND code = 404) THEN 'ok' ELSE 'status' END AS batch_reason
    FROM (SELECT event_id AS request_id, CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_type = 'error' THEN 500
                   WHEN event_type = 'signup' THEN 404 ELSE 200 END AS code,
            CASE event_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN NULL ELSE 'application/json; charset=utf-8' END AS ctype,
            CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 5) ELSE props END AS body, event_id % 2 = 0 AS hook FROM events)
    """,
)
def prj_8(spark, sf_dir):
    key, kind = F.col("event_id"), F.col("event_type")
    code = F.when(kind == "error", 500).when(kind == "signup", 404).otherwise(200)
    responses = views.table(spark, sf_dir, "events").select(
        key.alias("request_id"),
        F.when(key % 23 != 0, code).alias("status_code"),
        F.when(key % 5 == 0, "text/html").when(key % 5 != 1, "application/json; charset=utf-8").alias("content_type"),
        F.when(key % 7 == 0, F.substring("props", 1, 5)).otherwise(F.col("props")).alias("body"),
        (key % 2 == 0).alias("hook"),
    )
    whole = asyncreq.classify_response(responses)
    batch = asyncreq.classify_batch_response(whole.withColumnRenamed("reason", "async_reason"), "hook")
    return batch.select("request_id", F.col("async_reason").alias("reason"), F.col("reason").alias("batch_reason"))


@query(
    "win_8",
    """
    SELECT api_name, job_id, n_files, place FROM (
      SELECT *, row_number() OVER (PARTITION BY api_name ORDER BY job_id)::INTEGER AS place
      FROM (SELECT api_name, job_id, count(*) AS n_files FROM v_markers GROUP BY 1, 2 HAVING bool_or(marker = 'spec.json')))
    WHERE place <= 10
    """,
    "v_markers",
)
def win_8(spark, sf_dir):
    return jobs.recent_jobs(views.markers(spark, sf_dir).select("api_name", "job_id", "marker"), 10)


@query(
    "win_9",
    """
    WITH s AS (SELECT DISTINCT o_custkey AS pod_id, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS snapshot_no
               FROM orders WHERE o_orderstatus = 'F'),
    r AS (SELECT *, snapshot_no - row_number() OVER (PARTITION BY pod_id ORDER BY snapshot_no) AS run FROM s),
    p AS (SELECT *, row_number() OVER (PARTITION BY pod_id, run ORDER BY snapshot_no) AS place FROM r)
    SELECT pod_id, snapshot_no FROM p WHERE place % 2 = 0
    """,
)
def win_9(spark, sf_dir):
    evicted = views.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    number = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    return jobs.evicted_twice(evicted.select(F.col("o_custkey").alias("pod_id"), number.alias("snapshot_no")))


@query(
    "agg_22",
    """
    SELECT api_name, count(*) FILTER (o_orderstatus = 'O') AS running, arg_max(job_id, (submitted_at, job_id)) AS latest_job,
           max(submitted_at) AS latest_start
    FROM v_jobs GROUP BY 1
    """,
    "v_jobs",
)
def agg_22(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "running").otherwise("other")
    rows = views.jobs(spark, sf_dir).select(
        "api_name", "job_id", F.col("submitted_at").alias("started_at"), status.alias("status")
    )
    return jobs.latest_job(rows)


JON_13 = """
    WITH apis AS (SELECT DISTINCT 'batch-' || (o_custkey % 9)::VARCHAR AS api_name FROM orders WHERE o_custkey % 9 < 6),
    live AS (SELECT api_name, job_id FROM v_jobs JOIN apis USING (api_name)
             WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND api_name <> 'batch-2'),
    stored AS (SELECT api_name, job_id FROM v_jobs JOIN apis USING (api_name) WHERE o_orderstatus <> 'O'),
    n AS (SELECT api_name, count(*) AS n FROM live GROUP BY 1),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY api_name ORDER BY job_id) AS place FROM stored
              WHERE (api_name, job_id) NOT IN (SELECT (api_name, job_id) FROM live)),
    newest AS (SELECT api_name, min(job_id) AS job_id FROM stored GROUP BY 1)
"""


@query(
    "jon_13",
    JON_13
    + """
    SELECT 'overview' AS view, api_name, job_id, 'active' AS origin FROM live
    UNION ALL SELECT 'overview', api_name, job_id, 'stored' FROM newest WHERE api_name NOT IN (SELECT api_name FROM n)
    UNION ALL SELECT 'detail', api_name, job_id, 'active' FROM live
    UNION ALL SELECT 'detail', f.api_name, job_id, 'stored' FROM fresh f LEFT JOIN n USING (api_name) WHERE place <= 10 - coalesce(n, 0)
    UNION ALL SELECT 'task', api_name, job_id, 'stored' FROM newest
    UNION ALL SELECT 'task', api_name, job_id, 'in_progress' FROM live WHERE (api_name, job_id) NOT IN (SELECT (api_name, job_id) FROM newest)
    """,
    "v_jobs",
)
def jon_13(spark, sf_dir):
    key = F.col("o_custkey") % 9
    apis = views.table(spark, sf_dir, "orders").filter(key < 6)
    apis = apis.select(F.concat(F.lit("batch-"), key.cast("string")).alias("api_name"))
    rows = views.jobs(spark, sf_dir)
    urgent = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    live = rows.filter(urgent & (F.col("api_name") != "batch-2"))
    stored = rows.filter("o_orderstatus <> 'O'")
    return (
        jobs.api_overview(apis, live, stored)
        .withColumn("view", F.lit("overview"))
        .unionByName(jobs.api_detail(apis, live, stored).withColumn("view", F.lit("detail")))
        .unionByName(jobs.task_overview(apis, live, stored).withColumn("view", F.lit("task")))
    )

