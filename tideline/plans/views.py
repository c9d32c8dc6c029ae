"""Workload-shaped views over the given tables (see FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.ordering import numbered
from tideline.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).otherwise(200)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.concat(F.lit("api-"), (F.col("user_id") % 5).cast("string")).alias("api_name"),
        F.concat(F.lit("pod-"), (F.col("user_id") % 20).cast("string")).alias("pod"),
        status.alias("status_code"),
        (F.col("value") / 100.0).alias("duration_s"),
        F.get_json_object("props", "$.k").cast("int").alias("in_flight"),
    )


def gauge(spark, sf_dir) -> DataFrame:
    return requests(spark, sf_dir).select(
        F.lit("in_flight").alias("name"), "api_name", "pod", "ts", F.col("in_flight").cast("double").alias("value")
    )


def counter(spark, sf_dir) -> DataFrame:
    """Counters that wrap every 40 requests; numbered per day, so no series fills one task."""
    rows = requests(spark, sf_dir).select("api_name", "pod", "status_code", "ts", "request_id")
    rows = numbered(rows, ["pod", "status_code"], ["ts", "request_id"], F.date_trunc("day", "ts"), "n")
    return rows.select(
        "api_name", "pod", "status_code", "ts", (F.lit(1) + F.col("n") % 40).cast("double").alias("value")
    )


def jobs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.concat(F.lit("batch-"), (F.col("o_custkey") % 7).cast("string")).alias("api_name"),
        F.col("o_orderdate").alias("submitted_at"),
        "o_orderstatus",
        "o_orderpriority",
    )


def batch_runs(spark, sf_dir) -> DataFrame:
    """One row per batch run, without numbers: enough for every aggregate."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        (F.col("l_returnflag") != "R").alias("ok"),
        F.col("l_quantity").alias("secs"),
        F.col("l_extendedprice").alias("amount"),
        "l_linestatus",
        "l_shipdate",
    )


def batches(spark, sf_dir) -> DataFrame:
    """Batch runs numbered from 1 within their job."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        F.col("l_extendedprice").alias("amount"),
        F.col("l_quantity").alias("secs"),
        (F.col("l_returnflag") != "R").alias("ok"),
        "l_linestatus",
    )
    # A prefix of the order columns, so that even a huge job is spread over many buckets.
    bucket = F.struct("l_linenumber", F.floor(F.col("l_partkey") / 1000).alias("p"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "amount", "secs"]
    rows = numbered(rows, ["job_id"], order, bucket, "n")
    return rows.select(
        "job_id", (F.col("n") + 1).alias("batch_no"), "ok", "secs", "amount", "l_linestatus", "l_shipdate"
    )


def markers(spark, sf_dir) -> DataFrame:
    """Status marker files of each job; marker time = submission + rank minutes."""
    final = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "worker_oom")
        .when(F.col("o_orderpriority") == "2-HIGH", "completed_with_failures")
        .otherwise("succeeded")
    )

    def mark(cond, rank, name):
        entry = F.struct(F.lit(rank).alias("rank"), (F.lit(name) if isinstance(name, str) else name).alias("marker"))
        return entry if cond is None else F.when(cond, entry)

    done = F.col("o_orderstatus") == "F"
    entries = F.array_compact(
        F.array(
            mark(F.col("job_id") % 50 != 0, 0, "spec.json"),
            mark(None, 1, "enqueuing"),
            mark(F.col("o_orderstatus") != "P", 2, "running"),
            mark(done, 3, final),
            mark(done, 4, "stopped"),
        )
    )
    return (
        jobs(spark, sf_dir)
        .select("job_id", "api_name", "submitted_at", F.explode(entries).alias("e"))
        .select(
            "job_id",
            "api_name",
            F.col("e.marker").alias("marker"),
            (F.col("submitted_at") + F.make_dt_interval(mins=F.col("e.rank"))).alias("mtime"),
        )
    )


def async_markers(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    entries = F.array_compact(
        F.array(
            F.lit("in_queue"),
            F.when(kind != "view", F.lit("in_progress")),
            F.when(kind.isin("purchase", "click"), F.lit("completed")),
            F.when(kind == "error", F.lit("failed")),
        )
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("async-"), (F.col("user_id") % 5).cast("string")).alias("api_name"),
        "ts",
        F.explode(entries).alias("marker"),
    )


def items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.to_json(F.struct("doc_id", "lang", "text")).alias("body"),
        "source",
        "text",
    )


def files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.length("html").alias("size"))


def nodes(spark, sf_dir) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("node_id"),
        F.concat(F.lit("type-"), (key % 5).cast("string")).alias("instance_type"),
        (key % 3 == 0).alias("is_spot"),
        (key % 10 != 0).alias("workload"),
        (4000 + 1000 * (key % 4)).alias("cpu_m"),
        F.lit(16384).cast("long").alias("mem_mi"),
    )


def pods(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    n_nodes = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n_nodes")).scalar()
    kind = (
        F.when(F.col("c_nationkey") % 3 == 0, "RealtimeAPI")
        .when(F.col("c_nationkey") % 3 == 1, "AsyncAPI")
        .otherwise("BatchAPI")
    )
    phase = (
        F.when(key % 7 == 0, "Failed").when(key % 7 == 1, "Succeeded").when(key % 7 == 2, "Pending").otherwise("Running")
    )
    return (
        table(spark, sf_dir, "customer")
        .select(
            key.alias("pod_id"),
            F.when(key % 11 != 0, 1 + key % n_nodes).alias("node_id"),
            F.col("c_mktsegment").alias("api_name"),
            kind.alias("kind"),
            (100 + 50 * (key % 6)).alias("cpu_m"),
            (256 + 128 * (key % 4)).alias("mem_mi"),
            phase.alias("phase"),
        )
    )


def prices(spark, sf_dir) -> DataFrame:
    size = F.col("p_size") % 5
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("type-"), size.cast("string")).alias("instance_type"),
        (F.col("p_retailprice") / 1000 + size).alias("price"),
        "p_partkey",
    )


def on_demand_prices(spark, sf_dir) -> DataFrame:
    return prices(spark, sf_dir).groupBy("instance_type").agg(F.max("price").alias("price"))


def spot_prices(spark, sf_dir) -> DataFrame:
    history = prices(spark, sf_dir).filter(F.col("instance_type") != "type-4")
    return history.groupBy("instance_type").agg(F.min("price").alias("price"))


SPLITS = [
    ("split-a", "api-0", 30, False),
    ("split-a", "api-1", 70, False),
    ("split-a", "api-2", 100, True),
]


def splits(spark, rows=SPLITS) -> DataFrame:
    return spark.createDataFrame(rows, "splitter string, target string, weight int, shadow boolean")


def log_lines(spark, sf_dir) -> DataFrame:
    """One JSON line per conversation turn, a second apart within a conversation."""
    role = F.col("role")
    time = F.date_format(
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss.SSS"
    )
    line = F.to_json(
        F.struct(
            time.alias("time"),
            F.when(role.isin("user", "system"), F.col("text")).alias("message"),
            F.when(role.isin("assistant", "system"), F.concat(F.lit("m:"), F.col("text"))).alias("msg"),
            F.when(role == "assistant", "info").alias("levelname"),
            F.struct(role.alias("apiName"), F.col("conv_id").cast("string").alias("jobID")).alias("labels"),
        )
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
