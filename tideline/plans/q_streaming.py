"""Queries that run streams over the given tables to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators.timeseries import DEFAULT_BUCKETS
from tideline.plans import views
from tideline.plans.q_control import MAX_REPLICAS, TARGET, load
from tideline.plans.q_timeseries import BOUNDS_SQL, rounded
from tideline.plans.registry import ORACLE, query
from tideline.plans.replay import heartbeat, in_turn, out_of_order_stream
from tideline.plans.views_sql import view
from tideline.session import fresh_path
from tideline.streaming import autoscale, batches, dedupe, requests

HOUR = 3600


def events_stream(spark, sf_dir, replay=False):
    """The events table as a stream, with the columns of the request view.

    ``replay`` deals it over several micro-batches, up to half an hour late, and ends with a heartbeat,
    after which all windows are closed.
    """
    events = views.table(spark, sf_dir, "events")
    if replay:
        stream = out_of_order_stream(events, fresh_path(spark, "events"), 12 * 24 * HOUR, HOUR / 2)
    else:
        stream = batches.read_table_stream(spark, sf_dir, "events.parquet", events.schema)
    return request_columns(stream)


def request_columns(events):
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.concat(F.lit("api-"), (F.col("user_id") % 5).cast("string")).alias("api_name"),
        F.concat(F.lit("pod-"), (F.col("user_id") % 20).cast("string")).alias("pod"),
        F.when(kind == "error", 500).when(kind == "signup", 404).otherwise(200).alias("status_code"),
        (F.col("value") / 100.0).alias("duration_s"),
        F.get_json_object("props", "$.k").cast("int").alias("in_flight"),
        "event_type",
        "props",
    )


def naive(df, *names):
    """Back to timestamps without time zone."""
    for name in names or ["ts"]:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


@query(
    "str_1",
    f"""
    SELECT w AS window_start, status_code, le, count(*) FILTER (duration_s <= le) AS bucket_count, count(*) AS count, round(sum(duration_s), 6) AS sum
    FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS w FROM v_requests), {BOUNDS_SQL}
    GROUP BY 1, 2, 3
    """,
    "v_requests",
)
def str_1(spark, sf_dir):
    metrics = requests.request_metrics(events_stream(spark, sf_dir, replay=True), "6 hours", "1 hour", buckets=DEFAULT_BUCKETS)
    return rounded(naive(batches.run_to_end(metrics, name="metrics"), "window_start"), 6, "sum")


@query(
    "str_2",
    """
    WITH e AS (SELECT api_name, pod, in_flight, unnest(generate_series(time_bucket(INTERVAL 4 HOUR, ts) + INTERVAL 4 HOUR,
                 time_bucket(INTERVAL 4 HOUR, ts) + INTERVAL 12 HOUR, INTERVAL 4 HOUR)) AS w FROM v_requests),
    s AS (SELECT w, api_name, pod, sum(in_flight) AS s, count(*) AS n FROM e GROUP BY 1, 2, 3)
    SELECT w AS ts, api_name, sum(s) / max(n) AS avg_in_flight FROM s GROUP BY 1, 2
    """,
    "v_requests",
)
def str_2(spark, sf_dir):
    samples = events_stream(spark, sf_dir, replay=True).select("api_name", "pod", "ts", F.col("in_flight").alias("value"))
    return naive(batches.run_to_end(requests.in_flight_load(samples, "12 hours", "4 hours", "1 hour"), name="load"))


@query(
    "str_2_reports",
    """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, api_name, pod, avg(in_flight) AS value FROM v_requests
    GROUP BY time_bucket(INTERVAL 1 HOUR, ts), api_name, pod
    """,
    "v_requests",
)
def str_2_reports(spark, sf_dir):
    samples = events_stream(spark, sf_dir, replay=True).select("api_name", "pod", "ts", F.col("in_flight").alias("value"))
    return naive(batches.run_to_end(requests.in_flight_reports(samples, "1 hour", "1 hour"), name="reports"))


@query(
    "str_3",
    """
    SELECT request_id, CASE WHEN event_type IN ('purchase', 'click') AND request_id % 7 <> 0 THEN 'completed'
        WHEN event_type IN ('purchase', 'click', 'error') THEN 'failed' WHEN event_type <> 'view' THEN 'in_progress' ELSE 'in_queue' END AS status,
      false AS invalid
    FROM (SELECT event_id AS request_id, event_type FROM events)
    """,
)
def str_3(spark, sf_dir):
    """Markers a minute apart, terminal ones from checked responses, as a stream of several micro-batches up to half an hour late."""
    events = request_columns(views.table(spark, sf_dir, "events"))
    kind = F.col("event_type")
    early = F.array_compact(F.array(F.lit("in_queue"), F.when(kind != "view", F.lit("in_progress"))))
    markers = events.select("request_id", "ts", F.posexplode(early).alias("place", "marker"))
    markers = markers.select("request_id", (F.col("ts") + F.make_dt_interval(mins=F.col("place"))).alias("ts"), "marker")
    answered = events.filter(kind.isin("purchase", "click", "error"))
    responses = answered.select(
        "request_id",
        (F.col("ts") + F.make_dt_interval(mins=F.lit(2))).alias("ts"),
        "status_code",
        F.lit("application/json").alias("content_type"),
        F.when(F.col("request_id") % 7 == 0, "{").otherwise(F.col("props")).alias("body"),
    )
    ended = requests.response_markers(responses, "request_id", "ts").select("request_id", "ts", "marker")
    stream = out_of_order_stream(markers.unionByName(ended), fresh_path(spark, "markers"), 12 * 24 * HOUR, HOUR / 2)
    updates = requests.tracked_status(stream, keep_s=2 * HOUR, delay_s=HOUR)
    told = batches.run_to_end(updates, "update", "status").filter("late = 0")
    return batches.latest_updates(told, "request_id").select("request_id", "status", "invalid")


@query("str_4", ORACLE["aut_2"])
def str_4(spark, sf_dir):
    """The ticks of the batch fold as a stream of several micro-batches, some of them days late."""
    ticks = load(spark, sf_dir)
    days = 24 * HOUR
    stream = out_of_order_stream(ticks, fresh_path(spark, "ticks"), 8 * days, 2 * days).withColumns(
        {
            "target_in_flight": F.lit(TARGET),
            "max_replicas": F.lit(MAX_REPLICAS),
            "init_replicas": F.lit(2),
            "downscale_stabilization_s": F.lit(12.0 * HOUR),
            "upscale_stabilization_s": F.lit(8.0 * HOUR),
        }
    )
    return batches.run_to_end(autoscale.stream_decisions(stream, delay="2 days"), name="decisions")


view(
    "v_errors",
    "SELECT ts, 'error ' || (user_id % 6)::VARCHAR || CASE WHEN user_id % 6 = 5 AND day(ts) BETWEEN 10 AND 13 THEN ' again' ELSE '' END AS key "
    "FROM events",
)


def _cooldown_sql(source: str) -> str:
    return f"""
    WITH RECURSIVE e AS (SELECT key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY key ORDER BY ts) AS i FROM {source}),
    f AS (
      SELECT key, i, us, true AS emit, us AS rep, 5000000::BIGINT AS period FROM e WHERE i = 1
      UNION ALL
      SELECT e.key, e.i, e.us, (e.us - f.us > 86400000000) OR (e.us - f.rep > f.period),
        CASE WHEN e.us - f.us > 86400000000 OR e.us - f.rep > f.period THEN e.us ELSE f.rep END,
        CASE WHEN e.us - f.us > 86400000000 THEN 5000000 WHEN e.us - f.rep > f.period THEN least(f.period * 2, 86400000000) ELSE f.period END
      FROM f JOIN e ON e.key = f.key AND e.i = f.i + 1)
    SELECT key, make_timestamp(us) AS ts, period / 1e6 AS cooldown_s FROM f WHERE emit"""


def errors(rows):
    """Every event as an error; one message has another text for four days of each month, so that its first text is forgotten."""
    other = (F.col("user_id") % 6 == 5) & F.dayofmonth("ts").between(10, 13)
    message = F.concat(F.lit("error "), (F.col("user_id") % 6).cast("string"), F.when(other, " again").otherwise(""), F.lit("\ntrace "), "props")
    return rows.select("ts", message.alias("message"))


@query("str_5", _cooldown_sql("v_errors"), "v_errors")
def str_5(spark, sf_dir):
    return dedupe.dedupe_errors(errors(views.table(spark, sf_dir, "events")))


@query("str_5_any", _cooldown_sql("(SELECT '<msg>' AS key, ts FROM v_errors)"), "v_errors")
def str_5_any(spark, sf_dir):
    return dedupe.dedupe_errors(errors(views.table(spark, sf_dir, "events")), any_message=True)


@query("str_5_stream", _cooldown_sql("v_errors"), "v_errors")
def str_5_stream(spark, sf_dir):
    """The errors as a stream of several micro-batches, some of them days late."""
    days = 24 * HOUR
    found = errors(views.table(spark, sf_dir, "events"))
    stream = out_of_order_stream(found, fresh_path(spark, "errors"), 8 * days, 2 * days)
    return batches.run_to_end(dedupe.stream_dedupe_errors(stream, delay="2 days"), name="reports")


@query(
    "str_6",
    "SELECT DISTINCT user_id || ':' || dayofyear(ts) AS message_id FROM events",
)
def str_6(spark, sf_dir):
    schema = views.table(spark, sf_dir, "events").schema
    stream = batches.read_table_stream(spark, sf_dir, "events.parquet", schema)
    messages = stream.select(
        "ts", F.concat(F.col("user_id").cast("string"), F.lit(":"), F.dayofyear("ts").cast("string")).alias("message_id")
    )
    return batches.run_to_end(requests.once_only(messages, delay="2 days"), name="messages").select("message_id")


def _lengths(_config):
    return lambda row: [len(text) for text in row["items"]]


@query(
    "str_7",
    """
    SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 16)::INTEGER AS place, length(text) AS n
    FROM documents
    """,
)
def str_7(spark, sf_dir):
    """The documents as a stream of six micro-batches, none of them a multiple of the batch size, and a last row."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    last = docs.agg(F.max("doc_id")).first()[0]
    turns = docs.withColumn("_turn", F.least(F.floor(F.col("doc_id") * 6 / (last + 1)), F.lit(5)))
    end = heartbeat(turns, doc_id=F.lit(last + 1), _turn=F.lit(6))
    stream = in_turn(turns.unionByName(end), F.col("_turn"), fresh_path(spark, "documents"))
    path = fresh_path(spark, "results")
    batches.stream_batches(stream, "doc_id", "text", 16, _lengths, path, fresh_path(spark, "results-state"))
    lengths = F.from_json("result", "array<long>")
    return spark.read.parquet(path).select("batch_id", F.posexplode(lengths).alias("place", "n"))
