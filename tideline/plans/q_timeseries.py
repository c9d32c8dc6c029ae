"""Queries for labels, time-series operators and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import labels, timeseries
from tideline.plans import views
from tideline.plans.registry import query
from tideline.plans.views_sql import view

HOUR = 3600
RANGE, STEP = 12 * HOUR, 4 * HOUR


def labelled(spark, sf_dir):
    """Request events as samples with a label map; ``code`` is missing for successes."""
    rows = views.requests(spark, sf_dir)
    pairs = F.array(
        F.struct(F.lit("api_name").alias("k"), F.col("api_name").alias("v")),
        F.struct(F.lit("pod").alias("k"), F.col("pod").alias("v")),
        F.struct(F.lit("port").alias("k"), (8000 + F.col("in_flight")).cast("string").alias("v")),
    )
    code = F.array(F.struct(F.lit("code").alias("k"), F.col("status_code").cast("string").alias("v")))
    pairs = F.concat(pairs, F.when(F.col("status_code") != 200, code).otherwise(F.slice(code, 1, 0)))
    return rows.select("request_id", F.map_from_entries(pairs).alias("labels"), "ts", F.col("duration_s").alias("value"))


view(
    "v_labelled",
    """
    SELECT request_id, api_name, pod, (8000 + in_flight)::VARCHAR AS port,
           CASE WHEN status_code <> 200 THEN status_code::VARCHAR END AS code, ts, duration_s AS value FROM v_requests
    """,
    "v_requests",
)


@query(
    "prj_1",
    """
    SELECT request_id, ts, value FROM v_labelled
    WHERE regexp_full_match(coalesce(code, ''), '4..|5..|') AND api_name <> 'api-3'
      AND NOT regexp_full_match(pod, 'pod-1.') AND regexp_full_match(port, '80[0-4].')
    """,
    "v_labelled",
)
def prj_1(spark, sf_dir):
    wanted = [
        ("code", "=~", "4..|5..|"),
        ("api_name", "!=", "api-3"),
        ("pod", "!~", "pod-1."),
        ("port", "=~", "80[0-4]."),
        ("zone", "=", ""),
    ]
    return labels.match_labels(labelled(spark, sf_dir), wanted).select("request_id", "ts", "value")


@query(
    "prj_2",
    """
    SELECT request_id, 'keep' AS mode FROM v_labelled WHERE regexp_full_match(api_name || ';' || coalesce(code, ''), 'api-[01];(404)?')
    UNION ALL
    SELECT request_id, 'drop' FROM v_labelled WHERE NOT regexp_full_match(pod, 'pod-(3|7|1.)')
    """,
    "v_labelled",
)
def prj_2(spark, sf_dir):
    samples = labelled(spark, sf_dir)
    kept = labels.relabel_keep(samples, ["api_name", "code"], "api-[01];(404)?")
    left = labels.relabel_drop(samples, ["pod"], "pod-(3|7|1.)")
    return kept.select("request_id", F.lit("keep").alias("mode")).unionByName(
        left.select("request_id", F.lit("drop").alias("mode"))
    )


@query(
    "prj_3",
    """
    SELECT request_id, api_name, CASE WHEN code IS NOT NULL THEN api_name || ':' || code ELSE 'x' END AS address,
           CASE WHEN regexp_full_match(pod, 'pod-1.') THEN NULL ELSE pod END AS host, NULL::VARCHAR AS port
    FROM v_labelled
    """,
    "v_labelled",
)
def prj_3(spark, sf_dir):
    samples = labels.relabel_replace(labelled(spark, sf_dir), [], "address", "", "x")
    samples = labels.relabel_replace(samples, ["api_name", "code"], "address", "([^;]+);(\\d+)", "$1:$2")
    samples = labels.relabel_replace(samples, ["pod"], "host")
    samples = labels.relabel_replace(samples, ["pod"], "host", "pod-1.", "")
    samples = labels.label_keep(samples, "api_name|address|host|port")
    samples = labels.label_drop(samples, "po(.+)")
    label = lambda name: F.try_element_at("labels", F.lit(name)).alias(name)
    return samples.select("request_id", label("api_name"), label("address"), label("host"), label("port"))


def grid_sql(source: str, keys: str, range_s: int, step_s: int) -> str:
    """Each sample once per grid time whose trailing range holds it."""
    step, reach = step_s * 1_000_000, range_s * 1_000_000
    return f"""
      SELECT *, unnest(range((us + {step} - 1) // {step} * {step}, (us + {reach}) // {step} * {step} + 1, {step})) AS at_us
      FROM (SELECT {keys}, epoch_us(ts) AS us, value AS v FROM {source})"""


def rate_sql(source: str, keys: str, range_s: int, step_s: int, kind: str = "rate") -> str:
    """The rate of counters, from the same public definition, written window by window."""
    reach = range_s * 1_000_000
    per = f" / {float(range_s)}" if kind == "rate" else ""
    return f"""
    SELECT {keys}, make_timestamp(at_us) AS ts,
      grew * ((sampled + CASE WHEN s0 < gap * 1.1 THEN s0 ELSE gap / 2 END
                       + CASE WHEN e0 < gap * 1.1 THEN e0 ELSE gap / 2 END) / sampled){per} AS value
    FROM (SELECT *, sampled / (n - 1) AS gap, (at_us - last) / 1e6 AS e0,
            CASE WHEN grew > 0 AND first_v >= 0 AND sampled * (first_v / grew) < (first - (at_us - {reach})) / 1e6
                 THEN sampled * (first_v / grew) ELSE (first - (at_us - {reach})) / 1e6 END AS s0
      FROM (SELECT {keys}, at_us, count(*) AS n, min(us) AS first, max(us) AS last, (max(us) - min(us)) / 1e6 AS sampled,
              arg_min(v, us) AS first_v,
              coalesce(sum(CASE WHEN prev_v IS NOT NULL THEN CASE WHEN v < prev_v THEN v ELSE v - prev_v END END), 0) AS grew
            FROM (SELECT *, lag(v) OVER (PARTITION BY {keys}, at_us ORDER BY us) AS prev_v
                  FROM ({grid_sql(source, keys, range_s, step_s)}))
            GROUP BY {keys}, at_us)
      WHERE n >= 2 AND last > first)"""


def instant_sql(source: str, keys: str, step_s: int, lookback_s: int) -> str:
    return f"""
    SELECT {keys}, make_timestamp(at_us) AS ts, arg_max(v, us) AS value
    FROM ({grid_sql(source, keys, lookback_s, step_s)}) GROUP BY {keys}, at_us"""


SERIES = "api_name, pod, status_code"
LABELS = ["api_name", "pod", "status_code"]


def rounded(df, digits=6, *names):
    for name in names or ["value"]:
        df = df.withColumn(name, F.round(name, digits))
    return df


@query(
    "win_3",
    f"""
    SELECT 'rate' AS kind, {SERIES}, ts, round(value, 9) AS value FROM ({rate_sql("v_counter", SERIES, RANGE, STEP)})
    UNION ALL
    SELECT 'increase', {SERIES}, ts, round(value, 6) FROM ({rate_sql("v_counter", SERIES, RANGE, STEP, "increase")})
    """,
    "v_counter",
)
def win_3(spark, sf_dir):
    counter = views.counter(spark, sf_dir)
    per_second = rounded(timeseries.rate(counter, LABELS, RANGE, STEP), 9).withColumn("kind", F.lit("rate"))
    total = rounded(timeseries.rate(counter, LABELS, RANGE, STEP, "increase")).withColumn("kind", F.lit("increase"))
    return per_second.unionByName(total)


@query(
    "win_4",
    f"""
    SELECT api_name, pod, make_timestamp(at_us) AS ts, sum(v) AS sum_v, count(v) AS count_v
    FROM ({grid_sql("v_gauge", "api_name, pod", RANGE, STEP)}) GROUP BY api_name, pod, at_us
    """,
    "v_gauge",
)
def win_4(spark, sf_dir):
    windows = timeseries.over_time(views.gauge(spark, sf_dir), ["api_name", "pod"], RANGE, STEP)
    return windows.select("api_name", "pod", "ts", "sum_v", "count_v")


@query(
    "win_5",
    f"""
    SELECT api_name, make_timestamp(at_us) AS ts, sum(s) / max(n) FILTER (pod <> 'pod-7') AS value
    FROM (SELECT api_name, pod, at_us, sum(v) AS s, count(v) AS n FROM ({grid_sql("v_gauge", "api_name, pod", RANGE, STEP)}) GROUP BY 1, 2, 3)
    GROUP BY api_name, at_us HAVING max(n) FILTER (pod <> 'pod-7') IS NOT NULL
    """,
    "v_gauge",
)
def win_5(spark, sf_dir):
    return timeseries.avg_in_flight(views.gauge(spark, sf_dir), RANGE, STEP, F.col("pod") == "pod-7")


@query(
    "win_6",
    """
    WITH s AS (SELECT pod, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value) AS m FROM v_gauge GROUP BY 1, 2),
    g AS (SELECT pod, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM s GROUP BY 1)
    SELECT pod, g.ts, coalesce(m, 0) AS value FROM g LEFT JOIN s USING (pod, ts)
    """,
    "v_gauge",
)
def win_6(spark, sf_dir):
    return timeseries.sample_in_flight(views.gauge(spark, sf_dir), ["pod"], HOUR)


@query(
    "jon_7",
    f"""
    WITH r AS ({rate_sql("v_counter", SERIES, RANGE, STEP)}),
    bad AS (SELECT pod, ts, sum(value) AS v FROM r WHERE status_code >= 400 GROUP BY 1, 2),
    ok AS (SELECT pod, ts, sum(value) AS v FROM r WHERE status_code < 400 GROUP BY 1, 2)
    SELECT pod, ts, round(bad.v / ok.v, 6) AS value FROM bad JOIN ok USING (pod, ts)
    """,
    "v_counter",
)
def jon_7(spark, sf_dir):
    rates = timeseries.rate(views.counter(spark, sf_dir), LABELS, RANGE, STEP)
    total = lambda cond: rates.filter(cond).groupBy("pod", "ts").agg(F.sum("value").alias("value"))
    share = timeseries.vector_op(total("status_code >= 400"), total("status_code < 400"), "/", ["pod", "ts"])
    return rounded(share)


@query(
    "jon_8",
    f"""
    WITH g AS ({instant_sql("v_gauge", "api_name, pod", STEP, RANGE)})
    SELECT api_name, pod, ts, value / n AS value FROM g
    JOIN (SELECT api_name, ts, count(*) AS n FROM g GROUP BY 1, 2) USING (api_name, ts)
    """,
    "v_gauge",
)
def jon_8(spark, sf_dir):
    now = timeseries.instant(views.gauge(spark, sf_dir), ["api_name", "pod"], STEP, RANGE)
    pods = now.groupBy("api_name", "ts").agg(F.count("value").alias("value"))
    return timeseries.vector_op_group_left(now, pods, "/", ["api_name", "ts"])


@query(
    "jon_9",
    f"""
    WITH g AS ({instant_sql("v_gauge", "api_name, pod", STEP, RANGE)})
    SELECT api_name, pod, ts, value / n AS value FROM g JOIN (SELECT ts, sum(value) AS n FROM g GROUP BY 1) USING (ts)
    """,
    "v_gauge",
)
def jon_9(spark, sf_dir):
    now = timeseries.instant(views.gauge(spark, sf_dir), ["api_name", "pod"], STEP, RANGE)
    total = now.groupBy("ts").agg(F.sum("value").alias("value"))
    return timeseries.scalar_op(now, total, "/", ["ts"])


@query(
    "jon_10",
    """
    WITH p AS (SELECT api_name, pod, request_id, ts FROM v_requests WHERE status_code = 500),
    s AS (SELECT pod, ts, in_flight::DOUBLE AS v FROM v_requests WHERE status_code = 200)
    SELECT p.request_id, p.pod, p.ts, CASE WHEN s.ts >= p.ts - INTERVAL 3 HOUR THEN s.v END AS value
    FROM p ASOF LEFT JOIN s ON p.pod = s.pod AND p.ts >= s.ts
    """,
    "v_requests",
)
def jon_10(spark, sf_dir):
    rows = views.requests(spark, sf_dir)
    points = rows.filter("status_code = 500").select("pod", "ts", "request_id")
    samples = rows.filter("status_code = 200").select("pod", "ts", F.col("in_flight").alias("value"))
    return timeseries.as_of(points, samples, ["pod"], 3 * HOUR).select("request_id", "pod", "ts", "value")


@query(
    "jon_10_instant",
    """
    SELECT api_name, pod, arg_max(value, ts) AS value, max(ts) AS sample_ts FROM v_gauge
    WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' AND ts >= TIMESTAMP '2024-01-19 18:00:00' GROUP BY 1, 2
    """,
    "v_gauge",
)
def jon_10_instant(spark, sf_dir):
    at = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return timeseries.instant_at(views.gauge(spark, sf_dir), ["api_name", "pod"], at, 6 * HOUR)


@query(
    "agg_1",
    """
    SELECT 'by' AS form, api_name, NULL::VARCHAR AS pod, sum(value) AS sum_v, count(value) AS count_v, avg(value) AS avg_v,
           min(value) AS min_v, max(value) AS max_v FROM v_gauge GROUP BY api_name
    UNION ALL
    SELECT 'without', NULL, pod, sum(value), count(value), avg(value), min(value), max(value) FROM v_gauge GROUP BY pod
    """,
    "v_gauge",
)
def agg_1(spark, sf_dir):
    gauge = views.gauge(spark, sf_dir)
    by = timeseries.aggregate_by(gauge, ["api_name"])
    without = timeseries.aggregate_without(gauge, ["name", "api_name", "pod"], ["name", "api_name"], keep=[])
    null = F.lit(None).cast("string")
    return (
        by.withColumn("form", F.lit("by"))
        .withColumn("pod", null)
        .unionByName(without.withColumn("form", F.lit("without")).withColumn("api_name", null))
    )


BOUNDS_SQL = "(VALUES " + ", ".join(f"({b}::DOUBLE)" for b in timeseries.DEFAULT_BUCKETS) + ", ('inf'::DOUBLE)) AS b(le)"
view(
    "v_histogram",
    f"""
    SELECT api_name, status_code, le, count(*) FILTER (duration_s <= le) AS bucket_count, count(*) AS count,
           round(sum(duration_s), 6) AS sum
    FROM v_requests, {BOUNDS_SQL} GROUP BY 1, 2, 3
    """,
    "v_requests",
)


@query("agg_10", "SELECT * FROM v_histogram", "v_histogram")
def agg_10(spark, sf_dir):
    histogram = timeseries.histogram(views.requests(spark, sf_dir), ["api_name", "status_code"], "duration_s")
    return rounded(histogram, 6, "sum")


def quantile_sql(q: float, source: str, keys: str) -> str:
    """Rank search over the sorted bounds of each label set; rows (keys, le, c)."""
    return f"""
    SELECT {keys}, CASE WHEN total = 0 OR n < 2 OR top <> 'inf' THEN 'nan'::DOUBLE
        WHEN i = n THEN les[n - 1]
        ELSE (CASE WHEN i > 1 THEN les[i - 1] ELSE 0 END) + (les[i] - (CASE WHEN i > 1 THEN les[i - 1] ELSE 0 END))
             * ({q} * total - (CASE WHEN i > 1 THEN cs[i - 1] ELSE 0 END)) / (cs[i] - (CASE WHEN i > 1 THEN cs[i - 1] ELSE 0 END)) END AS value
    FROM (SELECT *, 1 + len(list_filter(cs[1:n - 1], lambda c: c < {q} * total)) AS i
          FROM (SELECT {keys}, list(le ORDER BY le) AS les, list(c ORDER BY le) AS cs, count(*) AS n, max(c) AS total, max(le) AS top
                FROM (SELECT {keys}, le, max(c) OVER (PARTITION BY {keys} ORDER BY le) AS c
                      FROM (SELECT {keys}, le, sum(c) AS c FROM {source} GROUP BY {keys}, le)) GROUP BY {keys}))"""


def _quantiles(buckets, by, value, qs=(0.99, 0.9, 0.5)):
    found = timeseries.histogram_quantiles({str(q): q for q in qs}, buckets, by, value, "q")
    return found.withColumn("q", F.col("q").cast("double"))


@query(
    "agg_11",
    " UNION ALL ".join(
        f"SELECT api_name, {q}::DOUBLE AS q, round(value, 6) AS value FROM "
        f"({quantile_sql(q, '(SELECT api_name, le, bucket_count::DOUBLE AS c FROM v_histogram)', 'api_name')})"
        for q in (0.99, 0.9, 0.5)
    ),
    "v_histogram",
)
def agg_11(spark, sf_dir):
    histogram = timeseries.histogram(views.requests(spark, sf_dir), ["api_name", "status_code"], "duration_s")
    return rounded(_quantiles(histogram, ["api_name"], "bucket_count"))


@query(
    "agg_21",
    f"""
    WITH g AS ({instant_sql("v_gauge", "api_name, pod", STEP, RANGE)})
    SELECT ts, sum(m) AS sum_of_max, count(*) AS n_apis, sum(n)::BIGINT AS n_series
    FROM (SELECT ts, api_name, max(value) AS m, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1
    """,
    "v_gauge",
)
def agg_21(spark, sf_dir):
    now = timeseries.instant(views.gauge(spark, sf_dir), ["api_name", "pod"], STEP, RANGE)
    inner = timeseries.aggregate_by(now, ["ts", "api_name"])
    return inner.groupBy("ts").agg(
        F.sum("max_v").alias("sum_of_max"), F.count(F.lit(1)).alias("n_apis"), F.sum("count_v").alias("n_series")
    )


@query(
    "agg_15",
    """
    SELECT api_name, count(*) FILTER (status_code // 100 = 2) AS n_2xx, count(*) FILTER (status_code // 100 = 4) AS n_4xx,
           count(*) FILTER (status_code // 100 = 5) AS n_5xx, round(avg(duration_s), 8) AS mean_s
    FROM v_requests WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY GROUP BY 1
    """,
    "v_requests",
)
def agg_15(spark, sf_dir):
    from tideline.operators.requests import request_summary

    until = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return rounded(request_summary(views.requests(spark, sf_dir), until), 8, "mean_s")


@query(
    "prj_12",
    f"""
    WITH g AS ({instant_sql("v_gauge", "api_name, pod", STEP, RANGE)}),
    lim AS (SELECT pod, ts, avg(value) OVER (PARTITION BY api_name, ts) AS b, value FROM g)
    SELECT 'fixed' AS kind, pod, ts, value, 80.0::DOUBLE AS bound FROM g WHERE value > 80
    UNION ALL
    SELECT 'series', pod, ts, value, 1.5 * b FROM lim WHERE value > 1.5 * b
    """,
    "v_gauge",
)
def prj_12(spark, sf_dir):
    now = timeseries.instant(views.gauge(spark, sf_dir), ["api_name", "pod"], STEP, RANGE)
    means = now.groupBy("api_name", "ts").agg((1.5 * F.avg("value")).alias("value"))
    fixed = timeseries.threshold_alerts(now, 80.0).withColumn("kind", F.lit("fixed"))
    series = timeseries.threshold_alerts(now, means, ["api_name", "ts"]).withColumn("kind", F.lit("series"))
    return fixed.unionByName(series).select("kind", "pod", "ts", "value", "bound")
