"""Queries for autoscaling, routing, APIs, cost and capacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import apis, autoscale, cost, routing, timeseries
from tideline.plans import views
from tideline.plans.q_timeseries import RANGE, STEP, grid_sql, rounded
from tideline.plans.registry import query
from tideline.plans.views_sql import view

HOUR = 3600

# ---- autoscaling

view(
    "v_load",
    f"""
    SELECT api_name, make_timestamp(at_us) AS ts, sum(s) / max(n) AS avg_in_flight
    FROM (SELECT api_name, pod, at_us, sum(v) AS s, count(v) AS n
          FROM ({grid_sql("v_gauge", "api_name, pod", RANGE, STEP)}) GROUP BY 1, 2, 3)
    GROUP BY api_name, at_us
    """,
    "v_gauge",
)
TARGET = 24.0
MAX_REPLICAS = 9


def load(spark, sf_dir):
    windows = timeseries.avg_in_flight(views.gauge(spark, sf_dir), RANGE, STEP)
    return windows.withColumnRenamed("value", "avg_in_flight")


def settings(df):
    return df.withColumn("target_in_flight", F.lit(TARGET)).withColumn("max_replicas", F.lit(MAX_REPLICAS))


def recommend_sql(current: str, down: float = 0.75, low: int = 1) -> str:
    raw = f"(avg_in_flight / {TARGET})"
    return f"""least(greatest(least(greatest(
        CASE WHEN ({raw} < {current} AND {raw} > {current} * (1 - 0.05::DOUBLE)) OR ({raw} > {current} AND {raw} < {current} * (1 + 0.05::DOUBLE))
             THEN {current} ELSE ceil({raw}) END,
        least({current} - 1, ceil({current} * {down}::DOUBLE))), greatest({current} + 1, ceil({current} * 1.5))), {low}), {MAX_REPLICAS})::INTEGER"""


@query(
    "aut_1",
    f"""
    SELECT api_name, ts, current, {recommend_sql("current")} AS recommendation
    FROM (SELECT *, (1 + day(ts) % 12)::INTEGER AS current FROM v_load)
    """,
    "v_load",
)
def aut_1(spark, sf_dir):
    ticks = load(spark, sf_dir).withColumn("current", (1 + F.dayofmonth("ts") % 12).cast("int"))
    recs = autoscale.recommend(settings(autoscale.with_spec(ticks)))
    return recs.select("api_name", "ts", "current", "recommendation")


@query(
    "win_7",
    f"""
    WITH r AS (SELECT api_name, ts, ceil(avg_in_flight / {TARGET})::INTEGER AS recommendation FROM v_load)
    SELECT 'down' AS kind, api_name, ts, max(recommendation) OVER w AS stabilized FROM r
    WINDOW w AS (PARTITION BY api_name ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW)
    UNION ALL
    SELECT 'up', api_name, ts, min(recommendation) OVER w FROM r
    WINDOW w AS (PARTITION BY api_name ORDER BY ts RANGE BETWEEN INTERVAL 8 HOUR PRECEDING AND CURRENT ROW)
    """,
    "v_load",
)
def win_7(spark, sf_dir):
    recs = load(spark, sf_dir).select(
        "api_name", "ts", F.ceil(F.col("avg_in_flight") / TARGET).cast("int").alias("recommendation")
    )
    down = autoscale.stabilize(recs, 12 * HOUR, "down").withColumn("kind", F.lit("down"))
    up = autoscale.stabilize(recs, 8 * HOUR, "up").withColumn("kind", F.lit("up"))
    return down.unionByName(up).select("kind", "api_name", "ts", "stabilized")


def _within(hours: int) -> str:
    return f"list_filter(recs, lambda x: x.t >= ts - INTERVAL {hours} HOUR)"


@query(
    "aut_2",
    f"""
    WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY api_name ORDER BY ts) AS i FROM v_load),
    f AS (
      SELECT api_name, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, min(ts) AS started, 2 AS before, 2 AS rec, 2 AS request,
             [{{'t': NULL::TIMESTAMP, 'r': 0}}][1:0] AS recs FROM t GROUP BY 1
      UNION ALL
      SELECT api_name, i, ts, started, before, rec,
        CASE WHEN down_req > before THEN CASE WHEN ts - started < INTERVAL 8 HOUR THEN before
             ELSE least(down_req, greatest(list_min(list_transform({_within(8)}, lambda x: x.r)), before)) END ELSE down_req END AS request, recs
      FROM (SELECT *, CASE WHEN rec < before THEN CASE WHEN ts - started < INTERVAL 12 HOUR THEN before
                ELSE greatest(rec, least(list_max(list_transform({_within(12)}, lambda x: x.r)), before)) END ELSE rec END AS down_req
            FROM (SELECT api_name, i, ts, started, before, rec, list_append(recs, {{'t': ts, 'r': rec}}) AS recs
                  FROM (SELECT f.api_name, t.i, t.ts, f.started, f.request AS before, f.recs,
                               {recommend_sql("f.request").replace("avg_in_flight", "t.avg_in_flight")} AS rec
                        FROM f JOIN t ON t.api_name = f.api_name AND t.i = f.i + 1)))
    )
    SELECT api_name, ts, before AS current, rec AS recommendation, request FROM f WHERE i > 0
    """,
    "v_load",
)
def aut_2(spark, sf_dir):
    specs = load(spark, sf_dir).select("api_name").distinct()
    specs = specs.withColumns(
        {
            "target_in_flight": F.lit(TARGET),
            "max_replicas": F.lit(MAX_REPLICAS),
            "init_replicas": F.lit(2),
            "downscale_stabilization_s": F.lit(12.0 * HOUR),
            "upscale_stabilization_s": F.lit(8.0 * HOUR),
        }
    )
    decisions = autoscale.decide(load(spark, sf_dir), specs)
    return decisions.select("api_name", "ts", "current", "recommendation", "request")


@query(
    "aut_3",
    f"""
    WITH RECURSIVE e AS (
      SELECT api_name, ts, 'tick' AS event, CASE WHEN day(ts) % 3 = 0 THEN 0.0::DOUBLE ELSE avg_in_flight END AS avg_in_flight FROM v_load
      UNION ALL
      SELECT api_name, min(ts), 'wake', NULL FROM v_requests GROUP BY api_name, epoch_us(ts) // {STEP * 1_000_000}),
    t AS (SELECT *, row_number() OVER (PARTITION BY api_name ORDER BY ts, event) AS i FROM e),
    f AS (
      SELECT DISTINCT api_name, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, 'start' AS event, 0 AS before, 0 AS request FROM t
      UNION ALL
      SELECT f.api_name, t.i, t.ts, t.event, f.request,
        CASE WHEN t.event = 'wake' THEN CASE WHEN f.request = 0 THEN 1 ELSE f.request END
             ELSE {recommend_sql("f.request", 0.0, 0).replace("avg_in_flight", "t.avg_in_flight")} END
      FROM f JOIN t ON t.api_name = f.api_name AND t.i = f.i + 1)
    SELECT api_name, ts, event, before AS current, request AS recommendation, request FROM f
    WHERE event = 'tick' OR (event = 'wake' AND before = 0)
    """,
    "v_load v_requests",
)
def aut_3(spark, sf_dir):
    """APIs that sleep every third day, woken by the first request of a tick."""
    ticks = load(spark, sf_dir).withColumn(
        "avg_in_flight", F.when(F.dayofmonth("ts") % 3 == 0, 0.0).otherwise(F.col("avg_in_flight"))
    )
    specs = ticks.select("api_name").distinct()
    specs = specs.withColumns(
        {
            "target_in_flight": F.lit(TARGET),
            "min_replicas": F.lit(0),
            "max_replicas": F.lit(MAX_REPLICAS),
            "max_downscale_factor": F.lit(0.0),
            "downscale_stabilization_s": F.lit(0.0),
            "upscale_stabilization_s": F.lit(0.0),
        }
    )
    wakes = autoscale.first_wakes(views.requests(spark, sf_dir), STEP)
    return autoscale.decide(ticks, specs, wakes)


# ---- routing


def split_requests(spark, sf_dir):
    """Requests that name one of three splitters."""
    splitter = F.concat(F.lit("split-"), (F.col("request_id") % 3).cast("string"))
    return views.requests(spark, sf_dir).select("request_id", "status_code", "duration_s", splitter.alias("splitter"))


#: (splitter, target, weight, shadow)
SHADOWED = [
    ("split-0", "api-0", 30, False),
    ("split-0", "api-1", 70, False),
    ("split-0", "api-2", 40, True),
    ("split-1", "api-1", 100, False),
    ("split-2", "api-0", 10, False),
    ("split-2", "api-1", 20, False),
    ("split-2", "api-2", 70, False),
    ("split-2", "api-3", 5, True),
]


def _ranges_sql(shadow: bool) -> str:
    rows, at = [], {}
    for splitter, target, weight, is_shadow in SHADOWED:
        if is_shadow == shadow:
            low = 0 if shadow else at.get(splitter, 0)
            at[splitter] = low + weight
            rows.append(f"('{splitter}', '{target}', {low}, {low + weight})")
    return f"(VALUES {', '.join(rows)}) AS t(splitter, target, lo, hi)"


view(
    "v_routed",
    f"""
    SELECT request_id, status_code, duration_s, r.splitter, target, is_shadow
    FROM (SELECT *, 'split-' || (request_id % 3)::VARCHAR AS splitter,
                 ('0x' || substr(md5('route:' || request_id::VARCHAR), 1, 8))::BIGINT % 100 AS b,
                 ('0x' || substr(md5('shadow:' || request_id::VARCHAR), 1, 8))::BIGINT % 100 AS c FROM v_requests) r
    JOIN (SELECT *, false AS is_shadow FROM {_ranges_sql(False)} UNION ALL SELECT *, true FROM {_ranges_sql(True)}) t
      ON r.splitter = t.splitter AND CASE WHEN is_shadow THEN c ELSE b END >= lo AND CASE WHEN is_shadow THEN c ELSE b END < hi
    """,
    "v_requests",
)


@query("jon_4", "SELECT request_id, splitter, target FROM v_routed WHERE NOT is_shadow", "v_routed")
def jon_4(spark, sf_dir):
    routed = routing.route(split_requests(spark, sf_dir), views.splits(spark, SHADOWED))
    return routed.select("request_id", "splitter", "target")


@query("jon_5", "SELECT request_id, splitter, target, is_shadow FROM v_routed", "v_routed")
def jon_5(spark, sf_dir):
    routed = routing.route_with_shadow(split_requests(spark, sf_dir), views.splits(spark, SHADOWED))
    return routed.select("request_id", "splitter", "target", "is_shadow")


@query(
    "agg_20",
    """
    SELECT splitter, target, is_shadow, count(*) AS n, avg(CASE WHEN status_code >= 500 THEN 1.0::DOUBLE ELSE 0 END) AS error_rate,
           round(avg(duration_s), 7) AS mean_s, count(*) / sum(count(*)) OVER (PARTITION BY splitter, is_shadow) AS share
    FROM v_routed GROUP BY 1, 2, 3
    """,
    "v_routed",
)
def agg_20(spark, sf_dir):
    routed = routing.route_with_shadow(split_requests(spark, sf_dir), views.splits(spark, SHADOWED))
    return rounded(routing.split_outcomes(routed), 7, "mean_s")


# Splitters and the APIs they name, many of them invalid, from the line items.
view(
    "v_many_splits",
    """
    SELECT 'split-' || (l_orderkey % 3000)::VARCHAR AS splitter, 'api-' || (l_suppkey % 40)::VARCHAR AS target,
           (l_quantity * 2)::INTEGER AS weight, l_returnflag = 'R' AS shadow
    FROM lineitem
    """,
)


def many_splits(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("split-"), (F.col("l_orderkey") % 3000).cast("string")).alias("splitter"),
        F.concat(F.lit("api-"), (F.col("l_suppkey") % 40).cast("string")).alias("target"),
        (F.col("l_quantity") * 2).cast("int").alias("weight"),
        (F.col("l_returnflag") == "R").alias("shadow"),
    )


@query(
    "agg_17",
    """
    SELECT splitter, total_weight, array_to_string(list_filter([CASE WHEN total_weight <> 100 THEN 'weights' END,
        CASE WHEN n <> u THEN 'not_unique' END, CASE WHEN s > 1 THEN 'shadows' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM (SELECT splitter, coalesce(sum(weight) FILTER (NOT shadow), 0)::BIGINT AS total_weight, count(*) AS n,
                 count(DISTINCT target) AS u, count(*) FILTER (shadow) AS s FROM v_many_splits GROUP BY 1)
    """,
    "v_many_splits",
)
def agg_17(spark, sf_dir):
    return routing.validate_splits(many_splits(spark, sf_dir)).withColumn("violations", F.array_join("violations", ","))


@query(
    "jon_11",
    """
    SELECT DISTINCT splitter, target FROM v_many_splits WHERE target NOT IN (SELECT DISTINCT 'api-' || (s_suppkey % 30)::VARCHAR FROM supplier)
      AND target NOT IN (SELECT DISTINCT 'api-' || (30 + c_nationkey % 5)::VARCHAR FROM customer)
    """,
    "v_many_splits",
)
def jon_11(spark, sf_dir):
    name = lambda number: F.concat(F.lit("api-"), number.cast("string")).alias("api_name")
    deployed = views.table(spark, sf_dir, "supplier").select(name(F.col("s_suppkey") % 30))
    defined = views.table(spark, sf_dir, "customer").select(name(30 + F.col("c_nationkey") % 5))
    return routing.missing_targets(many_splits(spark, sf_dir), deployed, defined)


@query(
    "jon_12",
    """
    SELECT DISTINCT target AS api_name, splitter FROM v_many_splits
    WHERE target IN (SELECT 'api-' || s_suppkey::VARCHAR FROM supplier)
    """,
    "v_many_splits",
)
def jon_12(spark, sf_dir):
    names = views.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("api-"), F.col("s_suppkey").cast("string")).alias("api_name")
    )
    return routing.used_by(names, many_splits(spark, sf_dir))


# ---- APIs

view(
    "v_endpoints",
    "SELECT 'api-' || (page_id % 190)::VARCHAR AS api_name, '/' || split_part(split_part(split_part(url, '?', 1), '#', 1), '/', 5) || CASE WHEN page_id % 4 = 0 THEN '/' ELSE '' END AS endpoint FROM pages",
)


def endpoints(spark, sf_dir):
    key = F.col("page_id")
    part = F.split_part(
        F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), F.lit("/"), F.lit(5)
    )
    return views.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("api-"), (key % 190).cast("string")).alias("api_name"),
        F.concat(F.lit("/"), part, F.when(key % 4 == 0, "/").otherwise("")).alias("endpoint"),
    )


@query(
    "agg_16",
    """
    SELECT 'name' AS field, api_name AS value, count(*) AS n, NULL::VARCHAR AS taken_by FROM v_endpoints GROUP BY 2 HAVING count(*) > 1
    UNION ALL
    SELECT 'endpoint', e, count(*), NULL FROM (SELECT CASE WHEN endpoint IN ('', '/') THEN '/' ELSE regexp_replace(endpoint, '/$', '') END AS e FROM v_endpoints)
    GROUP BY 2 HAVING count(*) > 1
    UNION ALL
    SELECT 'collision', a.endpoint, a.n, CASE WHEN min(d.api_name) <> a.api_name THEN min(d.api_name) ELSE max(d.api_name) END
    FROM (SELECT api_name, endpoint, count(*) AS n, rtrim(endpoint, '/') AS k FROM v_endpoints GROUP BY 1, 2) a
    JOIN v_endpoints d ON rtrim(d.endpoint, '/') = a.k
    GROUP BY a.api_name, a.endpoint, a.n HAVING count(DISTINCT d.api_name) > 1
    """,
    "v_endpoints",
)
def agg_16(spark, sf_dir):
    from tideline.functions.text import canonical_endpoint

    rows = endpoints(spark, sf_dir)
    none = F.lit(None).cast("string").alias("taken_by")
    names = apis.duplicates(rows, "api_name").select(F.lit("name").alias("field"), F.col("api_name").alias("value"), "n", none)
    canonical = rows.withColumn("endpoint", canonical_endpoint(F.col("endpoint")))
    places = apis.duplicates(canonical, "endpoint").select(
        F.lit("endpoint").alias("field"), F.col("endpoint").alias("value"), "n", none
    )
    mine = rows.groupBy("api_name", "endpoint").agg(F.count(F.lit(1)).alias("n"))
    taken = apis.endpoint_collisions(mine, rows).select(
        F.lit("collision").alias("field"), F.col("endpoint").alias("value"), "n", "taken_by"
    )
    return names.unionByName(places).unionByName(taken)


@query(
    "srt_3",
    """
    SELECT lower(format('{:016x}', 9223372036854775807 - epoch_us(ts) * 1000)) || '-v' || event_id AS api_id, event_id, ts AS created_at FROM events
    """,
)
def srt_3(spark, sf_dir):
    nanos = timeseries.micros("ts") * 1000
    hex_id = F.lower(F.lpad(F.hex(F.lit(9223372036854775807) - nanos), 16, "0"))
    events = views.table(spark, sf_dir, "events").select(
        F.concat(hex_id, F.lit("-v"), F.col("event_id").cast("string")).alias("api_id"), "event_id"
    )
    return apis.api_history(events)


@query("srt_4", "SELECT node_id, instance_type, is_spot FROM v_nodes ORDER BY instance_type, node_id", "v_nodes")
def srt_4(spark, sf_dir):
    return apis.sort_by_name(
        views.nodes(spark, sf_dir).select("node_id", "instance_type", "is_spot"), "instance_type", "node_id"
    )


# ---- cost and capacity

view(
    "v_priced",
    """
    SELECT n.*, o.price AS on_demand_price, CASE WHEN is_spot THEN coalesce(nullif(s.price, 0), o.price) ELSE o.price END AS price
    FROM v_nodes n LEFT JOIN v_od o USING (instance_type) LEFT JOIN v_spot s USING (instance_type)
    """,
    "v_nodes",
    "v_od",
    "v_spot",
)


def priced_nodes(spark, sf_dir):
    nodes = views.nodes(spark, sf_dir)
    return cost.price_nodes(nodes, views.on_demand_prices(spark, sf_dir), views.spot_prices(spark, sf_dir))


@query("jon_1", "SELECT node_id, instance_type, is_spot, price, on_demand_price FROM v_priced", "v_priced")
def jon_1(spark, sf_dir):
    return priced_nodes(spark, sf_dir).select("node_id", "instance_type", "is_spot", "price", "on_demand_price")


view(
    "v_apipods",
    """
    SELECT *, pod_id % 5 <> 0 AS is_api, kind = 'BatchAPI' AND pod_id % 4 = 0 AS is_enqueuer, pod_id % 3 % 2 AS gpu FROM v_pods
    """,
    "v_pods",
)


def api_pods(spark, sf_dir):
    key = F.col("pod_id")
    return views.pods(spark, sf_dir).withColumns(
        {
            "is_api": key % 5 != 0,
            "is_enqueuer": (F.col("kind") == "BatchAPI") & (key % 4 == 0),
            "gpu": key % 3 % 2,
        }
    )


@query(
    "jon_2",
    """
    WITH p AS (SELECT * FROM v_apipods WHERE phase NOT IN ('Succeeded', 'Failed')),
    s AS (SELECT node_id, count(*) FILTER (is_api AND NOT is_enqueuer) AS n_replicas, count(*) FILTER (is_api AND is_enqueuer) AS n_enqueuers,
            sum(cpu_m) AS c, sum(mem_mi) AS m, sum(gpu) AS g, sum(cpu_m) FILTER (is_api) AS ac, sum(mem_mi) FILTER (is_api) AS am, sum(gpu) FILTER (is_api) AS ag
          FROM p WHERE node_id IS NOT NULL GROUP BY 1)
    SELECT n.node_id, coalesce(n_replicas, 0) AS n_replicas, coalesce(n_enqueuers, 0) AS n_enqueuers,
      (cpu_m - coalesce(c, 0))::BIGINT AS available_cpu_m, (cpu_m - coalesce(c, 0) + coalesce(ac, 0))::BIGINT AS user_capacity_cpu_m, coalesce(ac, 0)::BIGINT AS user_requested_cpu_m,
      (mem_mi - coalesce(m, 0))::BIGINT AS available_mem_mi, (mem_mi - coalesce(m, 0) + coalesce(am, 0))::BIGINT AS user_capacity_mem_mi, coalesce(am, 0)::BIGINT AS user_requested_mem_mi,
      (8 - coalesce(g, 0))::BIGINT AS available_gpu, (8 - coalesce(g, 0) + coalesce(ag, 0))::BIGINT AS user_capacity_gpu, coalesce(ag, 0)::BIGINT AS user_requested_gpu
    FROM v_nodes n LEFT JOIN s USING (node_id)
    UNION ALL
    SELECT NULL, count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE node_id IS NULL AND is_api
    """,
    "v_apipods v_nodes",
)
def jon_2(spark, sf_dir):
    """Capacity per node; the row without a node counts pending replicas."""
    pods = api_pods(spark, sf_dir)
    nodes = views.nodes(spark, sf_dir).withColumn("gpu", F.lit(8))
    capacity = cost.node_capacity(nodes, pods)
    pending = cost.pending_replicas(pods).select(F.col("n_pending").alias("n_replicas"))
    return capacity.unionByName(pending, allowMissingColumns=True)


view(
    "v_fits",
    """
    SELECT p.*, least(58, floor((n.cpu_m - 260) / p.cpu_m), floor((n.mem_mi - 350) / p.mem_mi))::BIGINT AS fits
    FROM v_pods p JOIN (SELECT node_id, cpu_m, mem_mi FROM v_nodes) n USING (node_id)
    """,
    "v_pods",
    "v_nodes",
)


@query("agg_23", "SELECT pod_id, node_id, fits FROM v_fits", "v_fits")
def agg_23(spark, sf_dir):
    return fitted(spark, sf_dir).select("pod_id", "node_id", "fits")


def fitted(spark, sf_dir):
    nodes = views.nodes(spark, sf_dir).withColumn("max_pods", F.lit(58))
    return cost.pods_fit(nodes, views.pods(spark, sf_dir))


COST_SQL = """
    SELECT 'total' AS scope, 'cluster' AS component, round(total, 4) AS cost FROM t
    UNION ALL SELECT 'system', 'system', round(system, 4) FROM t
    UNION ALL SELECT 'api', api_name, round(sum(c) * max(ratio), 4) FROM x GROUP BY 2
    UNION ALL SELECT 'kind', kind, round(sum(c) * max(ratio), 4) FROM x GROUP BY 2
"""
COST_VIEWS = """
    t AS (SELECT sum(price) + 0.5 AS total, sum(price) FILTER (NOT workload) + 0.5 AS system FROM v_priced),
    c AS (SELECT api_name, kind, n.price / fits AS c FROM v_fits JOIN (SELECT node_id, price FROM v_priced WHERE workload) n USING (node_id)),
    x AS (SELECT *, (SELECT total - system FROM t) / (SELECT sum(c) FROM c) AS ratio FROM c)
"""


@query("agg_12", f"WITH {COST_VIEWS} {COST_SQL}", "v_priced v_fits")
def agg_12(spark, sf_dir):
    return rounded(cost.cost_breakdown(priced_nodes(spark, sf_dir), fitted(spark, sf_dir), 0.5), 4, "cost")


@query(
    "agg_13",
    """
    SELECT instance_type, is_spot, count(*) AS n_nodes, round(sum(price), 4) AS total_price,
           round(sum(on_demand_price), 4) AS total_on_demand, round(sum(on_demand_price) - sum(price), 4) AS savings
    FROM v_priced WHERE workload GROUP BY GROUPING SETS ((instance_type, is_spot), ())
    """,
    "v_priced",
)
def agg_13(spark, sf_dir):
    inventory = cost.instance_inventory(priced_nodes(spark, sf_dir))
    return rounded(inventory, 4, "total_price", "total_on_demand", "savings")


@query(
    "agg_14",
    """
    SELECT api_name, sum(v)::BIGINT AS visible, sum(n)::BIGINT AS not_visible, sum(v + n)::BIGINT AS in_flight,
           greatest(sum(v + n) - 1, 0)::BIGINT AS user_messages
    FROM (SELECT 'batch-' || (o_custkey % 700)::VARCHAR AS api_name, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS v,
                 CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS n FROM orders) GROUP BY 1
    """,
)
def agg_14(spark, sf_dir):
    status = F.col("o_orderstatus")
    queues = views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("batch-"), (F.col("o_custkey") % 700).cast("string")).alias("api_name"),
        (status == "O").cast("long").alias("visible"),
        (status == "P").cast("long").alias("not_visible"),
    )
    return cost.queue_depth(queues, ["api_name"])


@query(
    "agg_18",
    """
    WITH m AS (SELECT instance_type, min(p_partkey) * 7 % 17000 AS mem_mi FROM v_prices GROUP BY 1),
    k AS (SELECT * FROM m UNION ALL SELECT instance_type, mem_mi - node_id * 3 % 900 FROM v_nodes
          UNION ALL SELECT 'type-' || (c_custkey % 6)::VARCHAR, 15000 + c_custkey % 2000 FROM customer)
    SELECT instance_type, min(mem_mi) AS mem_mi FROM k WHERE mem_mi > 0 AND instance_type IN (SELECT instance_type FROM m) GROUP BY 1
    """,
    "v_prices v_nodes",
)
def agg_18(spark, sf_dir):
    metadata = (
        views.prices(spark, sf_dir).groupBy("instance_type").agg((F.min("p_partkey") * 7 % 17000).alias("mem_mi"))
    )
    nodes = views.nodes(spark, sf_dir).select(
        "instance_type", (F.col("mem_mi") - F.col("node_id") * 3 % 900).alias("mem_mi")
    )
    key = F.col("c_custkey")
    previous = views.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("type-"), (key % 6).cast("string")).alias("instance_type"), (15000 + key % 2000).alias("mem_mi")
    )
    return cost.min_capacity(metadata, nodes, previous)


@query(
    "agg_19",
    """
    SELECT instance_type, CASE WHEN min(p) > 0 THEN min(p) END AS price
    FROM (SELECT instance_type, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE price - CASE WHEN instance_type = 'type-0' THEN 5 ELSE 0 END END AS p FROM v_prices)
    GROUP BY 1
    """,
    "v_prices",
)
def agg_19(spark, sf_dir):
    price = F.col("price") - F.when(F.col("instance_type") == "type-0", 5).otherwise(0)
    quoted = F.when(F.col("p_partkey") % 9 == 0, "n/a").otherwise(price.cast("string"))
    return cost.spot_price(views.prices(spark, sf_dir).select("instance_type", quoted.alias("price")))


view(
    "v_groups",
    """
    SELECT s_suppkey AS name, ['gp2', 'gp3', 'io1', 'st1'][(s_suppkey % 4 + 1)::INTEGER] AS volume_type, (50 + s_suppkey % 100)::INTEGER AS volume_gb,
           CASE WHEN s_suppkey % 3 <> 0 THEN (2500 + s_suppkey * 10)::INTEGER END AS iops, CASE WHEN s_suppkey % 6 <> 0 THEN (100 + s_suppkey)::INTEGER END AS throughput,
           s_suppkey % 12 = 0 AS is_system FROM supplier
    """,
)


@query(
    "fun_9",
    """
    WITH g AS (SELECT name, CASE WHEN is_system THEN 'gp3' ELSE volume_type END AS vt, CASE WHEN is_system THEN 20 ELSE volume_gb END AS gb, iops, throughput FROM v_groups),
    p AS (SELECT * FROM (VALUES ('gp2', 0.11, 0.0, 0.0), ('gp3', 0.088, 0.0055, 0.044), ('io1', 0.138, 0.072, 0.0), ('st1', 0.05, 0.0, 0.0)) AS t(vt, g, i, t))
    SELECT name, round((p.g::DOUBLE * gb + CASE WHEN vt = 'io1' AND iops IS NOT NULL THEN p.i::DOUBLE * iops
        WHEN vt = 'gp3' AND iops IS NOT NULL AND throughput IS NOT NULL THEN p.i::DOUBLE * greatest(iops - 3000, 0) + p.t::DOUBLE * greatest(throughput - 125, 0)
        ELSE 0 END) / 30 / 24, 8) AS volume_price
    FROM g JOIN p USING (vt)
    """,
    "v_groups",
)
def fun_9(spark, sf_dir):
    key = F.col("s_suppkey")
    system = key % 12 == 0
    kinds = F.array(*[F.lit(k) for k in ("gp2", "gp3", "io1", "st1")])
    groups = views.table(spark, sf_dir, "supplier").select(
        key.alias("name"),
        F.when(~system, F.get(kinds, (key % 4).cast("int"))).alias("volume_type"),
        (50 + key % 100).cast("int").alias("volume_gb"),
        F.when(key % 3 != 0, (2500 + key * 10).cast("int")).alias("iops"),
        F.when(key % 6 != 0, (100 + key).cast("int")).alias("throughput"),
        system.alias("is_system"),
    )
    quoted = [("gp2", 0.11, 0.0, 0.0), ("gp3", 0.088, 0.0055, 0.044), ("io1", 0.138, 0.072, 0.0), ("st1", 0.05, 0.0, 0.0)]
    prices = spark.createDataFrame(
        quoted, "volume_type string, price_gb double, price_iops double, price_throughput double"
    )
    priced = cost.volume_price(groups, prices)
    return rounded(priced.select("name", "volume_price"), 8, "volume_price")


@query(
    "fun_10",
    """
    WITH r AS (SELECT 'type-' || (p_size % 5)::VARCHAR AS region, min(p_retailprice) / 10000 AS eks, max(p_retailprice) / 50000 AS nlb,
                 min(p_partkey) / 1000 + 0.02::DOUBLE AS elb_price, max(p_partkey) / 100000 AS nat_price FROM part GROUP BY 1),
    c AS (SELECT c_custkey, 'type-' || (c_custkey % 5)::VARCHAR AS region, ['none', 'single', 'highly_available'][(c_custkey % 3 + 1)::INTEGER] AS nat,
            c_nationkey % 4 AS zones, c_custkey % 3 AS ops, c_custkey % 2 = 0 AS elb FROM customer),
    i AS (SELECT c_custkey, eks AS control_plane, 0.1::DOUBLE * 42 / 720 AS metrics_volume, CASE WHEN elb THEN nlb + elb_price ELSE 2 * nlb END AS load_balancers,
            CASE nat WHEN 'single' THEN nat_price WHEN 'highly_available' THEN nat_price * zones ELSE 0 END AS nat,
            ops * (0.04::DOUBLE + 0.08::DOUBLE * 20 / 720) AS operator_nodes, 1 * (0.1::DOUBLE + 0.08::DOUBLE * 20 / 720) AS metrics_nodes
          FROM c JOIN r USING (region)),
    a AS (SELECT *, control_plane + metrics_volume + load_balancers + nat + operator_nodes + metrics_nodes AS total FROM i)
    SELECT c_custkey, item, round(price, 6) AS price FROM (UNPIVOT a ON control_plane, metrics_volume, load_balancers, nat, operator_nodes, metrics_nodes, total INTO NAME item VALUE price)
    """,
)
def fun_10(spark, sf_dir):
    key = F.col("c_custkey")
    region = lambda number: F.concat(F.lit("type-"), (number % 5).cast("string"))
    nats = F.array(F.lit("none"), F.lit("single"), F.lit("highly_available"))
    clusters = views.table(spark, sf_dir, "customer").select(
        region(key).alias("region"),
        F.get(nats, (key % 3).cast("int")).alias("nat"),
        (F.col("c_nationkey") % 4).alias("n_zones"),
        (key % 3).alias("n_operator"),
        F.lit(1).alias("n_metrics"),
        (key % 2 == 0).alias("elb"),
        key.alias("c_custkey"),
    )
    prices = (
        views.table(spark, sf_dir, "part")
        .groupBy(region(F.col("p_size")).alias("region"))
        .agg(
            (F.min("p_retailprice") / 10000).alias("eks"),
            (F.max("p_retailprice") / 50000).alias("nlb"),
            (F.min("p_partkey") / 1000 + 0.02).alias("elb_price"),
            (F.max("p_partkey") / 100000).alias("nat_price"),
            F.lit(0.1).alias("gp2_gb"),
            F.lit(0.08).alias("gp3_gb"),
            F.lit(0.04).alias("operator_node"),
            F.lit(0.1).alias("metrics_node"),
        )
    )
    items = cost.system_price(clusters, prices, keep=["c_custkey"])
    return rounded(items.select("c_custkey", "item", "price"), 6, "price")
