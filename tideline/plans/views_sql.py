"""The same views as DuckDB text, for the oracle queries."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (needs, sql)


def with_views(names: str, sql: str) -> str:
    """``sql`` behind a WITH clause that defines the named views and what they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in ordered)
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


view(
    "v_requests",
    """
    SELECT event_id AS request_id, ts, 'api-' || (user_id % 5)::VARCHAR AS api_name,
           'pod-' || (user_id % 20)::VARCHAR AS pod,
           CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status_code,
           value / 100.0 AS duration_s, (props->>'$.k')::INTEGER AS in_flight
    FROM events
    """,
)
view("v_gauge", "SELECT 'in_flight' AS name, api_name, pod, ts, in_flight::DOUBLE AS value FROM v_requests", "v_requests")
view(
    "v_counter",
    """
    SELECT api_name, pod, status_code, ts,
           (1 + (row_number() OVER (PARTITION BY pod, status_code ORDER BY ts, request_id) - 1) % 40)::DOUBLE AS value
    FROM v_requests
    """,
    "v_requests",
)
view(
    "v_jobs",
    """
    SELECT o_orderkey AS job_id, 'batch-' || (o_custkey % 7)::VARCHAR AS api_name, o_orderdate AS submitted_at,
           o_orderstatus, o_orderpriority
    FROM orders
    """,
)
view(
    "v_batches",
    """
    SELECT l_orderkey AS job_id,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
                              l_extendedprice, l_quantity) AS batch_no,
           l_returnflag <> 'R' AS ok, l_quantity AS secs, l_extendedprice AS amount, l_linestatus, l_shipdate
    FROM lineitem
    """,
)
view(
    "v_markers",
    """
    SELECT job_id, api_name, e.marker AS marker, submitted_at + to_minutes(e.rank) AS mtime
    FROM (
      SELECT job_id, api_name, submitted_at, unnest(list_filter([
        CASE WHEN job_id % 50 <> 0 THEN {'rank': 0, 'marker': 'spec.json'} END,
        {'rank': 1, 'marker': 'enqueuing'},
        CASE WHEN o_orderstatus <> 'P' THEN {'rank': 2, 'marker': 'running'} END,
        CASE WHEN o_orderstatus = 'F' THEN {'rank': 3, 'marker': CASE o_orderpriority WHEN '1-URGENT' THEN 'worker_oom'
             WHEN '2-HIGH' THEN 'completed_with_failures' ELSE 'succeeded' END} END,
        CASE WHEN o_orderstatus = 'F' THEN {'rank': 4, 'marker': 'stopped'} END
      ], lambda x: x IS NOT NULL)) AS e
      FROM v_jobs)
    """,
    "v_jobs",
)
view(
    "v_async",
    """
    SELECT event_id AS request_id, 'async-' || (user_id % 5)::VARCHAR AS api_name, ts, unnest(list_filter([
        'in_queue',
        CASE WHEN event_type <> 'view' THEN 'in_progress' END,
        CASE WHEN event_type IN ('purchase', 'click') THEN 'completed' END,
        CASE WHEN event_type = 'error' THEN 'failed' END], lambda x: x IS NOT NULL)) AS marker
    FROM events
    """,
)
view(
    "v_items",
    """
    SELECT doc_id AS item_id, to_json({'doc_id': doc_id, 'lang': lang, 'text': text})::VARCHAR AS body, source, text
    FROM documents
    """,
)
view("v_files", "SELECT page_id, url AS path, length(html)::INTEGER AS size FROM pages")
view(
    "v_nodes",
    """
    SELECT s_suppkey AS node_id, 'type-' || (s_suppkey % 5)::VARCHAR AS instance_type, s_suppkey % 3 = 0 AS is_spot,
           s_suppkey % 10 <> 0 AS workload, 4000 + 1000 * (s_suppkey % 4) AS cpu_m, 16384::BIGINT AS mem_mi
    FROM supplier
    """,
)
view(
    "v_pods",
    """
    SELECT c_custkey AS pod_id,
           CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 1 + c_custkey % (SELECT count(*) FROM supplier) END AS node_id,
           c_mktsegment AS api_name,
           CASE c_nationkey % 3 WHEN 0 THEN 'RealtimeAPI' WHEN 1 THEN 'AsyncAPI' ELSE 'BatchAPI' END AS kind,
           100 + 50 * (c_custkey % 6) AS cpu_m, 256 + 128 * (c_custkey % 4) AS mem_mi,
           CASE c_custkey % 7 WHEN 0 THEN 'Failed' WHEN 1 THEN 'Succeeded' WHEN 2 THEN 'Pending'
                ELSE 'Running' END AS phase
    FROM customer
    """,
)
view(
    "v_prices",
    """
    SELECT 'type-' || (p_size % 5)::VARCHAR AS instance_type, p_retailprice / 1000 + p_size % 5 AS price, p_partkey
    FROM part
    """,
)
view("v_od", "SELECT instance_type, max(price) AS price FROM v_prices GROUP BY 1", "v_prices")
view(
    "v_spot",
    "SELECT instance_type, min(price) AS price FROM v_prices WHERE instance_type <> 'type-4' GROUP BY 1",
    "v_prices",
)
view(
    "v_splits",
    """
    SELECT * FROM (VALUES ('split-a', 'api-0', 30, false), ('split-a', 'api-1', 70, false),
                          ('split-a', 'api-2', 100, true)) AS t(splitter, target, weight, shadow)
    """,
)
view(
    "v_log_rows",
    """
    SELECT conv_id, turn, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn) AS ts,
           CASE WHEN role IN ('user', 'system') THEN text END AS message,
           CASE WHEN role IN ('assistant', 'system') THEN 'm:' || text END AS msg,
           CASE WHEN role = 'assistant' THEN 'info' END AS levelname,
           role AS api_name, conv_id::VARCHAR AS job_id
    FROM conversations
    """,
)
