"""Queries for text jobs, rules, prices, logs and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import identity, presets, rules, text
from tideline.functions.rules import Field
from tideline.operators import logs, sets
from tideline.plans import views
from tideline.plans.registry import query
from tideline.plans.views_sql import view
from tideline.session import materialise, spread
from tideline.sources import offers


@query(
    "fun_1",
    r"""
    WITH b AS (SELECT page_id, regexp_replace(url, '(https?://.*)\?[^:\s]*', '\1') AS bare_url FROM pages),
    p AS (SELECT *, split_part('/' || array_to_string(string_split(bare_url, '/')[4:], '/'), '#', 1) AS path FROM b)
    SELECT page_id, bare_url, CASE WHEN path IN ('', '/') THEN '/' WHEN ends_with(path, '/') THEN path[:-2] ELSE path END AS endpoint,
           CASE WHEN ends_with(path, '/') THEN path ELSE path || '/' END AS endpoint_slash,
           '/v1/' || substr(path, 2) || CASE WHEN ends_with(path, '/') THEN '' ELSE '/' END || 'predict' AS joined,
           CASE WHEN NOT regexp_full_match(path, '[a-zA-Z0-9_\-\./]*') THEN 'charset' WHEN contains(path, '//') THEN 'double_slash'
                WHEN path IN ('', '/') THEN 'empty' END AS problem
    FROM p
    """,
)
def fun_1(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages").select("page_id", "url")
    return text.normalise_endpoints(pages, "url").drop("url")


# Names of many shapes, valid and not, from the parts.
view(
    "v_names",
    """
    SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN p_name WHEN 1 THEN ' ' || p_brand WHEN 2 THEN p_type || ' '
        WHEN 3 THEN replace(p_name, ' ', '-') WHEN 4 THEN replace(p_name, ' ', '_') || '.v' || p_size WHEN 5 THEN p_size || '-' || lower(p_type)
        WHEN 6 THEN 'quay.io/team/' || replace(p_name, ' ', '-') || ':' || p_size WHEN 7 THEN 'id1.dkr.ecr.eu-west-1.amazonaws.com/' || lower(p_type)
        WHEN 8 THEN p_brand || '=x' WHEN 9 THEN replace(p_name, ' ', '--') || '@sha256:' || md5(p_name) WHEN 10 THEN '-' || lower(p_type)
        ELSE 'localhost:5000/' || replace(p_name, ' ', '/') END AS name FROM part
    """,
)


def names(spark, sf_dir):
    key, name, size, low = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string"), F.lower("p_type")
    swap = lambda to: F.replace(name, F.lit(" "), F.lit(to))
    shapes = [
        name,
        F.concat(F.lit(" "), "p_brand"),
        F.concat("p_type", F.lit(" ")),
        swap("-"),
        F.concat(swap("_"), F.lit(".v"), size),
        F.concat(size, F.lit("-"), low),
        F.concat(F.lit("quay.io/team/"), swap("-"), F.lit(":"), size),
        F.concat(F.lit("id1.dkr.ecr.eu-west-1.amazonaws.com/"), low),
        F.concat("p_brand", F.lit("=x")),
        F.concat(swap("--"), F.lit("@sha256:"), F.md5(name)),
        F.concat(F.lit("-"), low),
        F.concat(F.lit("localhost:5000/"), swap("/")),
    ]
    chosen = shapes[-1]
    for i, shape in enumerate(shapes[:-1]):
        chosen = F.when(key % 12 == i, shape).otherwise(chosen)
    return views.table(spark, sf_dir, "part").select("p_partkey", chosen.alias("name"))


IMAGE_SQL = (
    "^([a-z0-9]+([-]+[a-z0-9]+)*(\\.[a-z0-9]+([-]+[a-z0-9]+)*)*(:[0-9]+)?/)?"
    "[a-z0-9]+(([._]|__|-*)[a-z0-9]+)*(/[a-z0-9]+(([._]|__|-*)[a-z0-9]+)*)*(:[a-zA-Z0-9_][a-zA-Z0-9_.-]{0,127})?"
    "(@[A-Za-z][A-Za-z0-9]*([-_+.][A-Za-z][A-Za-z0-9]*)*:[0-9A-Fa-f]{32,})?$"
)


@query(
    "fun_2",
    f"""
    SELECT p_partkey, name, ltrim(name) <> name AS leading_space, rtrim(name) <> name AS trailing_space,
      regexp_full_match(name, '[a-zA-Z0-9._-]+') AS alnum_dash_dot_underscore, regexp_full_match(name, '[a-zA-Z0-9_-]+') AS alnum_dash_underscore,
      regexp_full_match(name, '[a-zA-Z0-9_.]+') AS alnum_dot_underscore, regexp_full_match(name, '[a-zA-Z0-9-]+') AS alnum_dash,
      regexp_full_match(name, '[a-z](|[-a-z0-9]*[a-z0-9])') AS dns1035, regexp_full_match(name, '[a-z0-9](|[-a-z0-9]*[a-z0-9])') AS dns1123,
      regexp_full_match(name, '[ a-zA-Z0-9_.:/+@-]+') AS tag,
      regexp_matches(name, '^[a-zA-Z0-9][a-zA-Z0-9_-]*[.]dkr[.]ecr(-fips)?[.][a-zA-Z0-9][a-zA-Z0-9_-]*[.]amazonaws[.]com') AS registry_url,
      regexp_matches(name, '{IMAGE_SQL}') AS image
    FROM v_names
    """,
    "v_names",
)
def fun_2(spark, sf_dir):
    return text.validate_names(names(spark, sf_dir), "name")


@query(
    "fun_3",
    """
    SELECT o_orderkey, repeat('*', length(o_orderpriority) - least(4, length(o_orderpriority) // 2))
             || right(o_orderpriority, least(4, length(o_orderpriority) // 2)) AS masked,
      CASE WHEN length(o_orderpriority) > 7 THEN left(o_orderpriority, 3) || ' ...' ELSE o_orderpriority END AS short,
      CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576)
           WHEN b < 1099511627776 THEN printf('%.1f GiB', b / 1073741824) ELSE printf('%.1f TiB', b / 1099511627776) END AS bytes,
      '$' || printf('%.2f', o_totalprice) AS dollars,
      CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || (s % 60) || 's' WHEN s < 172800 THEN (s // 3600) || 'h' || (s % 3600 // 60) || 'm'
           ELSE (s // 86400) || 'd' || (s % 86400 // 3600) || 'h' END AS took,
      epoch_ms(o_orderdate) AS millis, o_orderdate AS at_time, CASE WHEN starts_with(o_orderpriority, '1-') THEN o_orderpriority ELSE '1-' || o_orderpriority END AS prefixed,
      string_split(o_orderpriority, '-')[-1] AS last_part
    FROM (SELECT *, o_orderkey * o_orderkey * 53 AS b, o_orderkey * 37 % 400000 AS s FROM
          (SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate FROM orders))
    """,
)
def fun_3(spark, sf_dir):
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.mask(priority, 4).alias("masked"),
        text.truncate(priority, 7).alias("short"),
        text.byte_size(key * key * 53).alias("bytes"),
        text.dollars(F.col("o_totalprice")).alias("dollars"),
        text.duration_text(key * 37 % 400000).alias("took"),
        text.time_to_millis(F.col("o_orderdate")).alias("millis"),
        text.millis_to_time(text.time_to_millis(F.col("o_orderdate"))).alias("at_time"),
        text.ensure_prefix(priority, "1-").alias("prefixed"),
        text.last_split(priority, "-").alias("last_part"),
    )


@query(
    "fun_3_prefix",
    """
    SELECT host, list_max(list_filter(list_transform(range(0, length(a) + 1), lambda n: CASE WHEN left(a, n) = left(b, n) THEN left(a, n) END),
                                      lambda x: x IS NOT NULL)) AS prefix
    FROM (SELECT split_part(url, '/', 3) AS host, min(url) AS a, max(url) AS b FROM pages GROUP BY 1)
    """,
)
def fun_3_prefix(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages").select("url", F.split("url", "/")[2].alias("host"))
    return text.longest_common_prefix(pages, "url", ("host",))


@query(
    "fun_4",
    """
    SELECT p_partkey, ['m', 'c', 'inf', 'u-6tb', 'x2g'][(p_partkey % 5 + 1)::INTEGER] AS family, (p_size % 7 + 1)::INTEGER AS generation,
           ['', 'a', 'd,g', 'd,n', 'n'][(p_size % 5 + 1)::INTEGER] AS capabilities, p_brand AS size
    FROM part WHERE p_partkey % 6 <> 0
    UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 6 = 0
    """,
)
def fun_4(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda options, by: F.get(F.array(*[F.lit(o) for o in options]), (by % len(options)).cast("int"))
    generation = (size % 7 + 1).cast("string")
    letters = pick(["", "a", "gd", "dn", "nn"], size)
    name = F.concat(pick(["m", "c", "inf", "u-6tb", "x2g"], key), generation, letters, F.lit("."), "p_brand")
    bad = F.replace(name, F.lit("."), F.lit("-"))
    rows = views.table(spark, sf_dir, "part").select(
        "p_partkey", F.when(key % 6 == 0, bad).otherwise(name).alias("instance_type")
    )
    parsed = text.parse_instance_type(rows).drop("instance_type")
    return parsed.withColumn("capabilities", F.array_join("capabilities", ","))


@query(
    "fun_5",
    """
    WITH s AS (SELECT 'api-' || (o_custkey % 60)::VARCHAR AS api_name, o_orderkey AS version, sha256('r' || (o_custkey % 60 % 7) || '|' || (o_orderkey % 3)) AS pod_id,
                      o_orderstatus, o_orderpriority FROM orders),
    h AS (SELECT *, left(sha256(concat_ws('|', pod_id, o_orderstatus, o_orderpriority)), 32) AS spec_id FROM s),
    l AS (SELECT *, lag(pod_id) OVER w AS p, lag(spec_id) OVER w AS q FROM h WINDOW w AS (PARTITION BY api_name ORDER BY version))
    SELECT api_name, version, pod_id, spec_id, CASE WHEN q IS NULL THEN 'created' WHEN q = spec_id THEN 'none' WHEN p = pod_id THEN 'spec' ELSE 'pod' END AS change
    FROM l
    """,
)
def fun_5(spark, sf_dir):
    api = F.col("o_custkey") % 60
    specs = views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("api-"), api.cast("string")).alias("api_name"),
        F.col("o_orderkey").alias("version"),
        F.concat(F.lit("r"), (api % 7).cast("string")).alias("resource"),
        (F.col("o_orderkey") % 3).alias("pod"),
        F.col("o_orderstatus").alias("apis"),
        F.col("o_orderpriority").alias("networking"),
    )
    return identity.spec_identity(specs, F.floor(F.col("version") / 5000))


# ---- records checked by rules

RULES = [
    Field("name", required=True, allow_empty=False, pattern="^[a-z][a-z0-9-]*$", max_length=12, invalid_prefixes=["b-"]),
    Field("replicas", "int32", ge=0, lt=5),
    Field("ratio", "float", gt=0, le=1, allow_null=True),
    Field("window", "duration", ge=10, multiple_of=10),
    Field("mode", allowed=["O", "F"], disallowed=["F"]),
    Field("tags", "list", min_length=1, item=Field("", "string", suffix="!")),
    Field("pod", "struct", required=True, fields=[Field("port", "int", required=True, gt=1000)]),
    Field(
        "strategy",
        "struct",
        tag="type",
        variants={"rolling": [Field("surge", "int", ge=1)], "recreate": []},
    ),
]


def records(spark, sf_dir):
    """A JSON record per order, with every kind of flaw somewhere."""
    key = F.col("o_orderkey")
    number = lambda column: column.cast("string")
    quoted = lambda column: F.concat(F.lit('"'), column, F.lit('"'))
    parts = {
        "name": F.when(key % 31 != 0, quoted(F.concat(F.lower("o_orderstatus"), F.lit("-"), number(key * 911 % 100000000)))),
        "replicas": F.when(key % 4 == 0, number(key % 9 - 1)).when(key % 4 == 1, F.lit('"3"')).when(key % 4 == 2, F.lit("2.5")),
        "ratio": F.when(key % 3 == 0, F.lit("null")).when(key % 3 == 1, F.concat(number(key % 3), F.lit("."), number(key % 7))).otherwise(F.lit("0")),
        "window": F.when(key % 5 == 0, quoted(F.concat(number(key % 40), F.lit("s")))).when(key % 5 == 1, quoted(F.lit("1m30s"))).when(key % 5 == 2, quoted(F.lit("soon"))),
        "mode": quoted(F.col("o_orderstatus")),
        "tags": F.when(key % 6 == 0, F.lit("[]")).when(key % 6 == 1, F.lit('["a!", "b", 3]')).when(key % 6 == 2, F.lit('["x!"]')),
        "pod": F.when(key % 8 == 0, F.lit("{}")).when(key % 8 == 1, F.lit('"p"')).when(key % 8 != 2, F.concat(F.lit('{"port": '), number(key % 3000), F.lit(', "x": 1}'))),
        "strategy": F.when(key % 7 == 0, F.lit('{"type": "rolling", "surge": 0}')).when(key % 7 == 1, F.lit('{"type": "other"}')).when(key % 7 == 2, F.lit('{"type": "recreate", "surge": 1}')),
        "zone": F.when(key % 10 == 0, F.lit("1")),
    }
    pairs = [F.when(value.isNotNull(), F.concat(F.lit(f'"{name}": '), value)) for name, value in parts.items()]
    json_text = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    orders = spread(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))
    return orders.select("o_orderkey", F.parse_json(json_text).alias("record"))


@query(
    "fun_6",
    """
    WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS st, lower(o_orderstatus) || '-' || (o_orderkey * 911 % 100000000)::VARCHAR AS nm FROM orders),
    v AS (SELECT k, unnest(list_filter([
      CASE WHEN k % 31 = 0 THEN {'path': 'name', 'rule': 'required'} END,
      CASE WHEN k % 31 <> 0 AND length(nm) > 12 THEN {'path': 'name', 'rule': 'max_length'} END,
      CASE WHEN k % 4 IN (1, 2) THEN {'path': 'replicas', 'rule': 'type'} END,
      CASE WHEN k % 4 = 0 AND k % 9 - 1 < 0 THEN {'path': 'replicas', 'rule': 'ge'} END,
      CASE WHEN k % 4 = 0 AND k % 9 - 1 >= 5 THEN {'path': 'replicas', 'rule': 'lt'} END,
      CASE WHEN k % 3 = 2 THEN {'path': 'ratio', 'rule': 'gt'} END,
      CASE WHEN k % 3 = 1 AND k % 7 > 0 THEN {'path': 'ratio', 'rule': 'le'} END,
      CASE WHEN k % 5 = 2 THEN {'path': 'window', 'rule': 'duration'} END,
      CASE WHEN k % 5 = 0 AND k % 40 < 10 THEN {'path': 'window', 'rule': 'ge'} END,
      CASE WHEN k % 5 = 0 AND k % 40 % 10 <> 0 THEN {'path': 'window', 'rule': 'multiple_of'} END,
      CASE WHEN st NOT IN ('O', 'F') THEN {'path': 'mode', 'rule': 'allowed'} END,
      CASE WHEN st = 'F' THEN {'path': 'mode', 'rule': 'disallowed'} END,
      CASE WHEN k % 6 = 0 THEN {'path': 'tags', 'rule': 'min_length'} END,
      CASE WHEN k % 6 = 1 THEN {'path': 'tags[1]', 'rule': 'suffix'} END,
      CASE WHEN k % 6 = 1 THEN {'path': 'tags[2]', 'rule': 'type'} END,
      CASE WHEN k % 8 = 2 THEN {'path': 'pod', 'rule': 'required'} END,
      CASE WHEN k % 8 = 1 THEN {'path': 'pod', 'rule': 'type'} END,
      CASE WHEN k % 8 = 0 THEN {'path': 'pod.port', 'rule': 'required'} END,
      CASE WHEN k % 8 > 2 AND k % 3000 <= 1000 THEN {'path': 'pod.port', 'rule': 'gt'} END,
      CASE WHEN k % 8 > 2 THEN {'path': 'pod.x', 'rule': 'unknown'} END,
      CASE WHEN k % 7 = 0 THEN {'path': 'strategy.surge', 'rule': 'ge'} END,
      CASE WHEN k % 7 = 1 THEN {'path': 'strategy.type', 'rule': 'allowed'} END,
      CASE WHEN k % 7 = 2 THEN {'path': 'strategy.surge', 'rule': 'unknown'} END,
      CASE WHEN k % 10 = 0 THEN {'path': 'zone', 'rule': 'unknown'} END], lambda x: x IS NOT NULL)) AS e FROM o)
    SELECT k AS o_orderkey, e.path AS path, e.rule AS rule FROM v
    """,
)
def fun_6(spark, sf_dir):
    checked = rules.check_records(records(spark, sf_dir), RULES)
    return rules.violation_rows(checked, "o_orderkey")


@query(
    "fun_7",
    """
    WITH a AS (SELECT s_suppkey AS k, (s_suppkey % 5 - 1)::INTEGER AS mn, (s_suppkey % 4)::INTEGER AS mx,
                 CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 6)::INTEGER END AS ini, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 30 / 2 END AS tgt FROM supplier),
    r AS (SELECT *, coalesce(ini, mn) AS i, coalesce(tgt, 4) AS t FROM a),
    v AS (SELECT k, t, unnest(list_concat([{'path': '', 'rule': 'ok'}], list_filter([
      CASE WHEN mn < 0 THEN {'path': 'min_replicas', 'rule': 'ge'} END, CASE WHEN mx <= 0 THEN {'path': 'max_replicas', 'rule': 'gt'} END,
      CASE WHEN tgt <= 0 THEN {'path': 'target_in_flight', 'rule': 'gt'} END,
      CASE WHEN k % 7 < 10 AND (k % 7) * 4 < 10 THEN {'path': 'window', 'rule': 'ge'} END,
      CASE WHEN (k % 7) * 4 % 10 <> 0 THEN {'path': 'window', 'rule': 'multiple_of'} END,
      CASE WHEN t > 10 THEN {'path': 'target_in_flight', 'rule': 'target_over_limit'} END,
      CASE WHEN mn > mx THEN {'path': 'min_replicas', 'rule': 'min_over_max'} END, CASE WHEN i > mx THEN {'path': 'init_replicas', 'rule': 'init_over_max'} END,
      CASE WHEN i < mn THEN {'path': 'init_replicas', 'rule': 'init_under_min'} END], lambda x: x IS NOT NULL))) AS e FROM r)
    SELECT k AS s_suppkey, t AS target_in_flight, 300.0::DOUBLE AS down_s, e.path AS path, e.rule AS rule FROM v
    """,
)
def fun_7(spark, sf_dir):
    key = F.col("s_suppkey")
    record = F.to_json(
        F.struct(
            (key % 5 - 1).alias("min_replicas"),
            (key % 4).alias("max_replicas"),
            F.when(key % 3 == 0, key % 6).alias("init_replicas"),
            F.when(key % 2 == 0, key % 30 / 2).alias("target_in_flight"),
            F.concat(((key % 7) * 4).cast("string"), F.lit("s")).alias("window"),
        )
    )
    specs = views.table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.parse_json(record).alias("record"),
        F.lit("RealtimeAPI").alias("kind"),
        F.lit(4).alias("max_concurrency"),
        F.lit(6).alias("max_queue_length"),
    )
    checked = presets.check_autoscaling(specs)
    ok = F.array(F.struct(F.lit("").alias("path"), F.lit("ok").alias("rule")))
    checked = checked.withColumn("down_s", F.col("downscale_stabilization_s"))
    checked = checked.withColumn("violations", F.concat(ok, "violations"))
    return rules.violation_rows(checked, "s_suppkey", "target_in_flight", "down_s")


@query(
    "fun_8",
    """
    WITH v AS (SELECT o_orderkey AS k, unnest(list_filter([
      CASE WHEN o_orderkey % 3 = 0 THEN {'path': 'workers', 'rule': 'ge'} END,
      CASE WHEN o_orderkey % 5 = 0 THEN {'path': 'timeout', 'rule': 'ge'} END,
      CASE WHEN o_orderkey % 4 = 0 THEN {'path': 'sqs_dead_letter_queue.arn', 'rule': 'empty'} END,
      CASE WHEN o_orderkey % 4 = 0 THEN {'path': 'sqs_dead_letter_queue.max_receive_count', 'rule': 'ge'} END,
      CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 7 = 0 THEN {'path': 'item_list.items', 'rule': 'min_length'} END,
      CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 11 = 0 THEN {'path': 'item_list.batch_size', 'rule': 'ge'} END,
      CASE WHEN o_orderkey % 3 <> 1 AND o_orderkey % 8 = 1 THEN {'path': 'file_path_lister.s3_paths[0]', 'rule': 'pattern'} END,
      CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 3 = 1 THEN {'path': '', 'rule': 'no_input'} END,
      CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 1 THEN {'path': '', 'rule': 'conflicting_inputs'} END,
      CASE WHEN o_orderkey % 3 <> 1 AND o_orderkey % 13 = 0 THEN {'path': '', 'rule': 'no_files'} END], lambda x: x IS NOT NULL)) AS e FROM orders)
    SELECT k AS o_orderkey, e.path AS path, e.rule AS rule FROM v
    """,
)
def fun_8(spark, sf_dir):
    key = F.col("o_orderkey")
    empty = F.array().cast("array<string>")
    submission = F.to_json(
        F.struct(
            (key % 3).alias("workers"),
            F.when(key % 5 == 0, 0).alias("timeout"),
            F.when(key % 4 == 0, F.struct(F.lit("").alias("arn"), F.lit(0).alias("max_receive_count"))).alias(
                "sqs_dead_letter_queue"
            ),
            F.when(
                key % 2 == 0,
                F.struct(
                    F.when(key % 7 == 0, empty).otherwise(F.array("o_orderstatus", "o_orderpriority")).alias("items"),
                    (key % 11).alias("batch_size"),
                ),
            ).alias("item_list"),
            F.when(
                key % 3 != 1,
                F.struct(
                    F.array(F.when(key % 8 == 1, "bucket/x").otherwise("s3://bucket/x")).alias("s3_paths"),
                    F.lit(3).alias("batch_size"),
                ),
            ).alias("file_path_lister"),
        )
    )
    orders = spread(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))
    rows = orders.select("o_orderkey", F.parse_json(submission).alias("record"), (key % 13).alias("n_files"))
    return rules.violation_rows(presets.check_submission(rows, n_files="n_files"), "o_orderkey")


# ---- price lists


def offer_documents(spark, sf_dir):
    """A small price list per part: an instance type, its volumes and services."""
    key, price = F.col("p_partkey"), F.col("p_retailprice")
    region = F.concat(F.lit("region-"), key.cast("string"))

    def product(sku, family, **attributes):
        entries = [F.lit(x) if isinstance(x, str) else x for pair in attributes.items() for x in pair]
        return F.struct(
            F.lit(sku).alias("k"),
            F.struct(
                F.lit(sku).alias("sku"), F.lit(family).alias("productFamily"), F.create_map(*entries).alias("attributes")
            ).alias("v"),
        )

    balancer = "EU-LoadBalancerUsage"
    products = [
        product("i1", "Compute Instance", instanceType=F.concat(F.lit("m5."), "p_brand"), servicecode="AmazonEC2",
                capacitystatus="Used", operation="RunInstances", tenancy="Shared", operatingSystem="Linux",
                vcpu=F.col("p_size").cast("string"), memory=F.concat(F.col("p_size").cast("string"), F.lit(".5 GiB"))),
        product("i2", "Compute Instance", instanceType="m5.win", servicecode="AmazonEC2", capacitystatus="Used",
                operation="RunInstances", tenancy="Shared", operatingSystem="Windows", vcpu="2", memory="8 GiB"),
        product("g3", "Storage", volumeApiName="gp3"),
        product("g3i", "System Operation", volumeApiName="gp3", group="EBS IOPS", provisioned="Yes"),
        product("g3t", "Provisioned Throughput", volumeApiName="gp3", group="EBS Throughput", provisioned="Yes"),
        product("o1", "Storage", volumeApiName="io1"),
        product("o1i", "System Operation", volumeApiName="io1", group="EBS IOPS", provisioned="Yes"),
        product("std", "Storage", volumeApiName="standard"),
        product("n1", "Load Balancer-Network", group="ELB:Balancer", operation="LoadBalancing:Network", usagetype=balancer),
        product("e1", "Load Balancer", group="ELB:Balancer", operation="LoadBalancing", usagetype=balancer),
        product("t1", "NAT Gateway", group="NGW:NatGateway", operation="NatGateway", usagetype="EU-NatGateway-Hours"),
        product("t2", "NAT Gateway", group="NGW:NatGateway", operation="NatGateway", usagetype="EU-NatGateway-Bytes"),
        product("k1", "Compute", servicecode="AmazonEKS", operation="CreateOperation", usagetype="EU-AmazonEKS-Hours:perCluster"),
    ]
    skus = ["i1", "i2", "g3", "g3i", "g3t", "o1", "o1i", "std", "n1", "e1", "t1", "t2", "k1"]

    def term(i, sku):
        usd = F.create_map(F.lit("USD"), (price + i).cast("string"))
        dimension = F.create_map(F.lit("d"), F.struct(usd.alias("pricePerUnit")))
        return F.struct(F.lit(sku), F.create_map(F.lit("t"), F.struct(dimension.alias("priceDimensions"))))

    document = F.struct(
        F.map_from_entries(F.array(*products)).alias("products"),
        F.struct(F.map_from_entries(F.array(*[term(i, s) for i, s in enumerate(skus)])).alias("OnDemand")).alias("terms"),
    )
    parts = spread(views.table(spark, sf_dir, "part"))
    return parts.select(region.alias("region"), F.to_json(document).alias("offer"))


@query(
    "src_10",
    """
    WITH p AS (SELECT 'region-' || p_partkey AS region, p_retailprice AS r, p_brand, p_size FROM part)
    SELECT region, 'instance' AS kind, 'm5.' || p_brand AS name, r AS price, (p_size * 1024 + 512)::BIGINT AS mem_mi, NULL::DOUBLE AS price_iops, NULL::DOUBLE AS price_throughput FROM p
    UNION ALL SELECT region, 'volume', 'gp3', r + 2, NULL, r + 3, (r + 4) / 1000 FROM p
    UNION ALL SELECT region, 'volume', 'io1', r + 5, NULL, r + 6, 0 FROM p
    UNION ALL SELECT region, 'service', 'nlb', r + 8, NULL, NULL, NULL FROM p
    UNION ALL SELECT region, 'service', 'elb', r + 9, NULL, NULL, NULL FROM p
    UNION ALL SELECT region, 'service', 'nat', r + 10, NULL, NULL, NULL FROM p
    UNION ALL SELECT region, 'service', 'eks', r + 12, NULL, NULL, NULL FROM p
    """,
)
def src_10(spark, sf_dir):
    products = materialise(offers.priced_products(offer_documents(spark, sf_dir)), "products")
    instances = offers.instance_prices(products).select(
        "region", F.lit("instance").alias("kind"), F.col("instance_type").alias("name"), "price", "mem_mi"
    )
    volumes = offers.volume_prices(products).select(
        "region",
        F.lit("volume").alias("kind"),
        F.col("volume_type").alias("name"),
        F.col("price_gb").alias("price"),
        "price_iops",
        "price_throughput",
    )
    services = offers.unit_prices(products).select(
        "region", F.lit("service").alias("kind"), F.col("service").alias("name"), "price"
    )
    return instances.unionByName(volumes, allowMissingColumns=True).unionByName(services, allowMissingColumns=True)


# ---- logs


def parsed_logs(spark, sf_dir):
    return logs.read_logs(views.log_lines(spark, sf_dir))


@query(
    "src_11",
    "SELECT conv_id, turn, ts FROM v_log_rows",
    "v_log_rows",
)
def src_11(spark, sf_dir):
    return parsed_logs(spark, sf_dir).select("conv_id", "turn", "ts")


@query(
    "src_11_long",
    """
    SELECT doc_id, bytes, bytes > 8000 AS too_long, count(*) FILTER (bytes > 8000) OVER ()::BIGINT AS skipped
    FROM (SELECT doc_id, strlen(to_json({'doc_id': doc_id, 'log': text}))::BIGINT AS bytes FROM documents)
    """,
)
def src_11_long(spark, sf_dir):
    """Over-long lines are flagged and counted, not parsed: documents as log lines."""
    docs = views.table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.to_json(F.struct("doc_id", F.col("text").alias("log"))).alias("line"))
    read = logs.read_logs(lines, max_bytes=8000)
    skipped = logs.skipped_lines(read).select("skipped").scalar()
    size = F.octet_length("line").cast("long").alias("bytes")
    return read.select("doc_id", size, "too_long", skipped.alias("skipped"))


@query(
    "log_1",
    "SELECT conv_id, turn, coalesce(msg, message) AS message, levelname AS level FROM v_log_rows",
    "v_log_rows",
)
def log_1(spark, sf_dir):
    return logs.normalise_logs(parsed_logs(spark, sf_dir)).select("conv_id", "turn", "message", "level")


@query(
    "log_2",
    """
    SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'meta' ELSE api_name END AS api_name,
           CASE WHEN turn % 3 = 0 THEN 'pod-' || job_id ELSE job_id END AS job_id FROM v_log_rows
    """,
    "v_log_rows",
)
def log_2(spark, sf_dir):
    lines = views.log_lines(spark, sf_dir)
    bare = F.replace("line", F.lit('"labels":'), F.lit('"other":'))
    lines = lines.withColumn("line", F.when(F.col("turn") % 3 == 0, bare).otherwise(F.col("line")))
    metadata = F.struct(
        F.create_map(
            F.lit("apiName"), F.lit("meta"), F.lit("jobID"), F.concat(F.lit("pod-"), F.col("conv_id").cast("string"))
        ).alias("labels")
    )
    labelled = logs.label_logs(logs.read_logs(lines.withColumn("kubernetes", metadata)), metadata="kubernetes")
    label = lambda name: F.try_element_at("labels", F.lit(name))
    return labelled.select("conv_id", "turn", label("apiName").alias("api_name"), label("jobID").alias("job_id"))


@query(
    "srt_1",
    "SELECT conv_id, turn, ts, coalesce(msg, message) AS message FROM v_log_rows WHERE api_name = 'assistant' ORDER BY ts, conv_id, turn LIMIT 100",
    "v_log_rows",
)
def srt_1(spark, sf_dir):
    ready = logs.label_logs(logs.normalise_logs(parsed_logs(spark, sf_dir)))
    found = logs.query_logs(ready, api_name="assistant", limit=100, tiebreak=("conv_id", "turn"))
    return found.select("conv_id", "turn", "ts", "message")


@query(
    "srt_2",
    """
    SELECT 'range' AS mode, conv_id, turn, ts FROM v_log_rows WHERE job_id = '17' AND ts >= TIMESTAMP '2024-01-01 00:17:01' AND ts <= TIMESTAMP '2024-01-01 00:17:03'
    UNION ALL
    SELECT 'recent', conv_id, turn, ts FROM v_log_rows WHERE job_id = '40' AND ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts <= TIMESTAMP '2024-01-01 01:00:00'
    """,
    "v_log_rows",
)
def srt_2(spark, sf_dir):
    ready = logs.label_logs(parsed_logs(spark, sf_dir))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    one = logs.query_logs_range(ready, "17", at("2024-01-01 00:17:01"), at("2024-01-01 00:17:03"))
    two = logs.query_logs_range(ready, "40", now=at("2024-01-01 01:00:00"))
    return (
        one.withColumn("mode", F.lit("range"))
        .unionByName(two.withColumn("mode", F.lit("recent")))
        .select("mode", "conv_id", "turn", "ts")
    )


# ---- sets


def labelled_ids(spark, sf_dir):
    return views.table(spark, sf_dir, "labels").select("doc_id")


def long_ids(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").filter("n_chars > 1000").select("doc_id")


LONG = "SELECT doc_id FROM documents WHERE n_chars > 1000"


@query("set_1", f"SELECT doc_id FROM labels UNION {LONG}")
def set_1(spark, sf_dir):
    return sets.merge(labelled_ids(spark, sf_dir), long_ids(spark, sf_dir))


@query("set_2", f"SELECT doc_id FROM labels EXCEPT {LONG}")
def set_2(spark, sf_dir):
    return sets.difference(labelled_ids(spark, sf_dir), long_ids(spark, sf_dir))


@query("set_3", f"SELECT doc_id FROM labels INTERSECT {LONG}")
def set_3(spark, sf_dir):
    return sets.intersection(labelled_ids(spark, sf_dir), long_ids(spark, sf_dir))


@query("set_4", f"(SELECT doc_id FROM labels EXCEPT {LONG}) UNION ({LONG} EXCEPT SELECT doc_id FROM labels)")
def set_4(spark, sf_dir):
    return sets.symmetric_difference(labelled_ids(spark, sf_dir), long_ids(spark, sf_dir))


@query(
    "set_5",
    """
    WITH l AS (SELECT o_custkey AS key, list(DISTINCT o_orderpriority) AS s FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
    r AS (SELECT o_custkey AS key, list(DISTINCT o_orderpriority) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    j AS (SELECT key, coalesce(l.s, []) AS a, coalesce(r.s, []) AS b FROM l FULL JOIN r USING (key))
    SELECT key, list_sort(a) = list_sort(b) AS equal, list_has_all(b, a) AS subset, list_has_all(a, b) AS superset,
           list_has_any(a, b) AS any_shared, len(list_filter(a, lambda x: starts_with(x, '1'))) > 0 AS has_prefix FROM j
    """,
)
def set_5(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    side = lambda status: orders.filter(F.col("o_orderstatus") == status).select(
        F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("element")
    )
    return sets.compare_keyed(side("O"), side("F"), "key", "element", "1")


@query(
    "set_6",
    r"""
    WITH d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS k FROM documents)
    SELECT 'first' AS kind, min(doc_id) AS doc_id, NULL::BIGINT AS n, NULL::BOOLEAN AS matches FROM d GROUP BY k
    UNION ALL SELECT 'duplicates', min(doc_id), count(*), NULL FROM d GROUP BY k HAVING count(*) > 1
    UNION ALL
    SELECT 'multiset', key, NULL, max(abs(n)) = 0 FROM (SELECT key, e, sum(n) AS n FROM (
        SELECT o_custkey AS key, o_orderpriority AS e, 1 AS n FROM orders WHERE o_orderstatus = 'O'
        UNION ALL SELECT o_custkey, o_orderpriority, -1 FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2) GROUP BY 2
    """,
)
def set_6(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    first = sets.distinct_first(docs, "text", "doc_id", r"\s+").select(F.lit("first").alias("kind"), "doc_id")
    again = sets.duplicate_values(docs, "text", "doc_id", r"\s+").withColumn("kind", F.lit("duplicates"))
    orders = views.table(spark, sf_dir, "orders")
    side = lambda status: orders.filter(F.col("o_orderstatus") == status).select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("element")
    )
    matches = sets.multiset_match(side("O"), side("F"), ["doc_id"], "element").withColumn("kind", F.lit("multiset"))
    return first.unionByName(again, allowMissingColumns=True).unionByName(matches, allowMissingColumns=True)
