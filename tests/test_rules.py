"""Record rules and text functions."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import presets, rules, text
from tideline.functions.rules import Field
from tideline.operators import cost


def check(spark, record, fields, **kw):
    df = spark.createDataFrame([(record,)], "j string").select(F.parse_json("j").alias("record"))
    found = rules.check_records(df, fields, **kw).collect()[0]["violations"]
    return [(v["path"], v["rule"]) for v in found]


NUMBERS = Field("", "list", item=Field("", "int", ge=0), max_length=2)
UNION = Field("", "struct", tag="type", variants={"x": [Field("v", "int", gt=0)], "y": [Field("w", "list", item=Field("", "int", ge=0))]})
DEEP = Field("", "struct", fields=[Field("c", "list", item=Field("", "struct", fields=[Field("d", "list", item=Field("", "int", ge=0))]))])

RULE_CASES = [
    ('{"a": [[1, -1], [2]]}', [Field("a", "list", item=NUMBERS)], [("a[0][1]", "ge")]),
    ('{"a": [[1, 2, 3], "x"]}', [Field("a", "list", item=NUMBERS)], [("a[0]", "max_length"), ("a[1]", "type")]),
    ('{"a": [{"b": [-1, 1, "z"]}]}', [Field("a", "list", item=Field("", "struct", fields=[Field("b", "list", item=Field("", "int", ge=0))]))], [("a[0].b[0]", "ge"), ("a[0].b[2]", "type")]),
    ('{"a": [{"type": "x", "v": 1}, {"type": "y", "w": [3]}]}', [Field("a", "list", item=UNION)], []),
    ('{"a": [{"type": "x", "v": 0, "q": 1}, {"type": "z"}, {"v": 1}]}', [Field("a", "list", item=UNION)], [("a[0].v", "gt"), ("a[0].q", "unknown"), ("a[1].type", "allowed"), ("a[2].type", "tag")]),
    ('{"a": [{"type": "y", "w": [0, -2]}]}', [Field("a", "list", item=UNION)], [("a[0].w[1]", "ge")]),
    ('{"a": [{"c": [{"d": [1, [2]]}, {"d": [-3]}]}]}', [Field("a", "list", item=DEEP)], [("a[0].c[0].d[1]", "type"), ("a[0].c[1].d[0]", "ge")]),
    ('{"a": null}', [Field("a", null_as_empty=True)], []),
    ('{"a": null}', [Field("a", null_as_empty=True, allow_empty=False)], [("a", "empty")]),
    ('{"a": null}', [Field("a", "list", null_as_empty=True, item=NUMBERS)], []),
    ('{"a": null}', [Field("a", "list", null_as_empty=True, min_length=1)], [("a", "min_length")]),
    ('{"a": "x"}', [Field("a")], []),
    ("{}", [Field("a", required=True)], [("a", "required")]),
    ('{"a": null}', [Field("a")], [("a", "null")]),
    ('{"a": null}', [Field("a", allow_null=True)], []),
    ('{"a": "5"}', [Field("a", "int")], [("a", "type")]),
    ('{"a": 5.5}', [Field("a", "int")], [("a", "type")]),
    ('{"a": 5}', [Field("a", "float")], []),
    ('{"a": 3000000000}', [Field("a", "int32")], [("a", "type")]),
    ('{"a": 3000000000}', [Field("a", "int")], []),
    ('{"a": 5}', [Field("a", "int", gt=5)], [("a", "gt")]),
    ('{"a": 5}', [Field("a", "int", ge=5, le=5)], []),
    ('{"a": 5}', [Field("a", "int", lt=5)], [("a", "lt")]),
    ('{"a": ""}', [Field("a", allow_empty=False)], [("a", "empty")]),
    ('{"a": "x"}', [Field("a", allowed=["y"])], [("a", "allowed")]),
    ('{"a": "x"}', [Field("a", disallowed=["x"])], [("a", "disallowed")]),
    ('{"a": "25s"}', [Field("a", "duration", ge=10, multiple_of=10)], [("a", "multiple_of")]),
    ('{"a": "1h0.5m"}', [Field("a", "duration", multiple_of=30)], []),
    ('{"a": "x", "b": 1}', [Field("a")], [("b", "unknown")]),
    ('{"a": {"b": {"c": 0}}}', [Field("a", "struct", fields=[Field("b", "struct", fields=[Field("c", "int", gt=0)])])], [("a.b.c", "gt")]),
    ('{"a": [{"b": 1}, {"b": "x", "z": 0}]}', [Field("a", "list", item=Field("", "struct", fields=[Field("b", "int")]))], [("a[1].b", "type"), ("a[1].z", "unknown")]),
    ('{"a": {"t": "x", "n": 0}}', [Field("a", "struct", tag="t", variants={"x": [Field("n", "int", gt=0)], "y": []})], [("a.n", "gt")]),
    ('{"a": {"n": 0}}', [Field("a", "struct", tag="t", variants={"x": [], "y": []})], [("a.t", "tag")]),
    ("[1]", [Field("a")], [("", "type")]),
]


@pytest.mark.parametrize("record, fields, want", RULE_CASES)
def test_rules(spark, record, fields, want):
    assert check(spark, record, fields) == want


def test_first_only(spark):
    assert len(check(spark, "{}", [Field("a", required=True), Field("b", required=True)], first_only=True)) == 1


def test_defaults(spark):
    df = spark.createDataFrame([('{"a": 7}',), ("{}",)], "j string").select(F.parse_json("j").alias("record"))
    fields = [Field("a", "int", default=1), Field("b", "int", default_field="a"), Field("w", "duration", default="60s")]
    assert [tuple(r)[1:] for r in rules.resolved(df, fields).collect()] == [(7, 7, "60s"), (1, 1, "60s")]


def test_autoscaling_preset(spark):
    df = spark.createDataFrame([("{}", "RealtimeAPI", 3, 2), ('{"target_in_flight": 6.0, "min_replicas": 101}', "RealtimeAPI", 3, 2)], "j string, kind string, max_concurrency int, max_queue_length int")
    good, bad = presets.check_autoscaling(df.withColumn("record", F.parse_json("j"))).collect()
    assert good["violations"] == [] and good["target_in_flight"] == 3.0 and good["window_s"] == 60.0
    assert [v["rule"] for v in bad["violations"]] == ["target_over_limit", "min_over_max", "init_over_max"]


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).collect()[0]["y"]


@pytest.mark.parametrize(
    "fn, value, kind, want",
    [
        (lambda c: text.mask(c, 4), "abcdefghij", "string", "******ghij"),
        (lambda c: text.mask(c, 4), "abc", "string", "**c"),
        (lambda c: text.mask(c, 4), "", "string", ""),
        (lambda c: text.truncate(c, 8), "123456789", "string", "1234 ..."),
        (lambda c: text.truncate(c, 9), "123456789", "string", "123456789"),
        (text.byte_size, 1023, "long", "1023 B"),
        (text.byte_size, 1536, "long", "1.5 KiB"),
        (text.byte_size, 5 * 2**60, "long", "5.0 EiB"),
        (text.dollars, 1.0, "double", "$1.00"),
        (text.dollars, 2.005, "double", "$2.01"),
        (lambda c: text.round_text(c, 3, 2), 1.2345, "double", "1.235"),
        (lambda c: text.round_text(c, 3, 2), 1.2, "double", "1.20"),
        (lambda c: text.round_text(c, 2), 100.0, "double", "100"),
        (text.duration_text, 59, "long", "59s"),
        (text.duration_text, 303, "long", "5m3s"),
        (text.duration_text, 172799, "long", "47h59m"),
        (text.duration_text, 187200, "long", "2d4h"),
        (text.canonical_endpoint, "a/b/", "string", "/a/b"),
        (text.canonical_endpoint, "", "string", "/"),
        (text.endpoint_problem, "/a//b", "string", "double_slash"),
        (text.endpoint_problem, "/a b", "string", "charset"),
        (text.endpoint_problem, "/", "string", "empty"),
        (text.endpoint_problem, "/a", "string", None),
        (text.without_query, "see https://a.b/c?x=1&y=2 ok", "string", "see https://a.b/c ok"),
        (lambda c: text.last_split(c, "/"), "a/b/c", "string", "c"),
    ],
)
def test_text(spark, fn, value, kind, want):
    assert one(spark, fn, value, kind) == want


@pytest.mark.parametrize(
    "name, want",
    [
        ("repo", True), ("host.io:80/a/b:tag", True), ("a/b@sha256:" + "0" * 64, True), ("A/b", False), ("a:", False),
        ("a__b/c-d", True), ("a/", False), ("-a", False),
    ],
)
def test_image_names(spark, name, want):
    assert one(spark, lambda c: c.rlike(text.IMAGE), name) is want


@pytest.mark.parametrize(
    "name, want",
    [
        ("t3.small", ("t", 3, [], "small")),
        ("inf1.xlarge", ("inf", 1, [], "xlarge")),
        ("g4dn.metal", ("g", 4, ["d", "n"], "metal")),
        ("u-6tb1.metal", ("u-6tb", 1, [], "metal")),
        ("broken", (None, None, None, None)),
    ],
)
def test_instance_types(spark, name, want):
    row = text.parse_instance_type(spark.createDataFrame([(name,)], "instance_type string")).collect()[0]
    assert (row["family"], row["generation"], row["capabilities"], row["size"]) == want


def test_spot_price(spark):
    rows = [("a", "0.5"), ("a", "x"), ("a", "0.4"), ("b", "0"), ("c", "nope")]
    got = {r[0]: r[1] for r in cost.spot_price(spark.createDataFrame(rows, "instance_type string, price string")).collect()}
    assert got == {"a": 0.4, "b": None, "c": None}


def test_pods_fit_ignores_what_is_not_asked_for(spark):
    nodes = spark.createDataFrame([(1, 4000, 16384, 0, 20)], "node_id long, cpu_m long, mem_mi long, gpu long, max_pods int")
    pods = spark.createDataFrame([(1, 1, 1000, 0, 0), (2, 1, 10, 0, 0), (3, 1, 100, 100, 1)], "pod_id long, node_id long, cpu_m long, mem_mi long, gpu long")
    assert [r["fits"] for r in cost.pods_fit(nodes, pods).orderBy("pod_id").collect()] == [3, 20, 0]
