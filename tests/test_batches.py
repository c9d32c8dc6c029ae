"""Batching, packing, numbering, intake and execution: edge cases and properties."""

import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tideline.operators import batching, execute, ordering, logs
from tideline.session import fresh_path
from tideline.sources import items, listing, sinks


@pytest.mark.parametrize("count", [0, 1, 7, 8, 15])
def test_assign_batches_partitions_the_input(spark, count):
    rows = spark.range(count).withColumnRenamed("id", "pos")
    placed = batching.assign_batches(rows, 7)
    got = {r["batch_id"]: r["items"] for r in batching.collect_batches(placed, "pos").collect()}
    assert got == {i: list(range(i * 7, min(count, i * 7 + 7))) for i in range(-(-count // 7))}
    totals = batching.batch_totals(rows, 7).collect()[0]
    assert (totals["n_items"], totals["n_batches"]) == (count, -(-count // 7))


def test_batches_straddle_files(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(4)], "file string, i int")
    placed = ordering.numbered_by_range(rows.withColumn("name", F.concat("file", F.col("i").cast("string"))), ["file", "i"])
    got = batching.collect_batches(batching.assign_batches(placed, 3), "name").orderBy("batch_id").collect()
    assert [r["items"] for r in got] == [["a0", "a1", "a2"], ["a3", "a4", "b0"], ["b1", "b2", "b3"]]


def test_numbered_splits_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot", i) for i in range(2000)] + [(f"k{i % 40}", i) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, x long")
    want = {}
    for key, x in sorted(rows):
        want[(key, x)] = sum(1 for k in want if k[0] == key)
    by_bucket = ordering.numbered(df, ["key"], ["x"], F.floor(F.col("x") / 100))
    by_range = ordering.numbered_by_range(df, ["x"], ["key"], partitions=5)
    for placed in (by_bucket, by_range):
        assert {(r["key"], r["x"]): r["pos"] for r in placed.collect()} == want


def fold(sizes, max_bytes, max_count):
    groups, total, n, group = [], 0, 0, 0
    for size in sizes:
        if n and (total + size > max_bytes or n == max_count):
            group, total, n = group + 1, 0, 0
        total, n = total + size, n + 1
        groups.append(group)
    return groups


@pytest.mark.parametrize("seed", range(4))
def test_pack_equals_the_fold(spark, seed):
    rng = random.Random(seed)
    jobs = {"big": 500 + seed, "small": 3, "one": 1, "edge": 64}
    sizes = {job: [rng.choice([1, 5, 20, 60, 100]) for _ in range(n)] for job, n in jobs.items()}
    rows = [(job, i, s) for job, found in sizes.items() for i, s in enumerate(found)]
    packed = batching.pack(
        spark.createDataFrame(rows, "job_id string, batch_id long, bytes long"), max_bytes=100, max_count=6, chunk=16
    )
    got = {(r["job_id"], r["batch_id"]): r["group_id"] for r in packed.collect()}
    want = {(job, i): g for job, found in sizes.items() for i, g in enumerate(fold(found, 100, 6))}
    assert got == want


def test_pack_limits(spark):
    rows = spark.createDataFrame([("j", i, s) for i, s in enumerate([100] + [1] * 11)], "job_id string, batch_id long, bytes long")
    got = [r["group_id"] for r in batching.pack(rows, max_bytes=100).orderBy("batch_id").collect()]
    assert got == [0] + [1] * 10 + [2]
    with pytest.raises(PySparkException, match="exceeds 99"):
        batching.pack(rows, max_bytes=99).collect()


def test_item_list_keeps_types_and_rejects_empty(spark):
    rows = spark.createDataFrame([(1, '[1, "1", null, {"a": [2]}, true]')], "job_id long, items string")
    assert [r["item"] for r in items.item_list(rows).orderBy("pos").collect()] == ["1", '"1"', "null", '{"a":[2]}', "true"]
    empty = spark.createDataFrame([(1, "[]")], "job_id long, items string")
    with pytest.raises(PySparkException, match="at least 1 element"):
        items.item_list(empty).collect()
    assert items.item_list(empty, on_empty="skip").count() == 0


def test_oversize_counts_bytes(spark):
    rows = spark.createDataFrame([("é" * 5,), ("<a>",)], "body string")
    checked = items.reject_oversize(rows, max_bytes=10, mode="reject").collect()
    assert [(r["bytes"], r["accepted"]) for r in checked] == [(10, True), (3, True)]
    escaped = items.reject_oversize(rows, max_bytes=10, mode="reject", escape_html=True).collect()
    assert [(r["bytes"], r["accepted"]) for r in escaped] == [(10, True), (13, False)]
    with pytest.raises(PySparkException, match="exceeds the limit of 9"):
        items.reject_oversize(rows, max_bytes=9).count()


def write_text(path, text):
    path.write_text(text)
    return str(path)


def test_json_stream(spark, tmp_path):
    text = '{"a":1}{"a":2}\n{\n "b": [1,\n 2],\n "c": "}{\\"]"\n}\n7 "x" null\n[]'
    path = write_text(tmp_path / "x.json", text)
    got = items.read_json_stream(spark, path).orderBy("item_index").collect()
    assert [json.loads(r["item"]) for r in got] == [{"a": 1}, {"a": 2}, {"b": [1, 2], "c": '}{"]'}, 7, "x", None, []]
    assert [r["item_index"] for r in got] == list(range(7))


def test_json_stream_truncated_tail(spark, tmp_path):
    path = write_text(tmp_path / "x.json", '{"a":1}\n{"a":\n2')
    got = items.read_json_stream(spark, path, on_error="flag").orderBy("item_index").collect()
    assert [r["valid"] for r in got] == [True, False]
    with pytest.raises(PySparkException, match="item 1 of"):
        items.read_json_stream(spark, path).collect()


@pytest.mark.parametrize(
    "text, valid, good",
    [
        ('{"a":1}\n{"b": [\n 2\n{"c":\n 3}\n[6]', [True, False, True, True], [{"a": 1}, {"c": 3}, [6]]),
        ('{"a":1}}\n{"d":\n4}\n[6]', [True, False, True, True], [{"a": 1}, {"d": 4}, [6]]),
    ],
)
def test_json_stream_goes_on_after_broken_values(spark, tmp_path, text, valid, good):
    path = write_text(tmp_path / "x.json", text)
    got = items.read_json_stream(spark, path, on_error="flag").orderBy("item_index").collect()
    assert [r["valid"] for r in got] == valid
    assert [json.loads(r["item"]) for r in got if r["valid"]] == good


@pytest.mark.parametrize("size", [249 * 1024, 250 * 1024, 251 * 1024, 1_200_000])
@pytest.mark.parametrize("gap", ["", "\n"])
def test_json_stream_of_large_values(spark, tmp_path, size, gap):
    path = write_text(tmp_path / "x.json", f'{{"a":{gap}"{"x" * size}"}}\n{{"b":1}}')
    got = items.read_json_stream(spark, path).orderBy("item_index").collect()
    assert [len(json.loads(r["item"]).get("a", "")) for r in got] == [size, 0] and all(r["valid"] for r in got)


def test_logs_flag_long_lines(spark):
    sizes = [32 * 1024 - 1, 32 * 1024, 32 * 1024 + 1]
    rows = [('{"time": "2024-01-01T00:00:00.000", "log": "' + "x" * (n - 46) + '"}',) for n in sizes] + [("no json",), (None,)]
    assert [len(r[0]) for r in rows[:3]] == sizes
    read = logs.read_logs(spark.createDataFrame(rows, "line string"))
    assert [r["too_long"] for r in read.collect()] == [False, False, True, False, False]
    assert tuple(logs.skipped_lines(read).first()) == (5, 1, 2)


def test_classify_has_no_label_limit(spark):
    means = spark.createDataFrame([(i, [1.0, i / 10_000]) for i in range(10_050)], "label long, mean array<double>")
    vectors = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, -1.0]), (2, None)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["class"] for r in execute.classify(vectors, means).collect()}
    assert got == {0: 10_049, 1: 0, 2: None}
    assert execute.classify(vectors, means.limit(0)).first()["class"] is None


def test_json_stream_splits_files(spark, tmp_path):
    text = "".join(json.dumps({"i": i, "t": "x" * 40}, indent=1) + "\n" for i in range(200))
    path = write_text(tmp_path / "x.json", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = items.read_json_stream(spark, path).orderBy("item_index").collect()
        lines = write_text(tmp_path / "y.json", "".join(json.dumps({"i": i}) + "\n\n" for i in range(500)))
        plain = items.read_ndjson(spark, lines).orderBy("item_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [json.loads(r["item"])["i"] for r in got] == list(range(200))
    assert [(r["item_index"], json.loads(r["item"])["i"]) for r in plain] == [(i, i) for i in range(500)]


def test_ndjson_names_the_bad_item(spark, tmp_path):
    path = write_text(tmp_path / "x.json", '{"a":1}\nnope\n')
    with pytest.raises(PySparkException, match="item 1 of"):
        items.read_ndjson(spark, path).count()


FILES = [
    "s3://bucket/dir/a.png",
    "s3://bucket/dir/b.jpg",
    "s3://bucket/dir/sub/c.png",
    "s3://bucket/other/d.png",
]


@pytest.mark.parametrize(
    "includes, excludes, want",
    [
        ([], [], [0, 1, 2, 3]),
        (["s3://bucket/dir/*.png"], [], [0]),
        (["s3://bucket/dir/**.png"], [], [0, 2]),
        (["**.png"], ["**/sub/*"], [0, 3]),
        (["**"], ["**"], []),
        (["s3://bucket/{dir,other}/?.[!j]*"], [], [0, 3]),
    ],
)
def test_globs(spark, includes, excludes, want):
    rows = spark.createDataFrame([(f,) for f in FILES], "path string")
    got = sorted(r["path"] for r in listing.filter_globs(rows, includes, excludes).collect())
    assert got == [FILES[i] for i in want]


def test_listing(spark):
    rows = spark.createDataFrame([(f,) for f in [*FILES, "s3://bucket/dir/"]], "path string")
    paths = ["s3://bucket/dir/", "s3://bucket/dir/a.png"]
    twice = listing.list_files(rows, paths).orderBy("path_index", "path").collect()
    assert [r["path"] for r in twice] == [*FILES[:3], FILES[0]]
    assert listing.list_files(rows, paths, distinct=True).count() == 3
    with pytest.raises(ValueError, match="no files match"):
        listing.dry_run(rows, ["s3://nowhere/"])
    assert [r["path"] for r in listing.list_bounded(rows, 2, FILES[0]).collect()] == FILES[1:3]
    with pytest.raises(ValueError, match="glob"):
        listing.glob_to_regex("[abc")


def test_stored_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"12345")
    found = listing.list_storage(spark, [str(tmp_path)])
    assert [r["size"] for r in found.collect()] == [5]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def fingerprints(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "k string, path string, etag string").repartition(parts)
    return dict(listing.fingerprint(df, keys=["k"]).collect())


@pytest.mark.parametrize("n", [1, 30, 9_999, 10_001])
def test_fingerprint_is_one_definition_at_every_size(spark, n):
    rows = [("a", f"p{i:05d}", f"h{i}") for i in range(n)]
    whole = fingerprints(spark, rows)
    assert whole == fingerprints(spark, rows[::-1], 7)
    for other in (rows[1:], [("a", "p00000", "x"), *rows[1:]], [("a", "q", "h0"), *rows[1:]], [*rows, rows[0]]):
        assert fingerprints(spark, other) != whole
    swapped = [("a", "p00000", "h1"), ("a", "p00001", "h0"), *rows[2:]] if n > 1 else []
    assert fingerprints(spark, swapped) != whole


def test_failures_are_isolated_and_dead_lettered(spark):
    def flaky(config):
        calls = {"n": 0}

        def handler(row):
            calls["n"] += 1
            if row["x"] % 3 == 0 or (row["x"] % 3 == 1 and calls["n"] % 2):
                raise ValueError("no")
            return {"x": row["x"] * config["k"]}

        return handler

    rows = spark.range(12).select(F.lit(1).alias("job_id"), F.col("id").alias("batch_id"), F.col("id").alias("x")).coalesce(1)
    runs = execute.run_with_dead_letters(rows, flaky, 2, {"k": 10})
    path = fresh_path(spark, "runs")
    runs.write.parquet(path)
    good, dead = execute.split_dead_letters(spark.read.parquet(path))
    assert sorted(r["batch_id"] for r in dead.collect()) == [0, 3, 6, 9]
    assert all(r["attempts"] == 2 and r["error"] == "ValueError: no" and r["result"] is None for r in dead.collect())
    assert {r["batch_id"]: json.loads(r["result"])["x"] for r in good.collect()} == {
        i: i * 10 for i in range(12) if i % 3
    }


def test_on_complete(spark):
    calls = []
    path = fresh_path(spark, "done")
    for rows in (5, 7):  # a second run neither stores nor calls again
        execute.on_complete(spark.range(rows), path, lambda df: calls.append(df.count()), expected=5)
    assert calls == [5]
    short = fresh_path(spark, "short")
    with pytest.raises(RuntimeError, match="1 batches remain"):
        execute.on_complete(spark.range(5), short, calls.append, expected=6)
    assert calls == [5]


def test_on_complete_after_a_failed_hook(spark):
    path, calls = fresh_path(spark, "done"), []

    def hook(stored):
        calls.append(stored.count())
        if len(calls) == 1:
            raise ValueError("cut off")

    with pytest.raises(ValueError):
        execute.on_complete(spark.range(4), path, hook)
    execute.on_complete(spark.range(9), path, hook)  # the stored results stand
    execute.on_complete(spark.range(9), path, hook)
    assert calls == [4, 4]


def test_sum_example(spark):
    rows = spark.createDataFrame([([1, 2, 67, -2, 43],), ([9, 0, 1, 0, 0, -1],)], "items array<long>")
    assert sorted(r["total"] for r in execute.sum_items(rows).collect()) == [9, 111]


def test_release_deletes_stages(spark):
    from tideline.session import materialise, release

    release(spark)
    stage = materialise(spark.range(5), "gone")
    (file,) = {os.path.dirname(f.removeprefix("file://")) for f in stage.inputFiles()}
    assert os.path.isdir(file) and release(spark) == 1 and not os.path.exists(file)
