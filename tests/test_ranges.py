"""JSON files cut into byte ranges anywhere, against reading them whole."""

import gzip
import json
import random
import tracemalloc

import pytest

from tideline.sources import items, ranges


def random_value(draw, depth=0):
    kind = draw.randint(0, 6 if depth < 3 else 3)
    if kind == 0:
        return draw.choice([None, True, -1.5, 12, 0])
    if kind < 4:
        return "".join(draw.choices('ab{}[]"\\\n é ', k=draw.randint(0, 12)))
    if kind < 6:
        return [random_value(draw, depth + 1) for _ in range(draw.randint(0, 3))]
    return {f"k{i}": random_value(draw, depth + 1) for i in range(draw.randint(0, 3))}


def random_text(draw, broken):
    parts, values = [], []
    for _ in range(draw.randint(0, 14)):
        value = random_value(draw)
        values.append(value)
        parts.append(json.dumps(value, indent=draw.choice([None, None, 0, 1, 2]), ensure_ascii=draw.random() < 0.5))
        parts.append(draw.choice(["\n", "\n", "\r\n", " ", "\n\n \n", "\t\n"]))
        if broken and draw.random() < 0.3:
            parts.append(draw.choice(["{\n", "[1,\n", "}\n", "nope\n", '"open\n', '{"a":\n[\n', "\\\n"]))
    return "".join(parts), values


def read_whole(path):
    """The values of a file of one range, without Spark."""
    profile = ranges._profile(str(path), 0, 1 << 40)
    if not profile[0]:
        return []
    return list(ranges._values(str(path), profile[1], 1 << 40, ranges.END, 0, 0, None))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    draw, folder, wanted = random.Random(11), tmp_path_factory.mktemp("json"), {}
    for i in range(36):
        text, values = random_text(draw, broken=i % 2)
        (folder / f"f{i:02d}.json").write_bytes(text.encode())
        wanted[f"f{i:02d}.json"] = None if i % 2 else values
    return folder, wanted


def test_whole_files_are_decoded_in_order(folder):
    for name, values in folder[1].items():
        if values is not None:
            got = read_whole(folder[0] / name)
            assert all(valid for _, valid in got) and [json.loads(t) for t, _ in got] == values


@pytest.mark.parametrize("size", ["40", "97", "1000"])
def test_ranges_change_nothing(spark, folder, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        rows = items.read_json_stream(spark, str(folder[0]), on_error="flag").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["item_index"])):
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["item_index"], r["item"], r["valid"]))
    for name in folder[1]:
        assert found.get(name, []) == [(i, t, v) for i, (t, v) in enumerate(read_whole(folder[0] / name))]


def test_blocks_own_the_lines_that_begin_in_them(tmp_path, monkeypatch):
    draw = random.Random(5)
    monkeypatch.setattr(ranges, "BLOCK", 7)
    path = tmp_path / "x.txt"
    for _ in range(60):
        raw = bytes(draw.choices(b"ab\n", [3, 3, 1], k=draw.randint(0, 60)))
        path.write_bytes(raw)
        cuts = sorted({0, len(raw), *(draw.randint(0, len(raw)) for _ in range(4))})
        for a, b in zip(cuts, cuts[1:]):
            begins = [i for i in range(a, b) if i == 0 or raw[i - 1 : i] == b"\n"]
            want = b"".join(raw[i : raw.find(b"\n", i) + 1 or len(raw)] for i in begins)
            got = list(ranges._blocks(str(path), a, b))
            assert b"".join(block for _, block in got) == want
            assert all(raw[at : at + len(block)] == block for at, block in got)


def test_packed_and_empty_files(spark, tmp_path):
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(b'{"a":\n1}\n' * 500))
    (tmp_path / "b.json").write_bytes(b"")
    (tmp_path / "c d.json").write_bytes(b"\n \n[\n]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
    try:
        rows = items.read_json_stream(spark, str(tmp_path)).collect()
        lines = items.read_ndjson(spark, str(tmp_path), on_error="flag").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["item_index"] for r in rows if ".gz" in r["file"]) == list(range(500))
    assert [r["item"] for r in rows if ".gz" not in r["file"]] == ["[\n]"]
    assert sorted(r["item_index"] for r in lines if ".gz" in r["file"]) == list(range(1000))


def test_the_plan_shuffles_no_text(spark, folder):
    plan = items.read_ndjson(spark, str(folder[0]), on_error="flag")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan.split("Exchange")[0]  # text appears after the last shuffle only
    assert "monotonically_increasing_id" not in plan


def test_values_of_a_range_are_read_as_a_stream(tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 1 << 16)
    path = tmp_path / "values.json"
    path.write_text("".join(f'{{\n "n": {i},\n "text": "{"x" * 40}"\n}} 17\n' for i in range(60_000)))
    tracemalloc.start()
    n = sum(valid for _, valid in ranges._values(str(path), 0, path.stat().st_size, ranges.END, 0, 0, None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 120_000 and peak < 3 << 20


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("later", [None, -1, 0, 1, 3])
def test_groups_begin_where_the_depth_never_falls_again(tmp_path, monkeypatch, seed, later):
    monkeypatch.setattr(ranges, "BLOCK", 64)
    draw = random.Random(seed)
    lines = [draw.choice(["{", "[", "{}", "[1]", "}", "]", " {", " }", '"a"', "7", "", "{[", "]}"]) for _ in range(draw.randint(1, 60))]
    path = tmp_path / "lines.json"
    path.write_text("\n".join(lines) + "\n")
    begun = []
    monkeypatch.setattr(ranges, "_decoded", lambda group: begun.append([line.decode() for line in group]) or [])
    size = path.stat().st_size
    list(ranges._values(str(path), 0, size, size, 0, 0, later))
    # By lists of the whole range.
    kept = [line for line in lines if line.strip()]
    deltas = [sum((c in "{[") - (c in "}]") for c in line) for line in kept]
    after = [min([sum(deltas[: j + 1]) for j in range(i, len(kept))] + ([] if later is None else [later])) for i in range(len(kept))]
    want, group, depth, lowest = [], [], 0, 0
    for i, line in enumerate(kept):
        if group and (depth <= lowest or (line[:1] in "{[" and depth <= after[i])):
            want.append(group)
            group = []
        group.append(line)
        depth += deltas[i]
        lowest = min(lowest, depth)
    assert begun == [*want, group]
