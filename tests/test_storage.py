"""Listings by walk against sorted full listings."""

import os
import random

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tideline.sources import storage


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root, draw = tmp_path_factory.mktemp("keys"), random.Random(8)
    keys = set()
    for _ in range(120):
        parts = [draw.choice(["a", "a-", "a.b", "b", "b0", "c d"]) for _ in range(draw.randint(1, 4))]
        keys.add("/".join([*parts[:-1], parts[-1] + draw.choice([".json", ".txt"])]))
    for key in keys:
        os.makedirs(os.path.dirname(f"{root}/{key}"), exist_ok=True)
        open(f"{root}/{key}", "w").close()
    return str(root), sorted(f"{root}/{k}" for k in keys)


def test_walk_is_in_key_order_and_leaves_folders_out(tree):
    root, keys = tree
    local = fs.LocalFileSystem()
    draw = random.Random(1)
    for _ in range(60):
        after = draw.choice([None, draw.choice(keys), draw.choice(keys)[:-2], root])
        prefix = draw.choice([root, draw.choice(keys)[: len(root) + draw.randint(0, 6)]])
        got = [f.path for f in storage.walk(local, root, prefix, after)]
        assert got == [k for k in keys if k.startswith(prefix) and (after is None or k > after)]


def test_limits_stop_the_walk(tree, monkeypatch):
    root, keys = tree
    reader = storage.StorageReader({"paths": "[]", "limit": "3"})
    opened = []
    real = storage.walk

    def counted(system, folder, prefix, after):
        for f in real(system, folder, prefix, after):
            opened.append(f.path)
            yield f

    monkeypatch.setattr(storage, "walk", counted)
    rows = list(reader.read(storage.InputPartition((0, root + "/"))))
    assert [r[1] for r in rows] == keys[:3] and set(opened) == set(keys[:3])  # folders count their own


def test_listing_and_pages(spark, tree):
    root, keys = tree
    paths = [root + "/a", root + "/", keys[5]]
    wanted = sorted((k, i) for i, p in enumerate(paths) for k in keys if k.startswith(p))
    rows = storage.list_keys(spark, paths).collect()
    assert sorted((r["path"], r["path_index"]) for r in rows) == wanted
    pages, last = [], None
    while True:
        page = [(r["path"], r["path_index"]) for r in storage.list_keys(spark, paths, 40, last).collect()]
        if not page:
            break
        pages += page
        last = page[-1]
    assert pages == wanted
    texts = [k for k in keys if k.endswith(".txt")]
    some = storage.list_keys(spark, [root + "/"], 4, keys[3], include="**.txt").collect()
    assert [r["path"] for r in some] == [k for k in texts if k > keys[3]][:4]


def test_filters_reach_the_source(spark, tree):
    root, keys = tree
    rows = storage.list_keys(spark, [root + "/"])
    middle = keys[len(keys) // 2]
    found = rows.filter(F.col("path") > middle)
    assert sorted(r["path"] for r in found.collect()) == [k for k in keys if k > middle]
    found = rows.filter(F.startswith("path", F.lit(middle[:-3])))
    assert sorted(r["path"] for r in found.collect()) == [k for k in keys if k.startswith(middle[:-3])]
    assert rows.filter(F.col("path") >= middle).count() == sum(k >= middle for k in keys)
    assert rows.filter("path_index = 1").count() == 0
    assert storage.list_keys(spark, [root + "/none"]).count() == 0
