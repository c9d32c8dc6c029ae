"""Product codes against k-means over all pairs of part and entry, in Python integers."""

import hashlib
import math
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import helpers as h  # noqa: E402

from tideline.llm import quantise  # noqa: E402
from tideline.llm.catalog import QUERIES  # noqa: E402


def plain(rows, parts=8, k=16, rounds=6):
    """vec_id -> (code, error, label_error, digest), rows of one vector length without repeated ids."""
    kept = [(i, [math.floor(4096 * float(x)) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}
    kept.sort(key=lambda r: r[0])
    size = len(kept[0][1])
    cuts = [(p * size // parts, (p + 1) * size // parts) for p in range(parts)]
    books = [[r[1][a:b] for r in kept[:k]] for a, b in cuts]

    def near(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            held = {}
            for r in kept:
                held.setdefault(near(r[1][a:b], books[p])[1], []).append(r[1][a:b])
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e])] if e in held else old for e, old in enumerate(books[p])]
    found = {r[0]: [near(r[1][a:b], books[p]) for p, (a, b) in enumerate(cuts)] for r in kept}
    error = {i: sum(d for d, _ in f) for i, f in found.items()}
    by_label = {}
    for i, _, c in kept:
        by_label[c] = by_label.get(c, 0) + error[i]
    text = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    top = quantise.LONG_MAX
    return {i: ("".join(f"{e:02x}" for _, e in found[i]), min(error[i], top), min(by_label[c], top), text) for i, _, c in kept}


def coded(df, **options):
    rows = quantise.encode(df, "vec_id", "embedding", "label", **options).collect()
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in rows}


def table(spark, rows, cuts=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(cuts)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    found = h.documents(spark, sf, "embeddings")
    want = plain([(i, None if v is None else list(v), None if c != c else c) for i, v, c in found[["vec_id", "embedding", "label"]].itertuples(index=False)])
    rows = QUERIES["op13_anchor_codes"](spark, sf).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in rows} == want


@pytest.mark.parametrize("block", [7, 100, 4096])
def test_groups_copies_and_ties(spark, block):
    draw = np.random.RandomState(5)
    centres = draw.normal(size=(9, 24))
    rows = [list(centres[i % 9] + 0.05 * draw.normal(size=24)) for i in range(260)]
    rows += [rows[3]] * 60 + [list(np.round(r, 1)) for r in rows[:80]] + [[0.0] * 24] * 9
    rows = [(i * 7 % 1009, [float(x) for x in r], None if i % 5 == 0 else i % 3) for i, r in enumerate(rows)]
    assert coded(table(spark, rows), block=block) == plain(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(100 + i, v, 1) for i, v in enumerate([None, [nan] * 8, [inf] + [0.0] * 7, [None] + [0.0] * 7])]
    rows = [(i, [float((i * k) % 5) / 3 - 0.4 for k in range(8)], i % 2 or None) for i in range(9)]  # fewer than the entries
    assert coded(table(spark, rows + bad)) == plain(rows + bad)
    assert coded(table(spark, rows).limit(0)) == {} and coded(table(spark, bad)) == {}
    uneven = [(i, [i / 7.0, -i / 3.0, 0.25 * i], None) for i in range(20)]
    assert coded(table(spark, uneven)) == plain(uneven)
    mixed = coded(table(spark, rows + [(50 + i, v, 9) for i, v, _ in uneven] + [(99, [], 8)]))
    assert {i: mixed[i] for i in range(9)} == plain(rows)
    assert {i: mixed[50 + i][:2] for i in range(20)} == {i: v[:2] for i, v in plain(uneven).items()}
    assert mixed[99][:3] == ("00" * 8, 0, 0)


def test_repeated_and_null_keys(spark):
    rows = [(i // 2 if i < 30 else None, [float(i % 4), float(i % 7)] * 8, None) for i in range(40)]
    df = table(spark, rows).withColumns({n: F.lit("mine") for n in ["key", "code", "error", "size", "_n", "points"]})
    out = quantise.encode(df, "vec_id", "embedding", "label").collect()
    assert len(out) == 40 and len({r.codebooks_sha256 for r in out}) == 1
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in rows)


def test_large_components(spark):
    rows = [(i, [float(i % 5) * 10.0 ** (3 + i % 9), 1e-3 * i] * 4, i % 2) for i in range(40)]
    assert coded(table(spark, rows)) == plain(rows)
    far = coded(table(spark, [(i, [1e300 * (i % 20), -1.0] * 4, 0) for i in range(40)]))
    assert len(far) == 40 and max(v[1] for v in far.values()) <= quantise.LONG_MAX


def test_trees():
    draw = np.random.RandomState(6)
    for n, width in [(1, 3), (30, 1), (700, 4), (700, 0)]:
        points = np.concatenate([draw.randint(-2000, 2000, size=(n, width)), np.zeros((n // 3, width), dtype=int)]).astype(np.int64)
        tree = quantise.build_tree(points, leaf=8)
        tree = quantise.Tree.load(tree.dump(), width)
        assert sorted(tree.order) == list(range(len(points)))
        mine = points[tree.order]
        for b in range(len(tree.start)):
            held = mine[tree.start[b] : tree.end[b]]
            assert (tree.sums[b] == held.sum(axis=0)).all()
            assert np.sqrt(((held - tree.pivot[b]) ** 2).sum(axis=1)).max() <= tree.radius[b] * (1 + 1e-9) + 1e-9
            if tree.left[b] >= 0:
                spans = sorted((tree.start[c], tree.end[c]) for c in (tree.left[b], tree.right[b]))
                assert spans[0][0] == tree.start[b] and spans[0][1] == spans[1][0] and spans[1][1] == tree.end[b]
        entries = np.array([points[i % len(points)] for i in range(5)])
        assert (quantise.assigned(tree, mine, entries) == quantise.nearest(points, entries)[0]).all()


def test_balls_are_owned_whole():
    """On far groups no point is compared by itself."""
    points = np.concatenate([np.random.RandomState(7).randint(0, 50, size=(400, 2)) + 10_000 * i for i in range(4)])
    tree, compared = quantise.build_tree(points, leaf=8), []
    entries = np.array([[10_000 * i, 10_000 * i] for i in range(4)])
    quantise.walk(tree, points[tree.order], entries, lambda b, e: None, lambda s, e: compared.extend(s))
    assert not compared
