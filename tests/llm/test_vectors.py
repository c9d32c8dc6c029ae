"""Small-world graphs against brute force over all pairs."""

import io
import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))
import helpers as h  # noqa: E402

from tideline import session  # noqa: E402
from tideline.llm import hnsw  # noqa: E402
from tideline.llm.catalog import QUERIES  # noqa: E402


def brute(ids, vectors, threshold=0.9):
    use = [i for i, v in enumerate(vectors) if v is not None and len(v) and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    unit = {i: np.array(vectors[i], float) / np.linalg.norm(np.array(vectors[i], float)) for i in use}
    pairs = [(i, j) for i in use for j in use if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    roots, low, n = h.components(len(ids), pairs), {}, [0] * len(ids)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    for i, r in enumerate(roots):
        low[r] = min(low.get(r, ids[i]), ids[i])
    return {ids[i]: (n[i], low[r]) for i, r in enumerate(roots)}


def found(df, **options):
    return {r.vec_id: (r.n_links, r.component_id) for r in hnsw.links(df, "vec_id", "embedding", **options).collect()}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    table = h.documents(spark, sf, "embeddings")
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op10_hnsw_components"](spark, sf).collect()}
    assert got == brute(list(table.vec_id), list(table.embedding))


def test_groups_chains_and_copies(spark):
    draw = np.random.RandomState(4)
    centres = draw.normal(size=(6, 16))
    rows = [c + 0.1 * draw.normal(size=16) for c in centres for _ in range(40)]
    rows += [3.5 * rows[0], rows[1], rows[1], rows[50] * 0.25]
    angle = np.linspace(0, 3, 30)
    rows += [np.concatenate([[np.cos(a), np.sin(a)], np.zeros(14)]) for a in angle]  # a chain of near neighbours
    rows += list(draw.normal(size=(200, 16)))
    vectors = [[float(x) for x in r] for r in rows]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    want = brute(list(range(len(vectors))), vectors)
    assert found(df, target=1.0) == want
    assert found(df, target=1.0, shards=2, chunk=50, audit=5, breadth=4) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0], [2.0, 0.0], [1e300, 1e-300], [1e-300, 0.0], [-1.0, 0.0], [1.0, 0.0, 0.0], [2.0, 0.0, 0.1], [1.0]]
    df = spark.createDataFrame([(i, v, "mine") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, digest string")
    got = found(df)
    assert {i: got[i] for i in range(6)} == {i: (0, i) for i in range(6)}
    assert {i: got[i] for i in range(6, 10)} == {i: (3, 6) for i in range(6, 10)}
    assert got[10] == (0, 10) and got[11] == (1, 11) and got[12] == (1, 11) and got[13] == (0, 13)
    twice = df.unionByName(df).unionByName(df.selectExpr("cast(null as long) as vec_id", "embedding", "digest"))
    rows = hnsw.links(twice, "vec_id", "embedding").collect()
    assert len(rows) == 3 * len(vectors)
    assert all(r.n_links == 0 and r.component_id is None and r.kept for r in rows if r.vec_id is None)
    assert {r.n_links for r in rows if r.vec_id == 6} == {7}
    assert hnsw.links(df.limit(0), "vec_id", "embedding").collect() == []


def test_forest():
    draw = np.random.RandomState(1)
    for _ in range(50):
        n = draw.randint(1, 40)
        a, b = draw.randint(0, n, (2, draw.randint(0, 40)))
        roots = h.components(n, zip(a.tolist(), b.tolist()))
        low = {}
        for i, r in enumerate(roots):
            low.setdefault(r, i)
        assert hnsw.forest(n, a, b).tolist() == [low[r] for r in roots]


class Narrow(hnsw.Graph):
    """A graph that finds nothing with a beam below 16."""

    def within(self, queries, floor, breadth):
        rows, nodes = super().within(queries, floor, breadth)
        return (rows, nodes) if breadth >= 16 else (rows[:0], nodes[:0])


def test_audit_widens_the_beam():
    draw = np.random.RandomState(2)
    unit = draw.normal(size=(600, 24))
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    beam, recall = hnsw.audited(Narrow(unit), unit[:100], 0.99, 1.0, 2)
    assert recall == 1.0 and beam >= 16
    assert hnsw.audited(hnsw.Graph(unit), unit[:0], 0.99, 1.0, 2) == (2, 1.0)


def test_audit_without_links_of_the_sample():
    draw = np.random.RandomState(3)
    unit = draw.normal(size=(600, 24))
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    apart = -unit[:5]
    for sample in (unit[:0], apart):
        beam, recall = hnsw.audited(Narrow(unit), sample, 0.9, 1.0, 2, 50)
        assert recall == 1.0 and beam >= 16
    assert hnsw.audited(hnsw.Graph(unit), apart, 1.01, 1.0, 2, 50) == (600, 1.0)
    near = hnsw.turned(unit, 300, 0.9)
    assert (np.max(near @ unit.T, axis=1) >= 0.9).all() and (np.max(near @ unit.T, axis=1) < 0.9999).any()
    assert hnsw.turned(np.ones((1, 1), np.float32), 3, 0.9).tolist() == [[1.0]] * 3


def test_few_links_are_found(spark):
    draw = np.random.RandomState(5)
    rows = draw.normal(size=(3000, 32))
    rows[2960:] = rows[:40] + 0.35 * draw.normal(size=(40, 32))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = {i for i in range(40) if unit[i] @ unit[2960 + i] >= 0.9}
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = found(df, shards=2, audit=4, breadth=1, target=1.0)
    assert len(want) > 20 and {i for i in range(40) if got[i][0]} == want


def test_graphs_travel_in_pieces(spark, monkeypatch):
    draw = np.random.RandomState(6)
    centres = draw.normal(size=(20, 16))
    rows = [c + 0.1 * draw.normal(size=16) for c in centres for _ in range(30)]
    vectors = [[float(x) for x in r] for r in rows]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    monkeypatch.setattr(hnsw, "PIECE", 4096)
    made = len(session._made)
    assert found(df, target=1.0, shards=2, chunk=200) == brute(list(range(len(vectors))), vectors)
    path = next(p for p in session._made[made:] if "/graphs-" in p)
    graphs = spark.read.parquet(path).toPandas()
    assert graphs["graph"].str.len().max() <= 4096 and len(graphs) > 20
    assert max(len(g) for _, g in graphs.groupby(spark.read.parquet(path).selectExpr("input_file_name() as f").toPandas()["f"])) <= hnsw.PIECES


def test_dense_queries_are_asked_by_halves(monkeypatch):
    draw = np.random.RandomState(7)
    unit = (np.ones(16) + 0.1 * draw.normal(size=(400, 16))).astype(np.float32)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    monkeypatch.setattr(hnsw, "MOST", 1000)
    monkeypatch.setattr(hnsw, "SLICE", 4096)
    held = np.load(io.BytesIO(hnsw.Graph(unit).packed()))
    graph = hnsw.Graph.unpacked(held, unit)
    want = set(zip(*(x.tolist() for x in np.nonzero(unit[:50] @ unit.T >= 0.9))))
    assert len(want) > 15_000
    for breadth in (32, 400):
        parts = [*graph.parts(unit[:50], 0.9, breadth)]
        assert all(len(rows) <= 1000 or len(set(rows.tolist())) == 1 for rows, _ in parts)
        assert sum(len(rows) for rows, _ in parts) == len(want)
        assert {(a, b) for rows, nodes in parts for a, b in zip(rows.tolist(), nodes.tolist())} == want
    assert hnsw.audited(graph, unit[:50], 0.9, 1.0, 32) == (32, 1.0)
