"""Near duplicates among vectors by hierarchical navigable small-world graphs.

Equal vectors are one class first. The classes are dealt over shards, and every shard becomes one graph: layers of
fewer and fewer nodes, each node linked to close nodes that are not close to one another. A query walks down the layers,
keeps a beam of the best nodes on the lowest one, and, wherever it meets a node within the threshold, goes on
through all such neighbours, so that a dense group is found whole and not only as far as the beam is wide.

Before a shard answers, its beam is audited: for a sample of vectors of other shards, drawn for each shard, the links found
are held against brute force over the shard, and the beam doubles until the recall passes, up to the whole shard, which is
exact. Where the sample has too few links, vectors turned away from nodes of the shard, up to the threshold, add to it. Every vector then asks every shard. Cosines are verified in double precision, links are counted in the
tasks, and only a spanning forest of them, a row per vector touched, leaves for the components.

A shard is bounded by bytes, so a task holds one graph and a batch of queries. Graphs travel in pieces, so no row, Arrow batch
or file is as large as a graph, and queries that meet very many nodes are asked a few at a time. Asking every shard makes the work
grow with vectors times shards.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.components import connected_components, forest
from tideline.llm.groups import runs
from tideline.session import bound_batches, fresh_path, materialise

#: Queries that walk a graph side by side.
BATCH = 256

#: Single-precision walks take what is this much below the threshold for verification.
SLACK = 1e-4

#: Bytes of a piece of a graph, and pieces in a file: Parquet's reader and writer hold those of a file side by side.
PIECE, PIECES = 1 << 20, 16

#: Pairs that queries may meet together; beyond, they are asked by halves.
MOST = 1 << 20

#: Bytes of vectors that are multiplied pair by pair at a time.
SLICE = 4 << 20


def _products(a: np.ndarray, rows: np.ndarray, b: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The products of ``a[rows]`` and ``b[nodes]``, pair by pair."""
    out = np.empty(len(rows), dtype=a.dtype)
    step = max(1, SLICE // (a.itemsize * a.shape[1]))
    for at in range(0, len(rows), step):
        out[at : at + step] = np.einsum("ij,ij->i", a[rows[at : at + step]], b[nodes[at : at + step]])
    return out


def diverse(sims: np.ndarray, among: np.ndarray, keep: int) -> np.ndarray:
    """Which candidates become links: by falling similarity, those nearer to the node than to any link taken.

    ``sims`` is (rows, candidates), -inf for none, sorted to fall; ``among`` the candidates' similarities to
    each other. Free places are filled with the nearest of the rest.
    """
    rows, width = sims.shape
    taken = np.zeros((rows, width), dtype=bool)
    nearest = np.full((rows, width), -np.inf, dtype=np.float32)
    for c in range(width):
        good = (sims[:, c] > nearest[:, c]) & (taken.sum(axis=1) < keep) & np.isfinite(sims[:, c])
        taken[:, c] = good
        nearest = np.where(good[:, None], np.maximum(nearest, among[:, c]), nearest)
    for c in range(width):
        taken[:, c] |= (taken.sum(axis=1) < keep) & np.isfinite(sims[:, c])
    return taken


class Graph:
    """Layers of links over unit vectors; layer 0 holds all nodes."""

    #: Beam on the layers above the lowest.
    descent = 16

    def __init__(self, unit: np.ndarray, degree: int = 16, breadth: int = 48):
        self.unit = np.ascontiguousarray(unit, dtype=np.float32)
        self.degree, self.breadth = degree, breadth
        n = len(unit)
        height = np.floor(-np.log(np.random.RandomState(11).uniform(1e-12, 1, n)) / np.log(degree)).astype(int)
        self.links: list[np.ndarray] = []
        self.nodes: list[np.ndarray] = []
        top = int(height.max()) if n else 0
        while top > 0 and (height >= top).sum() < 2:
            top -= 1
        for layer in range(top, -1, -1):
            members = np.flatnonzero(height >= layer) if layer else np.arange(n)
            self._add_layer(members, degree * (1 if layer else 2))

    def _add_layer(self, members: np.ndarray, width: int) -> None:
        """A layer below those there are: first the nodes that stand above, then batches of the rest."""
        links = np.full((len(self.unit), width), -1, dtype=np.int32)
        above = self.nodes[-1] if self.nodes else members[: min(len(members), 64)]
        rest = members[~np.isin(members, above)]
        done: list[np.ndarray] = []
        if len(above) <= 4 * BATCH:
            self._link(links, above, np.broadcast_to(above, (len(above), len(above))), width)
        else:
            rest, above = np.concatenate([above, rest]), above[:BATCH]
            self._link(links, above, np.broadcast_to(above, (len(above), len(above))), width)
            rest = rest[~np.isin(rest, above)]
        done.append(above)
        seeds = above[:1]
        at, size = 0, 64
        while at < len(rest):
            batch = rest[at : at + size]
            entry = self._descend(self.unit[batch])
            if entry is None or not (links[entry] >= 0).any():
                entry = np.full(len(batch), seeds[0])
            else:
                entry = np.where((links[entry] >= 0).any(axis=1), entry, seeds[0])
            ids, _, _, _ = self._beam(self.unit[batch], entry, links, self.breadth)
            # Nodes of one batch don't see one another in the graph yet.
            near = np.argsort(-(self.unit[batch] @ self.unit[batch].T), axis=1)[:, : min(16, len(batch))]
            self._link(links, batch, np.concatenate([ids, batch[near]], axis=1), width)
            at += size
            size = min(BATCH, size * 2)
        self.nodes.append(members)
        self.links.append(links)

    def _link(self, links: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, width: int) -> None:
        """Links ``nodes`` to the best of their ``candidates``, and those back."""
        for at in range(0, len(nodes), BATCH):
            own, found = nodes[at : at + BATCH], self._choose(nodes[at : at + BATCH], candidates[at : at + BATCH], width // 2)
            links[own, : found.shape[1]] = found
            a, b = np.repeat(own, found.shape[1]), found.ravel()
            a, b = a[b >= 0], b[b >= 0]
            order = np.argsort(b, kind="stable")
            a, b = a[order], b[order]
            targets, first, counts = np.unique(b, return_index=True, return_counts=True)
            rank = np.arange(len(b)) - np.repeat(first, counts)
            extra = np.full((len(targets), int(counts.max(initial=0))), -1, dtype=np.int32)
            extra[np.repeat(np.arange(len(targets)), counts), rank] = a
            for start in range(0, len(targets), BATCH):
                t = targets[start : start + BATCH]
                both = np.concatenate([links[t], extra[start : start + BATCH]], axis=1)
                full = (both >= 0).sum(axis=1) > width
                fits = both[~full]
                order = np.argsort(fits < 0, axis=1, kind="stable")[:, :width]
                links[t[~full]] = np.take_along_axis(fits, order, axis=1)
                if full.any():
                    links[t[full]] = self._choose(t[full], both[full], width)

    def _choose(self, nodes: np.ndarray, candidates: np.ndarray, keep: int) -> np.ndarray:
        cand = np.sort(candidates, axis=1)
        bad = (cand < 0) | (cand == nodes[:, None])
        bad[:, 1:] |= cand[:, 1:] == cand[:, :-1]
        vectors = self.unit[cand]
        sims = np.einsum("rcd,rd->rc", vectors, self.unit[nodes])
        sims[bad] = -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")[:, : max(keep, 64)]
        sims, cand = np.take_along_axis(sims, order, axis=1), np.take_along_axis(cand, order, axis=1)
        vectors = np.take_along_axis(vectors, order[:, :, None], axis=1)
        taken = diverse(sims, np.matmul(vectors, vectors.transpose(0, 2, 1)), keep)
        out = np.full((len(nodes), keep), -1, dtype=np.int32)
        row, col = np.nonzero(taken)
        place = np.cumsum(taken, axis=1)[row, col] - 1
        out[row, place] = cand[row, col]
        return out

    def _descend(self, queries: np.ndarray) -> np.ndarray | None:
        """The entry of each query to the layer below those there are."""
        if not self.nodes:
            return None
        top = self.nodes[0][:BATCH]
        entry = top[np.argmax(queries @ self.unit[top].T, axis=1)]
        for links in self.links[: len(self.nodes)]:
            ids, sims, _, _ = self._beam(queries, entry, links, self.descent)
            entry = ids[np.arange(len(queries)), np.argmax(sims, axis=1)]
        return entry

    def _beam(
        self, queries: np.ndarray, entry: np.ndarray, links: np.ndarray, breadth: int, floor: float = np.inf, spread: int = 4
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """The best ``breadth`` nodes of each query with similarities, and all (query, node) met at ``floor`` or above.

        All queries take steps together; each opens its ``spread`` best unopened nodes, until the beam
        has none. Nodes at the floor or above are then opened until no new one turns up. Several queries that meet
        over ``MOST`` of them give none.
        """
        count, n = len(queries), len(self.unit)
        ids = np.full((count, breadth), -1, dtype=np.int64)
        sims = np.full((count, breadth), -np.inf, dtype=np.float32)
        closed = np.ones((count, breadth), dtype=bool)
        seen = np.zeros((count, n), dtype=bool)
        last = np.empty(count * n, dtype=np.int32)
        opened = np.zeros((count, n), dtype=bool) if np.isfinite(floor) else None
        ids[:, 0], closed[:, 0] = entry, False
        sims[:, 0] = np.einsum("ij,ij->i", queries, self.unit[entry])
        seen[np.arange(count), entry] = True
        met_q, met_n = [np.flatnonzero(sims[:, 0] >= floor)], [entry[sims[:, 0] >= floor]]

        def fresh(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Unseen neighbours of nodes ``at`` of queries ``rows``, and their similarities."""
            near = links[at]
            flat_rows, flat = np.repeat(rows, near.shape[1]), near.ravel()
            flat_rows, flat = flat_rows[flat >= 0], flat[flat >= 0]
            code = flat_rows * n + flat
            code = code[~seen.ravel()[code]]
            turn = np.arange(len(code), dtype=np.int32)
            last[code] = turn  # of a node met twice in this step, one turn stays
            code = code[last[code] == turn]
            code.sort()
            rows, nodes = code // n, code % n
            seen.ravel()[code] = True
            value = _products(queries, rows, self.unit, nodes)
            hit = value >= floor
            met_q.append(rows[hit])
            met_n.append(nodes[hit])
            return rows, nodes, value

        active = np.arange(count)
        while len(active):
            candidate = np.where(closed[active], -np.inf, sims[active])
            pick = np.argpartition(-candidate, min(spread, breadth) - 1, axis=1)[:, :spread]
            valid = np.isfinite(np.take_along_axis(candidate, pick, axis=1))
            active, pick, valid = active[valid.any(axis=1)], pick[valid.any(axis=1)], valid[valid.any(axis=1)]
            if not len(active):
                break
            rows = np.repeat(active, valid.sum(axis=1))
            slots = pick[valid]
            closed[rows, slots] = True
            if opened is not None:
                opened[rows, ids[rows, slots]] = True
            rows, nodes, value = fresh(rows, ids[rows, slots])
            if not len(rows):
                continue
            held, first, counts = np.unique(rows, return_index=True, return_counts=True)
            rank = np.arange(len(rows)) - np.repeat(first, counts)
            new_ids = np.full((len(held), counts.max()), -1, dtype=np.int64)
            new_sims = np.full((len(held), counts.max()), -np.inf, dtype=np.float32)
            where = np.repeat(np.arange(len(held)), counts)
            new_ids[where, rank], new_sims[where, rank] = nodes, value
            all_ids = np.concatenate([ids[held], new_ids], axis=1)
            all_sims = np.concatenate([sims[held], new_sims], axis=1)
            all_closed = np.concatenate([closed[held], ~np.isfinite(new_sims)], axis=1)
            best = np.argpartition(-all_sims, breadth - 1, axis=1)[:, :breadth]
            ids[held] = np.take_along_axis(all_ids, best, axis=1)
            sims[held] = np.take_along_axis(all_sims, best, axis=1)
            closed[held] = np.take_along_axis(all_closed, best, axis=1)
        if opened is None:
            return ids, sims, np.empty(0, int), np.empty(0, int)
        rows, nodes = np.concatenate(met_q), np.concatenate(met_n)
        total = len(rows)
        left = ~opened[rows, nodes]
        rows, nodes = rows[left], nodes[left]
        step = max(1, SLICE // (8 * links.shape[1]))
        while len(rows) and (total <= MOST or count == 1):
            before = len(met_q)
            opened[rows, nodes] = True
            for at in range(0, len(rows), step):
                fresh(rows[at : at + step], nodes[at : at + step])
            rows, nodes = np.concatenate(met_q[before:]), np.concatenate(met_n[before:])
            total += len(rows)
        if total > MOST and count > 1:
            return ids, sims, None, None
        return ids, sims, np.concatenate(met_q), np.concatenate(met_n)

    def within(self, queries: np.ndarray, floor: float, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs at ``floor`` or above that a beam of ``breadth`` leads to; all of them from the shard's size on."""
        parts = [*self.parts(queries, floor, breadth)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def parts(self, queries: np.ndarray, floor: float, breadth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of :meth:`within`, at most ``MOST`` at a time unless one query meets more; those of a query together."""
        left = [(0, len(queries))]
        while left:
            low, high = left.pop()
            rows, nodes = self._pairs(queries[low:high], floor, breadth)
            if rows is None:
                left += [((low + high) // 2, high), (low, (low + high) // 2)]
            else:
                yield rows + low, nodes

    def _pairs(self, queries: np.ndarray, floor: float, breadth: int) -> tuple[np.ndarray | None, np.ndarray | None]:
        if breadth < len(self.unit):
            return self._beam(queries, self._descend(queries), self.links[-1], breadth, floor)[2:]
        near = queries @ self.unit.T >= floor
        return np.nonzero(near) if len(queries) == 1 or np.count_nonzero(near) <= MOST else (None, None)

    def packed(self, **more: np.ndarray) -> memoryview:
        """The graph's links and ``more`` as bytes for :meth:`unpacked`; the vectors should be among ``more``."""
        out = io.BytesIO()
        held = {f"nodes{i}": x for i, x in enumerate(self.nodes)}
        np.savez(out, **more, **held, **{f"links{i}": x[self.nodes[i]] for i, x in enumerate(self.links)})
        return out.getbuffer()

    @classmethod
    def unpacked(cls, held: np.lib.npyio.NpzFile, unit: np.ndarray) -> Graph:
        graph = cls.__new__(cls)
        graph.unit, graph.nodes, graph.links = unit, [], []
        for i in range(sum(n.startswith("links") for n in held.files)):
            graph.nodes.append(held[f"nodes{i}"])
            own = held[f"links{i}"]
            links = own if len(own) == len(unit) else np.full((len(unit), own.shape[1]), -1, dtype=np.int32)
            if links is not own:
                links[graph.nodes[-1]] = own
            graph.links.append(links)
        return graph


def turned(unit: np.ndarray, count: int, threshold: float) -> np.ndarray:
    """``count`` unit vectors, each at a cosine between ``threshold`` and 1 to a vector of ``unit``, in any direction."""
    draw = np.random.RandomState(13)
    base = unit[draw.randint(0, len(unit), count)].astype(np.float64)
    away = draw.normal(size=base.shape)
    away -= np.einsum("ij,ij->i", away, base)[:, None] * base
    norm = np.linalg.norm(away, axis=1, keepdims=True)
    cosine = draw.uniform(min(threshold + SLACK, 1.0), 1.0, (count, 1))
    out = np.where(norm > 1e-9, cosine * base + np.sqrt(1 - cosine**2) * away / np.maximum(norm, 1e-9), base)
    return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def audited(
    graph: Graph, sample: np.ndarray, threshold: float, target: float, breadth: int, least: int = 0
) -> tuple[int, float]:
    """The beam that finds ``target`` of the links of ``sample`` to the shard, and its recall.

    ``sample`` should hold no nodes of the shard, which find themselves. Links it lacks of ``least`` are made up for by
    :func:`turned` vectors.
    """
    if not (len(sample) or least) or not len(graph.unit):
        return breadth, 1.0
    true = found = 0
    expected = []
    at, before = 0, -1
    while True:
        for at in range(at, len(sample), BATCH):
            near = sample[at : at + BATCH] @ graph.unit.T >= threshold
            expected.append(np.packbits(near, axis=1))  # as links, those of a dense shard would take many times its bytes
            true += int(np.count_nonzero(near))
        if true >= least:
            break
        if true == before:  # no vector can be made to link, as at a threshold of 1: the whole shard is exact
            return max(breadth, len(graph.unit)), 1.0
        before = true
        at = len(expected) * BATCH  # the vectors added start a batch
        fill = np.zeros((at - len(sample), graph.unit.shape[1]), dtype=np.float32)
        sample = np.concatenate([sample, fill, turned(graph.unit, least - true, threshold)])
    while True:
        found = 0
        for i, at in enumerate(range(0, len(sample), BATCH)):
            rows, nodes = graph.within(sample[at : at + BATCH], threshold, breadth)
            found += int(np.count_nonzero(expected[i][rows, nodes >> 3] >> (7 - (nodes & 7)).astype(np.uint8) & 1))
        recall = found / true if true else 1.0
        if recall >= target or breadth >= len(graph.unit):
            return breadth, recall
        breadth *= 2


def clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, digest, size, raw): doubles of the vectors that can have a cosine; digest null for all others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch[vector]:
                raw = None if value is None else np.asarray([np.nan if x is None else x for x in value], dtype="<f8")
                if raw is None or not len(raw) or not np.isfinite(raw).all() or not raw.any():
                    rows.append((None, 0, None))
                    continue
                raw = raw / 2.0 ** np.frexp(np.abs(raw).max())[1] + 0.0  # a power of two: exact, and no overflow
                rows.append((hashlib.md5(raw.tobytes()).digest(), len(raw), raw.tobytes()))
            out = pd.DataFrame(rows, columns=["digest", "size", "raw"])
            out.insert(0, key, batch[key].to_numpy())
            yield out

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, vector).mapInPandas(run, f"`{key}` {kind}, digest binary, size int, raw binary")


def _matrix(raws: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.stack([np.frombuffer(x, dtype="<f8") for x in raws])
    return raw, *_units(raw)


def _units(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and unit vectors in single precision."""
    norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    return norm, np.divide(raw, norm[:, None], out=np.empty(raw.shape, dtype=np.float32), casting="same_kind")


def links(
    vectors: DataFrame,
    key: str,
    vector: str,
    threshold: float = 0.9,
    shards: int = 4,
    shard_bytes: int = 64 << 20,
    chunk: int = 32_768,
    audit: int = 1024,
    target: float = 0.995,
    breadth: int = 32,
    audit_links: int = 512,
) -> DataFrame:
    """A row per vector: key, n_links (other rows linked directly), component_id (smallest key reachable), kept.

    Vectors are linked when their cosine in double precision is at least ``threshold``. There are ``shards`` shards, or as
    many as ``shard_bytes`` asks for; ``chunk`` queries share one copy of a graph. About ``audit`` vectors of
    other shards, and more until ``audit_links`` links are tested, test each shard, whose beam starts at ``breadth`` and widens
    to a recall of ``target``.

    Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors link
    only with vectors of their dimension. Equal vectors are linked to each other, and each counts. Rows that repeat a
    key are one node in components. Rows with a null key have no links and come back kept, without a
    component. An empty table gives no rows; extra columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    kind = vectors.schema[key].dataType.simpleString()
    rows = materialise(clean(vectors, key, vector), "vectors")
    valid = rows.filter(F.col("digest").isNotNull() & F.col(key).isNotNull())
    classes = materialise(
        valid.groupBy("digest", "size").agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    one_each = valid.join(classes.withColumnRenamed("id", key), ["digest", "size", key]).dropDuplicates(["digest", "size"])
    sizes = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    per = {size: max(shards, -(-n * (12 * size + 150) // shard_bytes)) for size, n in sizes.items()}
    count = F.lit(shards)
    for size, s in per.items():
        count = F.when(F.col("size") == size, s).otherwise(count)
    nodes = materialise(
        one_each.select(F.col(key).alias("id"), "size", "copies", "raw", "digest")
        .withColumn("shards", count)
        .withColumn("shard", F.pmod(F.xxhash64("digest"), F.col("shards")).cast("int"))
        .drop("digest", "shards"),
        "nodes",
    )
    # Each vector may be a probe of one other shard; so many are that each shard gets about ``audit``.
    rate = F.lit(0.0)
    for size, n in sizes.items():
        rate = F.when(F.col("size") == size, min(1.0, audit * per[size] / n)).otherwise(rate)
    other = F.pmod(F.col("shard") + 1 + F.pmod(F.xxhash64("raw", F.lit(1)), F.col("shards") - 1), F.col("shards"))
    probes = (
        nodes.withColumn("shards", count)
        .filter("shards > 1")
        .filter(F.pmod(F.xxhash64("raw", F.lit(2)), F.lit(1_000_000)) < rate * 1_000_000)
        .select("id", "size", "copies", "raw", other.cast("int").alias("shard"), F.lit(1).alias("role"))
        .join(nodes.select("size", "shard").distinct(), ["size", "shard"], "left_semi")
    )

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["size", "shard"]):
            size, shard = int(group["size"].iloc[0]), int(group["shard"].iloc[0])
            asking, group = group[group["role"] == 1], group[group["role"] == 0]
            raw, _, unit = _matrix(group["raw"])
            sample = _matrix(asking["raw"])[2] if len(asking) else unit[:0]
            own = {"ids": group["id"].to_numpy(copy=True), "copies": group["copies"].to_numpy(copy=True)}
            del asking, group
            graph = Graph(unit)
            beam, recall = audited(graph, sample, threshold, target, breadth, audit_links)
            packed = graph.packed(raw=raw, **own)
            del graph, raw, unit, sample
            for at in range(0, len(packed), PIECE):
                yield pd.DataFrame({"size": [size], "shard": [shard], "piece": [at // PIECE], "graph": [bytes(packed[at : at + PIECE])],
                                    "beam": [beam], "recall": [recall]})

    # Shuffled and sorted as for a grouped map, but a graph leaves piece by piece.
    built = (
        nodes.withColumn("role", F.lit(0))
        .unionByName(probes)
        .repartition("size", "shard")
        .sortWithinPartitions("size", "shard")
        .mapInPandas(build, "size int, shard int, piece int, graph binary, beam int, recall double")
    )
    path = fresh_path(spark, "graphs")
    built.write.option("maxRecordsPerFile", PIECES).parquet(path)
    graphs = spark.read.schema(built.schema).parquet(path)
    chunks = {size: -(-n // chunk) for size, n in sizes.items()}
    parts = F.lit(1)
    for size, c in chunks.items():
        parts = F.when(F.col("size") == size, c).otherwise(parts)
    pieces = F.when(F.col("size").isNotNull(), parts).cast("int")
    asked = (
        nodes.withColumn("shards", count)
        .select(
            "size",
            F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1)).alias("shard"),
            F.pmod(F.hash("id"), pieces).cast("int").alias("chunk"),
            F.lit(1).alias("role"),
            F.lit(0).alias("piece"),
            "id",
            "raw",
            F.lit(0).alias("beam"),
        )
        .join(graphs.filter("piece = 0").select("size", "shard"), ["size", "shard"])  # a shard may have got no vector
    )
    answering = graphs.select(
        "size",
        "shard",
        F.explode(F.sequence(F.lit(0), pieces - 1)).alias("chunk"),
        F.lit(0).alias("role"),
        "piece",
        F.lit(None).cast(kind).alias("id"),
        F.col("graph").alias("raw"),
        "beam",
    )

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: Shard | None = None
        packed, beam = io.BytesIO(), 0
        for batch in batches:
            if not len(batch):
                continue
            roles = batch["role"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], roles[1:] != roles[:-1]])).tolist()
            for start, end in zip(starts, [*starts[1:], len(batch)], strict=True):
                part = batch.iloc[start:end]
                if roles[start] == 0:
                    for piece, width, content in zip(part["piece"], part["beam"], part["raw"], strict=True):
                        if piece == 0:
                            if state is not None:
                                yield state.edges()
                            state, packed, beam = None, io.BytesIO(), int(width)
                        packed.write(content)
                    continue
                if state is None:
                    state, packed = Shard(packed, beam, threshold), io.BytesIO()
                for at in range(0, len(part), BATCH):
                    yield from state.answer(part["id"].iloc[at : at + BATCH].to_numpy(), part["raw"].iloc[at : at + BATCH])
        if state is not None:
            yield state.edges()

    groups = ["size", "shard", "chunk"]
    found = materialise(
        answering.unionByName(asked)
        .repartition(*groups)
        .sortWithinPartitions(*groups, "role", "piece")
        .mapInPandas(ask, f"a {kind}, b {kind}, n long"),
        "links",
    )
    counts = found.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("outside"))
    joined = connected_components(found.filter("n is null"), "a", "b").withColumnRenamed("node", "id")
    named = (
        rows.select(key, "digest", "size")
        .join(classes, ["digest", "size"], "left")
        .join(counts, "id", "left")
        .join(joined, "id", "left")
    )
    own = F.when(F.col(key).isNotNull(), F.coalesce("component", "id", F.col(key)))
    total = F.when(F.col(key).isNotNull(), F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("outside", F.lit(0)))
    return named.select(
        key,
        F.coalesce(total, F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(own == F.col(key), F.lit(True)).alias("kept"),
    )


class Shard:
    """A loaded graph that answers queries and gathers their links as a forest."""

    def __init__(self, packed: io.BytesIO, beam: int, threshold: float):
        packed.seek(0)
        held = np.load(packed, allow_pickle=True)
        self.raw, self.ids, self.copies = held["raw"], held["ids"], held["copies"]
        self.norm, unit = _units(self.raw)
        self.graph, self.beam, self.threshold = Graph.unpacked(held, unit), beam, threshold
        self.labels = np.arange(len(self.ids))
        self.touched = np.zeros(len(self.ids), dtype=bool)
        self.entered: list[pd.DataFrame] = []

    def answer(self, ids: np.ndarray, raws: pd.Series) -> Iterator[pd.DataFrame]:
        """(id, null, links) of the queries that have links to other nodes of the shard."""
        raw, norm, unit = _matrix(raws)
        for rows, nodes in self.graph.parts(unit, self.threshold - SLACK, self.beam):
            cosine = _products(raw, rows, self.raw, nodes) / (norm[rows] * self.norm[nodes])
            other = (cosine >= self.threshold) & (self.ids[nodes] != ids[rows])
            rows, nodes = rows[other], nodes[other]
            if len(rows):
                yield self._joined(ids, rows, nodes)

    def _joined(self, ids: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> pd.DataFrame:
        order = np.argsort(rows, kind="stable")
        rows, nodes = rows[order], nodes[order]
        queries, first, size = np.unique(rows, return_index=True, return_counts=True)
        lead = np.repeat(nodes[first], size)
        self.labels = forest(len(self.labels), np.concatenate([lead, np.arange(len(self.labels))]),
                             np.concatenate([nodes, self.labels]))
        self.touched[nodes] = True
        self.entered.append(pd.DataFrame({"a": ids[queries], "b": self.ids[nodes[first]]}))
        total = np.add.reduceat(self.copies[nodes], first)
        return pd.DataFrame({"a": ids[queries], "b": None, "n": total})

    def edges(self) -> pd.DataFrame:
        """(a, b, null): the links that connect what the answers connected."""
        at = np.flatnonzero(self.touched)
        inner = pd.DataFrame({"a": self.ids[at], "b": self.ids[self.labels[at]]})
        out = pd.concat([*self.entered, inner[inner["a"] != inner["b"]]])
        out["n"] = None
        return out
