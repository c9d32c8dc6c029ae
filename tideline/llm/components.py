"""Connected components: by alternating large-star and small-star, and within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import materialise


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for links a-b among ``n`` nodes."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while not np.array_equal(jumped := labels[labels], labels):
            labels = jumped
        if np.array_equal(labels[a], labels[b]):
            return labels


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b), a > b.

    Large-star: every node links its larger neighbours to the smallest node of its neighbourhood.
    Small-star: every node links its smaller neighbours, and itself, to the smallest of them. The
    minimum is a partial aggregate joined back, so a node with many neighbours is never one group.
    """
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if large:
        # Of a node's own smaller neighbours only the minimum matters; its larger ones move.
        least = edges.groupBy("a").agg(F.min("b").alias("low"))
        moved = turned.join(least, "a", "left").select(F.col("b").alias("a"), F.coalesce("low", "a").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("low"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("low").alias("b")))
    return moved.filter("a > b").distinct()


def connected_components(edges: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """(node, component): every node that has a link and the smallest node it can reach.

    Links may repeat, run either way, and join a node with itself; null ends are left out. The steps
    alternate until a round changes nothing, which is after about log² rounds of the longest chain;
    every round is written to the shared folder. Raises if ``rounds`` do not suffice. Nodes of
    self-links only are their own component; no links give no rows.
    """
    known = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x is not null and y is not null")
    nodes = known.select(F.col("x").alias("node")).unionByName(known.select(F.col("y").alias("node"))).distinct()
    forest = materialise(
        known.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links"
    )
    state = None
    for _ in range(rounds):
        sums = forest.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.countDistinct("a").alias("d")
        ).first()
        if tuple(sums) == state or sums["n"] == 0:
            break
        # Every node hangs on one root, and no root hangs on anything: stars.
        if sums["n"] == sums["d"] and not forest.join(forest.select(F.col("a").alias("b")), "b", "left_semi").head(1):
            break
        state = tuple(sums)
        forest = materialise(_stars(_stars(forest, True), False), "stars")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = forest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
