"""Brute-force counterparts and odd inputs for the corpus operators."""

from __future__ import annotations

import collections
import itertools
import re

import numpy as np
import pandas as pd

LONG = " ".join(f"word{i % 997} and{i % 31}" for i in range(30_000))

#: Null, empty, blank, tied, repeated and very long texts.
ODD_TEXTS = [None, "", " \n ", "one", "one two", "The same five words here", "the same five words here", LONG, LONG, "é ü ß"]


def odd_documents(spark):
    """Odd texts with a repeated row, a null key, and columns that carry the operators' own names."""
    rows = [(i, t, "src0" if i % 2 else None, -1) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], (None, "a text without a key of its own", "src1", 7), (None, None, None, None)]
    schema = "doc_id long, text string, source string, n_chars long"
    extra = ["kept", "spans", "score", "labels", "shard", "slot", "item", "length", "queue", "component_id", "digest"]
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit("mine") for name in extra})


def empty_documents(spark):
    return odd_documents(spark).limit(0)


def shingle_sets(texts, size):
    out = []
    for text in texts:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        full = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        out.append(full if len(words) >= size else {tuple(words)} if words else set())
    return out


def components(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def near_components(ids, texts, size, percent):
    """doc_id -> (set size, smallest reachable doc_id), by comparing all pairs that share a shingle."""
    sets = shingle_sets(texts, size)
    places = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            places[x].append(i)
    both = collections.Counter(p for v in places.values() for p in itertools.combinations(v, 2))
    pairs = [p for p, k in both.items() if 100 * k >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - k)]
    roots = components(len(ids), pairs)
    low = {}
    for i, r in enumerate(roots):
        low[r] = min(low.get(r, ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), low[r]) for i, r in enumerate(roots)}


def repeats(texts, length):
    """(bytes, removed mask) per text: bytes under windows that start twice anywhere."""
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        mask = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append((r, mask))
    return out


def documents(spark, sf_dir, name="documents") -> pd.DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").toPandas()
