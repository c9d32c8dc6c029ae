"""Benchmark decontamination by greedy string tiling.

Texts that share word n-grams (seeds) with a test item are candidates. For each candidate pair, tiles are
laid greedily: the longest unmarked common run of words first, found with running Karp-Rabin hashes, marked in
both texts, then shorter ones down to the seed length. The share of the item's words under tiles
decides, so passages whose sentences were put in another order, or split by other text, still count.

Seeds reach the texts in one of two ways with the same result. Up to ``broadcast`` seeds, their hashes are sent to
the tasks and each text is read once, with no shuffle of texts; beyond that, texts and items meet
in a join on the seeds, and only the pairs found go back to the texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tideline.session import materialise

WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_ids(text: str | None, known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of the lower-case words (letters and digits) of ``text``."""
    words = WORD.findall(text.lower()) if text else []
    out = np.empty(len(words), dtype=np.uint64)
    for i, word in enumerate(words):
        value = known.get(word)
        if value is None:
            value = known[word] = xxhash.xxh3_64_intdigest(word)
        out[i] = value
    if len(known) > 100_000:
        known.clear()
    return out


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes modulo 2^64 of all runs of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = total * BASE + words[k : k + n]
    return total


class _Runs:
    """The unmarked runs of one text; hashes of any width come from one running sum, whatever the width."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words, self.starts = words, starts
        n = len(words)
        steps = np.full(n, pow(int(BASE), -1, 1 << 64), dtype=np.uint64)
        steps[:1] = 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(steps), dtype=np.uint64)])
        powers = np.full(n, BASE, dtype=np.uint64)
        powers[:1] = 1
        self.powers = np.cumprod(powers)
        self.done = np.zeros(n, dtype=bool)
        self.marks = np.zeros(n + 1, dtype=np.int64)

    def mark(self) -> None:
        """Takes what was added to ``done`` into account; starts that lie under it never come back."""
        np.cumsum(self.done, out=self.marks[1:])
        self.starts = self.starts[~self.done[self.starts]]

    def free(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes (those of :func:`rolling`) of the unmarked runs of ``width`` words."""
        at = self.starts[self.starts <= len(self.words) - width]
        at = at[self.marks[at + width] == self.marks[at]]
        return at, (self.sums[at + width] - self.sums[at]) * self.powers[at + width - 1]


def _longest(item: _Runs, text: _Runs, least: int, most: int) -> int:
    """The greatest width up to ``most`` at which both have an unmarked run of equal hash; below ``least`` if there is none."""
    low, high = least - 1, most
    while low < high:
        middle = (low + high + 1) // 2
        if np.isin(item.free(middle)[1], text.free(middle)[1]).any():
            low = middle
        else:
            high = middle - 1
    return low


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, text start, length) of the tiles, ``least`` words or more.

    Each round lays the tiles of the greatest length there is. No pairs of places are formed, so words that repeat
    themselves thousands of times in both cost no more than others.
    """
    hash_i, hash_t = rolling(item, least), rolling(text, least)
    own = _Runs(item, np.flatnonzero(np.isin(hash_i, hash_t)))
    other = _Runs(text, np.flatnonzero(np.isin(hash_t, hash_i)))
    out: list[tuple[int, int, int]] = []
    width = min(len(item), len(text))
    while (width := _longest(own, other, least, width)) >= least:
        (at_i, hash_i), (at_t, hash_t) = own.free(width), other.free(width)
        common = np.isin(hash_t, hash_i)
        places: dict[int, list[int]] = {}
        for h, t in zip(hash_t[common][::-1].tolist(), at_t[common][::-1].tolist(), strict=True):
            places.setdefault(h, []).append(t)  # the first one last
        common = np.isin(hash_i, hash_t)
        for h, i in zip(hash_i[common].tolist(), at_i[common].tolist(), strict=True):
            left = places[h]
            while left and not own.done[i : i + width].any():
                t = left.pop()
                if not other.done[t : t + width].any() and np.array_equal(item[i : i + width], text[t : t + width]):
                    own.done[i : i + width] = other.done[t : t + width] = True
                    out.append((i, t, width))
        own.mark()
        other.mark()
        width -= 1
    return out


def _needed(words: int, seed: int, coverage: float) -> int:
    """Places of an item whose seed a text with ``coverage`` of it must share: a tile of n words has n - seed + 1 places.

    Places count, not distinct seeds: an item that repeats itself has fewer of those than places.
    """
    return max(1, math.ceil(coverage * words / seed - 1e-9))


def item_seeds(items: DataFrame, key: str, text: str, seed: int) -> DataFrame:
    """(item, words, seed, places): the seed hashes of each item and how often each occurs in it; items of fewer words have none."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, content in zip(batch[key], batch[text], strict=True):
                words = word_ids(content, {})
                hashes, places = np.unique(rolling(words, seed), return_counts=True)
                rows += [(item, len(words), h, n) for h, n in zip(hashes.view(np.int64).tolist(), places.tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["item", "words", "seed", "places"])

    plain = items.select(key, text).filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    return plain.mapInPandas(run, f"item {kind}, words long, seed long, places long").distinct()


def _candidates_sent(docs: DataFrame, text: str, seeds: DataFrame, seed: int, coverage: float) -> DataFrame:
    """``docs`` with ``item``, a row for each candidate pair; the seeds go to the tasks."""
    table = seeds.orderBy("seed", "item").toPandas()
    names = table.groupby("item", as_index=False)["words"].min()
    need = np.array([_needed(w, seed, coverage) for w in names["words"]])
    number = pd.Series(names.index, index=names["item"])
    hashes = table["seed"].to_numpy().view(np.uint64)
    order = np.argsort(hashes, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast(
        (
            hashes[order],
            number[table["item"]].to_numpy()[order],
            table["places"].to_numpy()[order],
            need,
            names["item"].tolist(),
        )
    )

    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_hashes, owner, places, least, item_names = sent.value
        known: dict[str, int] = {}
        for batch in batches:
            rows, found = [], []
            for row, content in enumerate(batch.column(place)):  # one text at a time leaves the batch
                own = np.unique(rolling(word_ids(content.as_py(), known), seed))
                low = np.searchsorted(sorted_hashes, own, "left")
                high = np.searchsorted(sorted_hashes, own, "right")
                hit = np.flatnonzero(high > low)
                if not len(hit):
                    continue
                at = np.concatenate([np.arange(low[h], high[h]) for h in hit])
                ids, which = np.unique(owner[at], return_inverse=True)
                counts = np.bincount(which, weights=places[at])
                for i in ids[counts >= least[ids]].tolist():
                    rows.append(row)
                    found.append(item_names[i])
            taken = batch.take(pa.array(rows, type=pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(found, type=item_type)], names=[*batch.schema.names, "item"]
            )

    kind = seeds.schema["item"].dataType.simpleString()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    item_type = to_arrow_type(seeds.schema["item"].dataType)
    return docs.mapInArrow(run, f"{columns}, item {kind}")


def _candidates_joined(docs: DataFrame, text: str, seeds: DataFrame, seed: int, coverage: float) -> DataFrame:
    """As :func:`_candidates_sent`, by a join on the seeds; a text is known by its digest meanwhile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            own = [np.unique(rolling(word_ids(t, known), seed)).view(np.int64) for t in batch[text]]
            yield pd.DataFrame(
                {"digest": np.repeat(batch["digest"], [len(x) for x in own]), "seed": np.concatenate(own)}
            )

    marked = docs.withColumn("digest", F.md5(F.col(text)))
    distinct = marked.filter(F.col(text).isNotNull()).groupBy("digest").agg(F.first(text).alias(text))
    hits = distinct.mapInPandas(run, "digest string, seed long").join(seeds, "seed")
    counted = hits.groupBy("digest", "item").agg(F.sum("places").alias("n"), F.min("words").alias("words"))
    pairs = counted.filter(F.col("n") >= F.greatest(F.lit(1), F.ceil(F.col("words") * coverage / seed - 1e-9)))
    return marked.join(pairs.select("digest", "item"), "digest").drop("digest")


def leaks(
    docs: DataFrame,
    text: str,
    items: DataFrame,
    item_key: str,
    item_text: str,
    seed: int = 5,
    coverage: float = 0.5,
    broadcast: int = 2_000_000,
) -> DataFrame:
    """A row for each row of ``docs`` and item it covers: item, item_words, covered_words, n_tiles, coverage, tiles.

    ``tiles`` are (item start, text start, length) in words. An item counts as leaked when at least ``coverage`` of
    its words lie under tiles of ``seed`` words or more. Null and empty texts leak nothing; items that
    are null, unnamed or shorter than ``seed`` words can't be told from chance and are not looked for; texts
    that share an item's name are judged each, with a row each. Repeated rows are reported
    again. Columns of ``docs`` named like a result are replaced.
    """
    results = ["item", "item_words", "covered_words", "n_tiles", "coverage", "tiles"]
    own = docs.drop(*results, "digest", "seed", "_item_text")
    seeds = materialise(item_seeds(items, item_key, item_text, seed), "seeds")
    few = seeds.count() <= broadcast
    pairs = (_candidates_sent if few else _candidates_joined)(own, text, seeds, seed, coverage)
    known_items = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("_item_text")).filter(
        "item is not null and _item_text is not null"
    )
    both = pairs.join(known_items, "item")
    kinds = "item_words long, covered_words long, n_tiles long, coverage double, "
    kinds += "tiles array<struct<item:long,text:long,length:long>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            rows = []
            for content, wanted in zip(batch[text], batch["_item_text"], strict=True):
                item = word_ids(wanted, known)
                laid = tiles(item, word_ids(content, known), seed)
                covered = sum(k for _, _, k in laid)
                shown = [{"item": i, "text": t, "length": k} for i, t, k in laid]
                rows.append((len(item), covered, len(laid), covered / len(item) if len(item) else 0.0, shown))
            out = pd.DataFrame(rows, columns=results[1:], index=batch.index)
            yield pd.concat([batch.drop(columns=["_item_text", text]), out], axis=1)[lambda x: x["coverage"] >= coverage]

    kept = [f for f in both.schema if f.name not in ("_item_text", text)]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return both.mapInPandas(run, f"{columns}, {kinds}")
