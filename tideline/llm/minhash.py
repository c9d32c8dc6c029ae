"""Near duplicates by MinHash: banded signatures propose, full shingle sets decide.

1. Each text becomes its set of distinct word shingles. ``rows * bands`` universal hash functions keep one
   minimum each; every ``rows`` minima are one band key.
2. Texts with the same shingle set are one class, held by its smallest key; only class representatives
   go on, so exact copies cost one row however many there are.
3. Representatives that share a band key are candidates. Each bucket first forms a star: all
   members against its smallest one. Similarities are counted on the full sets and the links give
   components (large-star, small-star).
4. What may be missing then are links between different components of one bucket. Buckets that
   have come together, which all tight groups have, are done. In the others, signatures tell which members of
   different components may be linked; a spanning forest of those pairs, not the pairs, leaves the
   tasks. Its trees are families. A family's texts meet in one task, or in one for every two of its blocks, where
   pairs of different components whose signatures are near are counted on the full sets, and pairs
   that a link has joined meanwhile are passed over.

No bucket is cut or sampled, and no step writes pairs in number beyond the rows it read. A pair at the threshold is
missed only if no band agrees: with the defaults 7e-9 at a similarity of 0.85, less above. Comparing inside a
bucket or family that does not come together is quadratic in its members, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.components import connected_components
from tideline.llm.groups import map_groups
from tideline.session import materialise

#: Odd multipliers that join word hashes to a shingle hash.
MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def word_hashes(text: str, known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the words of ``text``: A-Z lowered, split at ASCII white space. ``known`` caches them."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words), dtype=np.uint64)
    for i, word in enumerate(words):
        value = known.get(word)
        if value is None:
            value = known[word] = xxhash.xxh3_64_intdigest(word)
        out[i] = value
    if len(known) > 100_000:
        known.clear()
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``size`` are one shingle, no words none."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    width = min(size, n)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = _mixed(total * MIX[k % 3] + words[k : n - width + 1 + k])
    return np.unique(total)


class Hashes:
    """``count`` functions of the multiply-add-shift family, which is universal, 64 to 32 bits."""

    def __init__(self, count: int, seed: int = 7):
        draw = np.random.RandomState(seed)
        self.a = draw.randint(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.randint(0, 2**63, count, dtype=np.uint64)

    def minima(self, values: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint64)
        for at in range(0, len(values), 2048):
            part = values[at : at + 2048, None] * self.a + self.b
            np.minimum(best, (part >> np.uint64(32)).min(axis=0), out=best)
        return best.astype(np.uint32)


SIGNED = "n_shingles long, set_key binary, bands array<long>, brief binary"


def signed(docs: DataFrame, key: str, text: str, size: int, rows: int, bands: int) -> DataFrame:
    """(key, n_shingles, set_key, bands, brief): set size, digest, band keys and the low bytes of the minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = Hashes(rows * bands), {}
        for batch in batches:
            out: dict[str, list] = {"n_shingles": [], "set_key": [], "bands": [], "brief": []}
            for content in batch.column(1):  # one text at a time leaves the batch
                found = shingles(word_hashes(content.as_py() or "", known), size)
                out["n_shingles"].append(len(found))
                if not len(found):
                    for name in ("set_key", "bands", "brief"):
                        out[name].append(None)
                    continue
                low = hashes.minima(found)
                marks = [xxhash.xxh3_64_intdigest(p.tobytes(), seed=i) - 2**63 for i, p in enumerate(low.reshape(bands, rows))]
                out["set_key"].append(hashlib.md5(found.tobytes()).digest())
                out["bands"].append(np.array(marks, dtype=np.int64))
                out["brief"].append(low.astype(np.uint8).tobytes())
            kinds = {"n_shingles": pa.int64(), "set_key": pa.binary(), "bands": pa.list_(pa.int64()), "brief": pa.binary()}
            columns = [pa.array(out[n], type=t) for n, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *kinds])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {SIGNED}")


def _verified(pairs: DataFrame, texts: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` with 100 * intersection >= percent * union on their full shingle sets.

    Pairs mostly arrive sorted by ``a`` within a task, so the set of a star's centre is built once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        last, held = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            centre = batch.column(0)
            for i in range(len(batch)):
                if last is None or centre[i] != last:
                    last, held = centre[i], shingles(word_hashes(batch.column(2)[i].as_py(), known), size)
                other = shingles(word_hashes(batch.column(3)[i].as_py(), known), size)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(held) + len(other) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    kind = texts.schema[key].dataType.simpleString()
    left = texts.select(F.col(key).alias("a"), F.col(text).alias("left_text"))
    right = texts.select(F.col(key).alias("b"), F.col(text).alias("right_text"))
    whole = pairs.join(right, "b").join(left, "a").select("a", "b", "left_text", "right_text")
    return whole.mapInArrow(run, f"a {kind}, b {kind}")


def _sides(frame: pd.DataFrame) -> list[tuple[int, np.ndarray]]:
    """Which rows each row of a block pair is compared with: all later ones, or those of the other block."""
    side = frame["side"].to_numpy()
    if (side == 2).any():
        other = np.flatnonzero(side == 2)
        return [(i, other) for i in np.flatnonzero(side == 0).tolist()]
    return [(i, np.arange(i + 1, len(side))) for i in range(len(side) - 1)]


def _near(briefs: np.ndarray, i: int, others: np.ndarray, least: float) -> np.ndarray:
    return others[(briefs[others] == briefs[i]).mean(axis=1) >= least]


def _hopeful(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """A spanning forest of the pairs of different components whose signatures agree enough."""
    briefs = np.stack([np.frombuffer(x, dtype=np.uint8) for x in group["brief"]])
    part, ids = group["component"].to_numpy(), group["id"].to_numpy()
    label = np.arange(len(ids))
    for i, others in _sides(group):
        near = _near(briefs, i, others[(part[others] != part[i]) & (label[others] != label[i])], least)
        if len(near):
            label[np.isin(label, label[near])] = label[i]
    member = np.flatnonzero(label != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[member], "b": ids[label[member]]})


def _settled(group: pd.DataFrame, least: float, size: int, percent: int) -> pd.DataFrame:
    """Links between different components of a family, as far as they join something new."""
    briefs = np.stack([np.frombuffer(x, dtype=np.uint8) for x in group["brief"]])
    ids, texts, known = group["id"].to_numpy(), group["text"].tolist(), {}
    label = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
    sets: dict[int, np.ndarray] = {}

    def full(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(word_hashes(texts[i], known), size)
        return sets[i]

    out = []
    for i, others in _sides(group):
        for j in _near(briefs, i, others[label[others] != label[i]], least).tolist():
            if label[j] == label[i]:
                continue
            a, b = full(i), full(j)
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                out.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return pd.DataFrame(out, columns=["a", "b"])


def _dealt(members: DataFrame, keys: list[str], sizes: DataFrame, block: int) -> DataFrame:
    """``members`` of the groups in ``sizes`` (keys, members) over pairs of blocks: first, second and side.

    Members are dealt over blocks by a digest; each pair of blocks is one group of at most about two
    blocks' size, whatever the group's. Side 1 marks a block paired with itself.
    """
    return (
        members.join(sizes, keys)
        .withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("first", F.least("own", "other"))
        .withColumn("second", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("own") == F.col("other"), 1).when(F.col("own") < F.col("other"), 0).otherwise(2))
    )


def near_duplicates(
    docs: DataFrame,
    key: str,
    text: str,
    size: int = 5,
    percent: int = 80,
    rows: int = 5,
    bands: int = 32,
    block: int = 2048,
) -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id (smallest linked key, its own included), kept.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| on their distinct ``size``-word shingles.
    Words are lower-cased (A-Z) and split at ASCII white space; a text of fewer words is one
    shingle; null, empty and blank texts are linked with nothing. Rows that repeat a key are each judged by
    their own text. Rows with a null key form no links and come back kept, without a component. Extra columns
    are ignored; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    sets = materialise(signed(docs, key, text, size, rows, bands), "signed")
    filled = sets.filter(F.col("set_key").isNotNull() & F.col(key).isNotNull())
    classes = materialise(filled.groupBy("set_key").agg(F.min(key).alias("id")), "classes")
    one_each = filled.join(classes.select("set_key", F.col("id").alias(key)), ["set_key", key])
    names = materialise(one_each.select(F.col(key).alias("id"), "brief", "bands"), "representatives")
    banded = names.select("id", F.posexplode("bands").alias("band", "mark"))
    buckets = (
        banded.groupBy("band", "mark")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"))
        .filter("low <> high")
        .select("band", "mark", "low")
    )
    shared = materialise(banded.join(buckets, ["band", "mark"]), "shared")
    stars = shared.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    involved = shared.select(F.col("id").alias(key)).distinct()
    texts = materialise(docs.select(key, text).join(involved, key, "left_semi"), "texts")
    links = materialise(_verified(stars, texts, key, text, size, percent), "links")
    joined = connected_components(links, "a", "b").withColumnRenamed("node", "id")

    parted = shared.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = (
        parted.groupBy("band", "mark")
        .agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("members"))
        .filter("c0 <> c1")
        .select("band", "mark", "members")
    )
    # Below the threshold by five standard errors of a signature of this length.
    share = percent / 100
    least = share - 5 * (share * (1 - share) / (rows * bands)) ** 0.5

    def hopeful(group: pd.DataFrame) -> pd.DataFrame:
        return _hopeful(group, least)

    def settled(group: pd.DataFrame) -> pd.DataFrame:
        return _settled(group, least, size, percent)

    pair = f"a {kind}, b {kind}"
    dealt = _dealt(parted, ["band", "mark"], apart, block).join(names.select("id", "brief"), "id")
    spots = ["band", "mark", "first", "second"]
    trees = map_groups(dealt.select(*spots, "side", "id", "component", "brief"), spots, hopeful, pair)
    families = materialise(
        connected_components(trees, "a", "b")
        .withColumnsRenamed({"node": "id", "component": "family"})
        .join(joined, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .join(names.select("id", "brief"), "id"),
        "families",
    )
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    own_texts = texts.select(F.col(key).alias("id"), F.col(text).alias("text")).dropDuplicates(["id"])
    gathered = _dealt(families, ["family"], sizes, block).join(own_texts, "id")
    spots = ["family", "first", "second"]
    added = materialise(
        map_groups(gathered.select(*spots, "side", "id", "component", "brief", "text"), spots, settled, pair), "links"
    )
    if added.head(1):
        joined = connected_components(links.unionByName(added), "a", "b").withColumnRenamed("node", "id")
    # Documents meet their class, and the class its component.
    named = sets.select(key, "n_shingles", "set_key").join(classes, "set_key", "left").join(joined, "id", "left")
    own = F.coalesce("component", "id", F.col(key))
    return named.select(key, "n_shingles", own.alias("component_id"), F.coalesce(own == F.col(key), F.lit(True)).alias("kept"))
