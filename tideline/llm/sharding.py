"""Weighted rendezvous hashing of record keys over shards.

Each (key, shard) pair has a score that depends on nothing else, and a key lives in the shard of its
best score. Adding a shard can only take keys into that shard, removing one only frees its own, and
raising a weight only attracts keys, so a change moves the smallest possible share of the records.

Everything is built from column expressions; placing a row needs no shuffle. Only the numbering of
rows inside the shards does, over narrow rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.ordering import numbered

#: Hex digits of the digest that make a score: 52 bits, exact in a double.
DIGITS = 13


def key_text(key: str | Column) -> Column:
    """The key as text; null keys share the empty text, and with it one shard."""
    return F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))


def score(key: Column, shard: int, weight: float) -> Column:
    """Cost of keeping ``key`` in ``shard``: an exponential draw of rate ``weight``; the lowest wins."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")))
    unit = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(unit) / F.lit(float(weight))


def shard_of(key: str | Column, shards: Sequence[tuple[int, float]]) -> Column:
    """The shard of each key, of ``shards`` given as (number, weight).

    Weights must be positive; equal scores (one in 2^52) go to the lower number.
    """
    if not shards or any(not weight > 0 for _, weight in shards):
        raise ValueError("shards need positive weights")
    text = key_text(key)
    choices = [F.struct(score(text, n, w).alias("cost"), F.lit(n).alias("shard")) for n, w in shards]
    return F.array_min(F.array(*choices))["shard"]


def place(
    df: DataFrame,
    key: str,
    shards: Sequence[tuple[int, float]],
    order: Sequence[str] = (),
    digits: int = 3,
    shard: str = "shard",
    slot: str = "slot",
) -> DataFrame:
    """``df`` with each row's shard and its gapless 0-based slot there.

    Slots follow the digest of the key, then the key, then ``order``; rows equal in all of these may
    change places. ``16 ** digits`` digest buckets per shard bound what one task sorts, and the counts of
    earlier buckets come from a pre-aggregated side. Null keys are one key; an empty table gives no
    rows. Columns of ``df`` named like ``shard`` or ``slot`` are replaced.
    """
    placed = df.drop(shard, slot).withColumn(shard, shard_of(key, shards).cast("int"))
    bucket = F.substring(F.md5(key_text(key)), 1, digits)
    return numbered(placed, [shard], [bucket, F.col(key), *order], bucket, slot)
