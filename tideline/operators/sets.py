"""Set operations between tables, and between keyed sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(*sets: DataFrame) -> DataFrame:
    whole = sets[0]
    for other in sets[1:]:
        whole = whole.unionByName(other)
    return whole.distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Elements of exactly one side, found in one grouping instead of two differences."""
    columns = left.columns
    sides = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(2)))
    ends = sides.groupBy(*columns).agg(F.min("_side").alias("_a"), F.max("_side").alias("_b"))
    return ends.filter("_a = _b").select(*columns)


def compare_keyed(left: DataFrame, right: DataFrame, key: str, element: str, prefix: str | None = None) -> DataFrame:
    """For each key of either side, how its two sets relate.

    ``equal``, ``subset`` (left within right), ``superset``, ``any_shared``, and with ``prefix``
    whether a left element starts with it. Only counts are kept per key, so sets may be of any size.
    """
    marked = left.select(key, element, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, element, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    elements = marked.groupBy(key, element).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    has_prefix: Column = F.lit(False) if prefix is None else F.startswith(F.col(element), F.lit(prefix))
    return (
        elements.groupBy(key)
        .agg(
            F.sum("_l").alias("_nl"),
            F.sum("_r").alias("_nr"),
            F.sum(F.col("_l") * F.col("_r")).alias("_both"),
            F.max((F.col("_l") == 1) & has_prefix).alias("has_prefix"),
        )
        .select(
            key,
            ((F.col("_both") == F.col("_nl")) & (F.col("_both") == F.col("_nr"))).alias("equal"),
            (F.col("_both") == F.col("_nl")).alias("subset"),
            (F.col("_both") == F.col("_nr")).alias("superset"),
            (F.col("_both") > 0).alias("any_shared"),
            "has_prefix",
        )
    )


def _digest(value: str, ignore: str | None) -> Column:
    """Values are compared by SHA-256, so that long texts are hashed in the scan and never shuffled."""
    return F.sha2(F.col(value) if ignore is None else F.regexp_replace(value, ignore, ""), 256)


def distinct_first(rows: DataFrame, value: str, position: str, ignore: str | None = None) -> DataFrame:
    """The row with the smallest (unique) ``position`` of each value; ``ignore`` is a pattern removed
    before comparing."""
    firsts = rows.groupBy(_digest(value, ignore).alias("_digest")).agg(F.min(position).alias(position))
    return rows.join(firsts.select(position), position, "left_semi")


def duplicate_values(rows: DataFrame, value: str, position: str, ignore: str | None = None) -> DataFrame:
    """How often each repeated value occurs, with the position of its first occurrence."""
    counts = rows.groupBy(_digest(value, ignore).alias("_digest")).agg(
        F.min(position).alias(position), F.count(F.lit(1)).alias("n")
    )
    return counts.filter(F.col("n") > 1).drop("_digest")


def multiset_match(left: DataFrame, right: DataFrame, key: Sequence[str], element: str) -> DataFrame:
    """Per key, whether both sides hold the same elements the same number of times."""
    signed = left.select(*key, element, F.lit(1).alias("_n")).unionByName(
        right.select(*key, element, F.lit(-1).alias("_n"))
    )
    balance = signed.groupBy(*key, element).agg(F.sum("_n").alias("_n"))
    return balance.groupBy(*key).agg((F.max(F.abs("_n")) == 0).alias("matches"))
