"""Numbering rows without ever putting one key, or the whole table, into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import materialise


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    name: str = "pos",
) -> DataFrame:
    """0-based position of each row within ``keys``, in ``order``.

    ``bucket`` must never decrease along ``order`` (a day of a time, a prefix of the order
    columns). A window only ever holds one bucket of one key; the row counts of earlier
    buckets come from a pre-aggregated side, so a key with a third of the rows is spread
    over its buckets.
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket)
    # Without keys this side, one row per bucket, is the only thing that meets in one task.
    whole = keys or [F.lit(0)]
    before = (
        tagged.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy(*whole).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    # Only buckets after a key's first one need a correction; small keys have none.
    before = before.filter(F.col("_before") > 0)
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return (
        tagged.withColumn("_local", local)
        .join(before, [*keys, "_bucket"], "left")
        .withColumn(name, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long"))
        .drop("_local", "_before", "_bucket")
    )


def numbered_by_range(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "pos",
    partitions: int | None = None,
) -> DataFrame:
    """As :func:`numbered`, for orders without a natural bucket (file keys, free text).

    Rows are range-partitioned on keys and order, so any key may span many partitions. The
    ranges are sampled and could differ in a second evaluation, hence the written stage.
    ``order`` must be total; the whole row is carried, so pass the needed columns only.
    """
    keys, order = list(keys), list(order)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id())
    return numbered(materialise(ranged, "ranges"), keys, order, F.col("_range"), name).drop("_range")


def running_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of a key: for pre-aggregated sides (files, buckets)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0))).drop(value)
