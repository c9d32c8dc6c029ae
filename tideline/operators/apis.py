"""Deployed APIs: kinds, duplicates, splitters and what they refer to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_kind(apis: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), kind: str = "kind") -> DataFrame:
    kept = apis.filter(F.col(kind).isin(list(include))) if include else apis
    return kept.filter(~F.col(kind).isin(list(exclude))) if exclude else kept


def duplicates(apis: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` (name, canonical endpoint) that several definitions share."""
    return apis.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def endpoint_collisions(apis: DataFrame, deployed: DataFrame) -> DataFrame:
    """Endpoints already served by another API, whatever the trailing slash.

    Deployed endpoints are first reduced to the least and greatest API name of each, which
    is all it takes to tell that another one exists.
    """

    def slashed(column: str):
        return F.when(F.endswith(column, F.lit("/")), F.col(column)).otherwise(F.concat(column, F.lit("/")))

    served = deployed.groupBy(slashed("endpoint").alias("_key")).agg(
        F.min("api_name").alias("_a"), F.max("api_name").alias("_b")
    )
    mine = apis.withColumn("_key", slashed("endpoint"))
    other = F.when(F.col("_a") != F.col("api_name"), F.col("_a")).when(F.col("_b") != F.col("api_name"), F.col("_b"))
    joined = mine.join(served, "_key").withColumn("taken_by", other).filter(F.col("taken_by").isNotNull())
    return joined.drop("_key", "_a", "_b")


def api_history(versions: DataFrame, id_col: str = "api_id") -> DataFrame:
    """Versions newest first. Ids open with a 16-digit hex number that falls as time passes:
    the time in nanoseconds is the largest 64-bit integer minus it."""
    digits = F.substring(id_col, 1, 16)
    number = F.conv(digits, 16, 10).cast("decimal(20,0)")
    nanos = F.lit("9223372036854775807").cast("decimal(20,0)") - number
    return (
        versions.withColumn("created_at", F.timestamp_micros((nanos / 1000).cast("long")).cast("timestamp_ntz"))
        .orderBy(F.col(id_col))
    )


def sort_by_name(rows: DataFrame, *names: str) -> DataFrame:
    return rows.orderBy(*names)
