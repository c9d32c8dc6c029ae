"""Weighted and shadow traffic splitting, its checks and outcomes.

Splits are rows ``(splitter, target, weight, shadow)``. Routing hashes the request id, so a
rerun sends every request to the same target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numeric import hash_bucket


def _tables(splits: DataFrame) -> DataFrame:
    """One row per splitter: weight ranges of its targets, and its shadow target.

    Weights sum to 100, so a valid splitter has at most 100 targets that receive anything.
    """
    order = Window.partitionBy("splitter").orderBy("target").rowsBetween(Window.unboundedPreceding, 0)
    main = splits.filter("NOT shadow AND weight > 0").withColumn("hi", F.sum("weight").over(order))
    ranges = main.groupBy("splitter").agg(
        F.collect_list(F.struct((F.col("hi") - F.col("weight")).alias("lo"), "hi", "target")).alias("ranges")
    )
    shadows = splits.filter("shadow").groupBy("splitter").agg(
        F.min(F.struct("target", "weight")).alias("shadow")
    )
    return ranges.join(shadows, "splitter", "left")


def route(requests: DataFrame, splits: DataFrame, key: str = "request_id", salt: str = "route:") -> DataFrame:
    """Adds ``target``, chosen by weight, and ``is_shadow = false``. Exactly one row per request.

    The small table of splitters joins on the splitter; the range is picked inside the row,
    so no request is ever multiplied by the number of targets.
    """
    bucket = hash_bucket(F.col(key), salt)
    joined = requests.join(_tables(splits).select("splitter", "ranges"), "splitter").withColumn("_b", bucket)
    hit = F.filter("ranges", lambda r: (r["lo"] <= F.col("_b")) & (F.col("_b") < r["hi"]))
    return joined.withColumn("target", F.get(hit, F.lit(0))["target"]).withColumn("is_shadow", F.lit(False)).drop(
        "ranges", "_b"
    )


def shadow(requests: DataFrame, splits: DataFrame, key: str = "request_id", salt: str = "shadow:") -> DataFrame:
    """Copies of ``weight`` percent of the requests for the splitter's shadow target, if it has one."""
    joined = requests.join(_tables(splits).select("splitter", "shadow"), "splitter").filter(F.col("shadow").isNotNull())
    chosen = joined.filter(hash_bucket(F.col(key), salt) < F.col("shadow.weight"))
    return chosen.withColumn("target", F.col("shadow.target")).withColumn("is_shadow", F.lit(True)).drop("shadow")


def route_with_shadow(requests: DataFrame, splits: DataFrame, key: str = "request_id") -> DataFrame:
    return route(requests, splits, key).unionByName(shadow(requests, splits, key))


def validate_splits(splits: DataFrame) -> DataFrame:
    """Violations per splitter: weights off 100, repeated targets, more than one shadow."""
    by_target = splits.groupBy("splitter", "target").agg(
        F.sum(F.when(~F.col("shadow"), F.col("weight")).otherwise(0)).alias("w"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("shadow").alias("s"),
    )
    totals = by_target.groupBy("splitter").agg(
        F.sum("w").alias("total_weight"), F.max("n").alias("_n"), F.sum("s").alias("_s")
    )
    checks = F.array(
        F.when(F.col("total_weight") != 100, "weights"),
        F.when(F.col("_n") > 1, "not_unique"),
        F.when(F.col("_s") > 1, "shadows"),
    )
    return totals.select("splitter", "total_weight", F.array_compact(checks).alias("violations"))


def split_outcomes(routed: DataFrame) -> DataFrame:
    """Share, error rate and mean latency per target, shadow traffic apart from primary.

    ``routed``: splitter, target, is_shadow, status_code, duration_s.
    """
    per_target = routed.groupBy("splitter", "target", "is_shadow").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("status_code") >= 500).cast("double")).alias("error_rate"),
        F.avg("duration_s").alias("mean_s"),
    )
    # A handful of targets per splitter are left for the window.
    total = F.sum("n").over(Window.partitionBy("splitter", "is_shadow"))
    return per_target.withColumn("share", F.col("n") / total)


def missing_targets(splits: DataFrame, *deployed: DataFrame) -> DataFrame:
    """Targets that no given table of APIs (``api_name``) knows."""
    missing = splits.select("splitter", "target").distinct()
    for apis in deployed:
        known = apis.select(F.col("api_name").alias("target"))
        missing = missing.join(known, "target", "left_anti")
    return missing.select("splitter", "target")


def used_by(apis: DataFrame, splits: DataFrame) -> DataFrame:
    """Splitters that refer to each API (which blocks its deletion), one row each."""
    users = splits.select(F.col("target").alias("api_name"), "splitter").distinct()
    return users.join(apis.select("api_name"), "api_name", "left_semi")
