"""Content hashes of API specs, and what an update changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.ordering import numbered

# The parts of a spec that make a pod, and those that make the rest of it.
POD_PARTS = ["resource", "pod"]
SPEC_PARTS = ["apis", "networking", "autoscaling", "update_strategy", "node_groups"]


def spec_identity(
    specs: DataFrame, bucket: Column, pod_parts: Sequence[str] = POD_PARTS, spec_parts: Sequence[str] = SPEC_PARTS
) -> DataFrame:
    """Hashes of each spec version and its relation to the version before.

    ``pod_id`` covers the pod parts, ``spec_id`` the pod id and all other parts. ``change`` is
    ``created``, ``none`` (a no-op update), ``pod`` or ``spec`` (the pods can stay). Rows:
    api_name, version (ordered), the parts. ``bucket`` never decreases with the version; versions
    find their predecessor by number, so an API with many versions stays spread out.
    """
    pod_id = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in pod_parts]), 256)
    rest = [F.coalesce(F.col(p).cast("string"), F.lit("")) for p in spec_parts if p in specs.columns]
    hashed = specs.withColumn("pod_id", pod_id)
    hashed = hashed.withColumn("spec_id", F.substring(F.sha2(F.concat_ws("|", "pod_id", *rest), 256), 1, 32))
    hashed = hashed.select("api_name", "version", "pod_id", "spec_id")
    placed = numbered(hashed, ["api_name"], ["version"], bucket, "_pos")
    before = placed.select(
        "api_name",
        (F.col("_pos") + 1).alias("_pos"),
        F.col("pod_id").alias("_pod"),
        F.col("spec_id").alias("_spec"),
    )
    change = (
        F.when(F.col("_spec").isNull(), "created")
        .when(F.col("_spec") == F.col("spec_id"), "none")
        .when(F.col("_pod") == F.col("pod_id"), "spec")
        .otherwise("pod")
    )
    return placed.join(before, ["api_name", "_pos"], "left").select(
        "api_name", "version", "pod_id", "spec_id", change.alias("change")
    )
