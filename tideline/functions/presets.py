"""Rule presets: autoscaling specs and batch job submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.rules import Field, check_records, resolved, seconds

TICK = 10

AUTOSCALING = [
    Field("min_replicas", "int32", default=1, ge=0),
    Field("max_replicas", "int32", default=100, gt=0),
    Field("init_replicas", "int32", default_field="min_replicas", ge=0),
    Field("target_in_flight", "float", gt=0, allow_null=True),
    Field("window", "duration", default="60s", ge=TICK, multiple_of=TICK),
    Field("downscale_stabilization_period", "duration", default="5m", ge=0),
    Field("upscale_stabilization_period", "duration", default="1m", ge=0),
    Field("max_downscale_factor", "float", default=0.75, ge=0, lt=1),
    Field("max_upscale_factor", "float", default=1.5, gt=1),
    Field("downscale_tolerance", "float", default=0.05, ge=0, lt=1),
    Field("upscale_tolerance", "float", default=0.05, ge=0),
]


def _cross(conditions: dict[str, tuple[str, object]]):
    """Violations between fields: rule name to (path, condition)."""
    checks = [F.when(cond, F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"))) for rule, (path, cond) in conditions.items()]
    return F.filter(F.array(*checks), lambda v: v.isNotNull())


def check_autoscaling(specs: DataFrame, record: str = "record") -> DataFrame:
    """Check autoscaling specs and fill their defaults.

    Besides ``record`` rows have ``kind, max_concurrency, max_queue_length``. Adds the settings
    as columns and ``violations``. The target defaults to the pod's concurrency; for realtime
    APIs it may not exceed concurrency plus queue. Cross-field rules use the resolved values.
    """
    checked = resolved(check_records(specs, AUTOSCALING, record), AUTOSCALING, record)
    scaled = F.col("kind").isin("RealtimeAPI", "AsyncAPI")
    target = F.when(scaled, F.coalesce("target_in_flight", F.col("max_concurrency").cast("double"))).otherwise(
        F.col("target_in_flight")
    )
    checked = checked.withColumn("target_in_flight", target).withColumns(
        {
            "window_s": seconds(F.col("window")),
            "downscale_stabilization_s": seconds(F.col("downscale_stabilization_period")),
            "upscale_stabilization_s": seconds(F.col("upscale_stabilization_period")),
        }
    )
    room = F.col("max_concurrency") + F.col("max_queue_length")
    cross = _cross(
        {
            "target_over_limit": (
                "target_in_flight",
                (F.col("kind") == "RealtimeAPI") & (F.col("target_in_flight") > room),
            ),
            "min_over_max": ("min_replicas", F.col("min_replicas") > F.col("max_replicas")),
            "init_over_max": ("init_replicas", F.col("init_replicas") > F.col("max_replicas")),
            "init_under_min": ("init_replicas", F.col("init_replicas") < F.col("min_replicas")),
        }
    )
    return checked.withColumn("violations", F.concat("violations", cross))


_PATHS = Field("s3_paths", "list", required=True, min_length=1, item=Field("", "string", pattern="^s3://[^/]+/.*"))
_LISTER = [
    _PATHS,
    Field("includes", "list", item=Field("", "string")),
    Field("excludes", "list", item=Field("", "string")),
    Field("batch_size", "int", required=True, ge=1),
]
SUBMISSION = [
    Field("workers", "int", required=True, ge=1),
    Field("timeout", "int", allow_null=True, ge=1),
    Field(
        "sqs_dead_letter_queue",
        "struct",
        allow_null=True,
        fields=[
            Field("arn", "string", required=True, allow_empty=False),
            Field("max_receive_count", "int", required=True, ge=1),
        ],
    ),
    Field("config", "map", allow_null=True),
    Field(
        "item_list",
        "struct",
        allow_null=True,
        fields=[Field("items", "list", required=True, min_length=1), Field("batch_size", "int", required=True, ge=1)],
    ),
    Field("file_path_lister", "struct", allow_null=True, fields=_LISTER),
    Field("delimited_files", "struct", allow_null=True, fields=_LISTER),
]
INPUTS = ["item_list", "file_path_lister", "delimited_files"]


def check_submission(jobs: DataFrame, record: str = "record", n_files: str | None = None) -> DataFrame:
    """Check batch job submissions. ``n_files`` names a column with the number of listed files,
    which must not be 0 for submissions that list files."""
    checked = check_records(jobs, SUBMISSION, record)
    given = [
        (F.try_variant_get(F.col(record), f"$.{name}", "variant").isNotNull())
        & ~F.coalesce(F.is_variant_null(F.try_variant_get(F.col(record), f"$.{name}", "variant")), F.lit(True))
        for name in INPUTS
    ]
    count = sum((g.cast("int") for g in given[1:]), given[0].cast("int"))
    conditions = {"no_input": ("", count == 0), "conflicting_inputs": ("", count > 1)}
    if n_files is not None:
        conditions["no_files"] = ("", (given[1] | given[2]) & (F.col(n_files) == 0))
    return checked.withColumn("violations", F.concat("violations", _cross(conditions)))
