"""Asynchronous requests: status from markers, results, response checks."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ["in_queue", "in_progress", "completed", "failed"]


def status_columns(marker: Column) -> dict[str, Column]:
    """Aggregates from which :func:`status_from` reads a status. Flags and a count only, so they
    merge in hash tables and make small streaming state."""
    unknown = ~marker.isin(STATUSES)
    return {
        "_completed": F.max(marker == "completed"),
        "_failed": F.max(marker == "failed"),
        "_progress": F.max(marker == "in_progress"),
        "_odd_first": F.max(unknown & (marker < "completed")),
        "_odd_second": F.max(unknown & (marker < "failed")),
        "_odd": F.max(unknown),
        "_n": F.count(marker),
    }


def status_from() -> tuple[Column, Column]:
    """Status and invalid flag. Markers are read in name order up to the first terminal one, so
    ``completed`` beats ``failed`` and only an unknown name before it spoils the status."""
    odd = F.when(F.col("_completed"), F.col("_odd_first")).when(F.col("_failed"), F.col("_odd_second"))
    invalid = F.coalesce(odd.otherwise(F.col("_odd")), F.lit(False))
    status = (
        F.when(F.coalesce("_n", F.lit(0)) == 0, "not_found")
        .when(invalid, F.lit(None))
        .when(F.col("_completed"), "completed")
        .when(F.col("_failed"), "failed")
        .when(F.col("_progress"), "in_progress")
        .otherwise("in_queue")
    )
    return status, invalid


def status_of(found: Collection[str], odd: str | None) -> tuple[str | None, bool]:
    """The same rule for one request: its known markers and the smallest unknown one."""
    for terminal in ("completed", "failed"):
        if terminal in found:
            spoilt = odd is not None and odd < terminal
            return (None, True) if spoilt else (terminal, False)
    if odd is not None:
        return None, True
    return "in_progress" if "in_progress" in found else "in_queue", False


def async_status(requests: DataFrame, markers: DataFrame, key: str = "request_id") -> DataFrame:
    """Status of each requested id; ``not_found`` without markers."""
    found = markers.groupBy(key).agg(*[c.alias(n) for n, c in status_columns(F.col("marker")).items()])
    status, invalid = status_from()
    return (
        requests.select(key)
        .distinct()
        .join(found, key, "left")
        .select(key, status.alias("status"), invalid.alias("invalid"))
    )


def async_result(status: DataFrame, results: DataFrame, key: str = "request_id") -> DataFrame:
    """Result and its time for completed requests, null for all others."""
    done = F.col("status") == "completed"
    return status.join(results.select(key, "result", "modified_at"), key, "left").select(
        key,
        "status",
        F.when(done, F.col("result")).alias("result"),
        F.when(done, F.col("modified_at")).alias("modified_at"),
    )


def classify_response(responses: DataFrame) -> DataFrame:
    """Why an async response fails: ``unreachable`` (no status), ``status``, ``content_type``,
    ``not_json``; else ``ok``. A body after its first JSON value is not looked at."""
    reason = (
        F.when(F.col("status_code").isNull(), "unreachable")
        .when(F.col("status_code") != 200, "status")
        .when(~F.startswith(F.coalesce("content_type", F.lit("")), F.lit("application/json")), "content_type")
        .when(F.try_parse_json("body").isNull(), "not_json")
        .otherwise("ok")
    )
    return responses.withColumn("reason", reason)


def classify_batch_response(responses: DataFrame, hook: str | None = None) -> DataFrame:
    """Batch responses: only the status counts, and 404 is fine for the completion hook."""
    ok = F.col("status_code") == 200
    if hook is not None:
        ok = ok | (F.col(hook) & (F.col("status_code") == 404))
    return responses.withColumn(
        "reason", F.when(F.col("status_code").isNull(), "unreachable").when(~ok, "status").otherwise("ok")
    )
