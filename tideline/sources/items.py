"""Item intake: item lists inside submissions, and files that hold JSON values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources import ranges

MAX_MESSAGE_BYTES = 250 * 1024


def item_list(submissions: DataFrame, items: str = "items", on_empty: str = "fail") -> DataFrame:
    """One row per item of a submission's JSON array, with its position; items keep their JSON type.

    ``on_empty`` is ``fail`` (an empty list stops the job, the default) or ``skip``.
    """
    parsed = F.parse_json(items).cast("array<variant>")
    if on_empty == "fail":
        message = F.lit("item list: there must be at least 1 element")
        parsed = F.when(F.size(parsed) > 0, parsed).otherwise(F.raise_error(message).cast("array<variant>"))
    keep = [c for c in submissions.columns if c != items]
    return (
        submissions.withColumn("_items", parsed)
        .select(*keep, F.posexplode("_items").alias("pos", "_item"))
        .select(*keep, F.col("pos").cast("long").alias("pos"), F.to_json("_item").alias("item"))
    )


def reject_oversize(
    items: DataFrame, body: str = "body", max_bytes: int = MAX_MESSAGE_BYTES, mode: str = "fail", escape_html: bool = False
) -> DataFrame:
    """Measure items in UTF-8 bytes against the message limit.

    ``fail`` raises on the first oversized item; ``reject`` keeps every row and adds
    ``bytes`` and ``accepted``. ``escape_html`` counts ``<``, ``>``, ``&`` as six bytes
    each, as a JSON encoder that escapes HTML writes them.
    """
    size: Column = F.octet_length(body)
    if escape_html:
        size = size + 5 * (F.length(body) - F.length(F.translate(F.col(body), "<>&", "")))
    sized = items.withColumn("bytes", size.cast("long")).withColumn("accepted", F.col("bytes") <= max_bytes)
    if mode == "reject":
        return sized
    message = F.concat(F.lit("item size "), F.col("bytes").cast("string"), F.lit(f" exceeds the limit of {max_bytes}"))
    return sized.filter(_or_fail(F.col("accepted"), message))


def _or_fail(holds: Column, message: Column) -> Column:
    """A filter condition that fails the job where it does not hold. As a filter it is evaluated
    whatever columns are read later."""
    return F.when(holds, True).otherwise(F.raise_error(message).cast("boolean"))


def read_ndjson(spark: SparkSession, paths: str | list[str], on_error: str = "fail") -> DataFrame:
    """One row per line: ``file, item_index, item, valid``; the index restarts in each file (:func:`ranges.read_lines`)."""
    out = ranges.read_lines(spark, paths).select(
        "file", "item_index", F.col("line").alias("item"), F.try_parse_json("line").isNotNull().alias("valid")
    )
    return _check_valid(out, on_error)


def _check_valid(items: DataFrame, on_error: str) -> DataFrame:
    if on_error == "flag":
        return items
    message = F.concat(F.lit("item "), F.col("item_index").cast("string"), F.lit(" of "), F.col("file"))
    return items.filter(_or_fail(F.col("valid"), message))


def read_json_stream(spark: SparkSession, paths: str | list[str], on_error: str = "fail") -> DataFrame:
    """As :func:`read_ndjson`, for values that share a line or span several (:func:`ranges.read_values`).

    A value that is never closed costs its own group of lines and the values after it are read. The size of a value
    doesn't matter here, whatever its layout.
    """
    return _check_valid(ranges.read_values(spark, paths), on_error)
