"""Container logs: parsing, normalising, labelling, and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS"
MAX_LINE_BYTES = 32 * 1024
DEFAULT_LIMIT = 1000
RECENT_SECONDS = 3600


def read_logs(lines: DataFrame, column: str = "line", max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Parse JSON log lines: adds ``too_long``, ``record`` (variant) and ``ts``; no line is dropped.

    The ``time`` field stays in the record. Lines that are no JSON keep a null record, and so do lines of more than
    ``max_bytes``, which are not parsed but flagged; :func:`skipped_lines` counts them.
    """
    too_long = F.coalesce(F.octet_length(column) > max_bytes, F.lit(False))
    read = lines.withColumn("too_long", too_long).withColumn(
        "record", F.when(F.col("too_long"), F.lit(None)).otherwise(F.try_parse_json(column))
    )
    time = F.try_variant_get("record", "$.time", "string")
    return read.withColumn("ts", F.try_to_timestamp(time, F.lit(TIME_FORMAT)).cast("timestamp_ntz"))


def skipped_lines(read: DataFrame, *by: str) -> DataFrame:
    """``lines``, ``skipped`` (over-long) and ``malformed`` of what :func:`read_logs` read, by the given columns."""
    long = F.col("too_long")
    return read.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(long).alias("skipped"),
        F.count_if(~long & F.col("record").isNull()).alias("malformed"),
    )


def _field(record: str, name: str) -> Column:
    """A text field of the JSON payload inside the record's ``log``, else of the record itself."""
    payload = F.try_parse_json(F.try_variant_get(record, "$.log", "string"))
    return F.coalesce(
        F.try_variant_get(payload, f"$.{name}", "string"), F.try_variant_get(record, f"$.{name}", "string")
    )


def normalise_logs(logs: DataFrame, record: str = "record") -> DataFrame:
    """One ``message`` and ``level`` per record.

    ``message`` and then ``msg`` are renamed to ``log`` over what is there, and ``log`` ends as
    ``message``, so ``msg`` wins over ``message``, and that over ``log``. ``levelname`` becomes
    ``level`` unless the record has one.
    """
    return logs.withColumns(
        {
            "message": F.coalesce(_field(record, "msg"), _field(record, "message"), _field(record, "log")),
            "level": F.coalesce(_field(record, "level"), _field(record, "levelname")),
        }
    )


def label_logs(logs: DataFrame, record: str = "record", metadata: str | None = None) -> DataFrame:
    """Labels of each record: its own, else those of its pod's metadata; events carry the labels of
    the object they involve. Adds ``labels`` (map) and drops the metadata."""
    own = F.try_variant_get(record, "$.labels", "map<string,string>")
    involved = F.try_variant_get(record, "$.involvedObject.labels", "map<string,string>")
    candidates = [involved, own]
    if metadata is not None:
        candidates.append(F.col(metadata)["labels"])
    labelled = logs.withColumn("labels", F.coalesce(*candidates))
    return labelled.drop(metadata) if metadata is not None else labelled


def query_logs(
    logs: DataFrame,
    api_name: str | None = None,
    kind: str | None = None,
    job_id: str | None = None,
    limit: int = DEFAULT_LIMIT,
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """The first ``limit`` records of an API, kind or job, by time. Spark keeps ``limit`` rows per task."""
    for label, wanted in (("apiName", api_name), ("apiKind", kind), ("jobID", job_id)):
        if wanted is not None:
            logs = logs.filter(F.try_element_at("labels", F.lit(label)) == wanted)
    return logs.orderBy("ts", *tiebreak).limit(limit)


def query_logs_range(
    logs: DataFrame, job_id: str, start: Column | None = None, end: Column | None = None, now: Column | None = None
) -> DataFrame:
    """A job's records between two times; a job in progress (no ``end``) shows the hour before ``now``."""
    found = logs.filter(F.try_element_at("labels", F.lit("jobID")) == job_id)
    if end is None:
        if now is None:
            raise ValueError("a job in progress needs now")
        start, end = now - F.make_dt_interval(secs=F.lit(RECENT_SECONDS)), now
    return found.filter((F.col("ts") >= start) & (F.col("ts") <= end))
