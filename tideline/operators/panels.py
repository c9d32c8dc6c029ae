"""Dashboard panels: many aggregates over the same vectors in one pass.

A board is a list of :class:`Term` (an aggregate of selected series) and formulas over terms.
All terms of a board share one scan and one shuffle: each row is tagged with the terms it
belongs to, and the groups are small enough to be lined up by series and time afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.timeseries import aggregate_by, histogram_quantiles, instant, over_time, rate


@dataclass(frozen=True)
class Term:
    """``agg`` (sum, count, avg, max) of the rows of one ``form`` that satisfy ``where``, by labels.

    ``where`` is a SQL predicate on metric, labels and value.
    """

    name: str
    form: str
    where: str
    by: Sequence[str] = ()
    agg: str = "sum"


def vectors(
    samples: DataFrame,
    labels: Sequence[str],
    counters: Sequence[str],
    gauges: Sequence[str],
    ranged: Sequence[str],
    range_s: float,
    step_s: float,
    lookback_s: float,
    tasks: int | None = None,
) -> DataFrame:
    """Rates of counters, instant values of gauges, and sums and counts over the range, by ``form``.

    ``tasks`` is that of :func:`~tideline.operators.timeseries.rate`.
    """
    series = ["metric", *labels]
    picked = lambda names: samples.filter(F.col("metric").isin(list(names)))
    out = []
    if counters:
        out.append(rate(picked(counters), series, range_s, step_s, tasks=tasks).withColumn("form", F.lit("rate")))
    if gauges:
        out.append(instant(picked(gauges), series, step_s, lookback_s).withColumn("form", F.lit("instant")))
    if ranged:
        windows = over_time(picked(ranged), series, range_s, step_s)
        both = F.array(
            F.struct(F.lit("sum_over_time").alias("form"), F.col("sum_v").alias("value")),
            F.struct(F.lit("count_over_time").alias("form"), F.col("count_v").cast("double").alias("value")),
        )
        out.append(windows.select(*series, "ts", F.inline(both)))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def series_name(by: Sequence[str]) -> Column:
    """``label=value`` pairs as one text."""
    return F.concat_ws(",", *[F.concat(F.lit(f"{label}="), F.col(label)) for label in by])


def evaluate(rows: DataFrame, terms: Sequence[Term]) -> DataFrame:
    """``term, series, ts, value`` for all terms at once."""
    tags = [
        F.when(
            (F.col("form") == t.form) & F.expr(t.where),
            F.struct(F.lit(t.name).alias("term"), F.lit(t.agg).alias("agg"), series_name(t.by).alias("series")),
        )
        for t in terms
    ]
    tagged = rows.withColumn("_tag", F.explode(F.array_compact(F.array(*tags))))
    sums = aggregate_by(tagged.select("_tag.*", "ts", "value"), ["term", "agg", "series", "ts"])
    value = (
        F.when(F.col("agg") == "sum", F.col("sum_v"))
        .when(F.col("agg") == "count", F.col("count_v").cast("double"))
        .when(F.col("agg") == "avg", F.col("avg_v"))
        .otherwise(F.col("max_v"))
    )
    return sums.select("term", "series", "ts", value.alias("value"))


def over(a: str, b: str) -> str:
    """SQL text of ``a / b`` on doubles as metric queries divide: x/0 is infinite, 0/0 is not a number."""
    a, b = f"CAST(({a}) AS DOUBLE)", f"CAST(({b}) AS DOUBLE)"
    by_zero = (
        f"CASE WHEN isnan({a}) OR {a} = 0 THEN CAST('NaN' AS DOUBLE) WHEN {a} > 0 THEN CAST('Infinity' AS DOUBLE)"
        f" WHEN {a} < 0 THEN CAST('-Infinity' AS DOUBLE) END"
    )
    return f"(CASE WHEN {b} = 0 THEN {by_zero} ELSE try_divide({a}, {b}) END)"


def formulas(terms: DataFrame, names: Sequence[str], panels: dict[str, str]) -> DataFrame:
    """``panel, series, ts, value``: arithmetic over terms with the same series and time.

    A panel is a SQL expression over the term ``names``, with :func:`over` for divisions; it has no value
    where a term is missing.
    """
    lined = terms.groupBy("series", "ts").agg(
        *[F.max(F.when(F.col("term") == n, F.col("value"))).alias(n) for n in names]
    )
    rows = [
        F.struct(F.lit(panel).alias("panel"), F.expr(expression).cast("double").alias("value"))
        for panel, expression in panels.items()
    ]
    return lined.select("series", "ts", F.inline(F.array(*rows))).filter(F.col("value").isNotNull())


def quantiles(rows: DataFrame, where: str, by: Sequence[str], wanted: dict[str, float], le: str = "le") -> DataFrame:
    """``panel, series, ts, value`` of quantiles over the rates of histogram buckets."""
    bound = F.when(F.col(le) == "+Inf", float("inf")).otherwise(F.col(le).try_cast("double"))
    buckets = (
        rows.filter((F.col("form") == "rate") & F.expr(where))
        .withColumn("le", bound)
        .withColumn("series", series_name(by))
        .groupBy("series", "ts", "le")
        .agg(F.sum("value").alias("value"))
    )
    found = histogram_quantiles(wanted, buckets, ["series", "ts"], name="panel")
    return found.select("panel", "series", "ts", "value")
