"""Time-series operators over samples: rates, windows, instant values, histograms, vector maths.

Samples have label columns, ``ts`` (NTZ timestamp, UTC) and ``value``. Operators evaluate on
a grid of times, multiples of ``step_s`` since the epoch, and return ``ts`` as the grid time.
Ranges are closed at both ends. Series are cut into time chunks wherever order matters, so a
busy series is never held by one task; everything else is a mergeable aggregate. Samples are first
reduced to panes, the pieces between the times where a range can begin or end; only panes are
multiplied by the evaluation times that see them. Of samples of a series at one time, the largest
value counts as the last and the smallest as the first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numeric import INF, NAN, ieee_div

MICROS = 1_000_000
DAY = 86_400 * MICROS
LOOKBACK_S = 300
# Default histogram bounds in seconds.
DEFAULT_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def micros(ts: str | Column) -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")



def pane(us: Column, range_s: float, step_s: float) -> Column:
    """The pane of a sample, in time order: even for the instants where a range may begin or end, odd for what lies between."""
    width = math.gcd(int(range_s * MICROS), int(step_s * MICROS))
    end = us + F.pmod(-us, F.lit(width))
    return 2 * end - (us != end).cast("long")


def pane_times(part: Column, range_s: float, step_s: float) -> Column:
    """Grid times whose trailing range holds a :func:`pane`."""
    step, reach = int(step_s * MICROS), int(range_s * MICROS)
    between = F.pmod(part, F.lit(2))
    end = F.shiftright(part + between, 1)
    latest = end + reach - between * math.gcd(reach, step)
    first, last = end + F.pmod(-end, F.lit(step)), latest - F.pmod(latest, F.lit(step))
    return F.when(first <= last, F.sequence(first, last, F.lit(step)))


def with_context(df: DataFrame, us: Column, horizon_s: float, chunk_s: float | None = None) -> DataFrame:
    """Assign rows to time chunks and lend each chunk the rows of the ``horizon_s`` before it.

    Adds ``_chunk`` and ``_lent``. Work by key and chunk, look back at most ``horizon_s``, then
    drop lent rows. Chunks are sixteen horizons long but at most a day (or four horizons): short
    enough to spread a busy series, long enough that few rows are lent.
    """
    horizon = int(horizon_s * MICROS)
    width = max(int(chunk_s * MICROS), horizon) if chunk_s else min(16 * horizon, max(4 * horizon, DAY))
    own = us - F.pmod(us, F.lit(width))
    lend = (us + horizon) >= own + width
    places = F.array_compact(
        F.array(
            F.struct(own.alias("c"), F.lit(False).alias("lent")),
            F.when(lend, F.struct((own + width).alias("c"), F.lit(True).alias("lent"))),
        )
    )
    return (
        df.withColumn("_place", F.explode(places))
        .withColumn("_chunk", F.col("_place.c"))
        .withColumn("_lent", F.col("_place.lent"))
        .drop("_place")
    )


def rate(
    samples: DataFrame, labels: Sequence[str], range_s: float, step_s: float, kind: str = "rate", tasks: int | None = None
) -> DataFrame:
    """Per-second ``rate`` (or total ``increase``) of counters over a trailing range.

    Resets are corrected, at least two samples are needed, and the increase is extrapolated to
    the range's ends: all the way if the gap is below 1.1 mean intervals, else by half an
    interval, and never to below a zero counter.

    The samples of a series and chunk are sorted in one task; ``tasks`` deals them to so many, else the number is Spark's.
    """
    labels = list(labels)
    reach = int(range_s * MICROS)
    raw = samples.select(*labels, micros("ts").alias("_us"), F.col("value").cast("double").alias("_v"))
    order = Window.partitionBy(*labels, "_chunk").orderBy("_us", "_v")
    placed = with_context(raw, F.col("_us"), range_s)
    if tasks:
        placed = placed.repartition(tasks, *labels, "_chunk")
    steps = (
        placed.withColumn("_prev_us", F.lag("_us").over(order))
        .withColumn("_prev_v", F.lag("_v").over(order))
        .filter(~F.col("_lent"))
    )
    grew = F.when(F.col("_v") < F.col("_prev_v"), F.col("_v")).otherwise(F.col("_v") - F.col("_prev_v"))
    part = pane(F.col("_us"), range_s, step_s)
    within = F.coalesce(pane(F.col("_prev_us"), range_s, step_s) == F.col("_part"), F.lit(False))
    inside = F.when(within, F.col("_grew"))
    # A pane's first sample is the one that doesn't follow another of the pane: flat values, which are aggregated without sorting.
    first = {name: F.max(F.when(~within, F.col(name))).alias(name) for name in ("_us", "_v", "_prev_us", "_grew")}
    panes = (
        steps.select(*labels, "_us", "_v", "_prev_us", grew.alias("_grew"), part.alias("_part"))
        .groupBy(*labels, "_part")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("_us").alias("last"),
            F.sum(inside).alias("inside"),
            # The first sample, with its growth since the last one of an earlier pane.
            *first.values(),
        )
        .select(*labels, "_part", "n", "last", "inside", F.struct(*first).alias("first"))
    )
    border = F.when(F.col("first._prev_us") >= F.col("_at") - reach, F.col("first._grew"))
    windows = (
        panes.withColumn("_at", F.explode(pane_times(F.col("_part"), range_s, step_s)))
        .withColumn("border", border)
        .groupBy(*labels, "_at")
        .agg(
            F.sum("n").alias("n"),
            F.min("first._us").alias("first"),
            F.max("last").alias("last"),
            F.min(F.struct("first._us", "first._v"))["_v"].alias("first_v"),
            (F.coalesce(F.sum("inside"), F.lit(0.0)) + F.coalesce(F.sum("border"), F.lit(0.0))).alias("grew"),
        )
        .filter((F.col("n") >= 2) & (F.col("last") > F.col("first")))
    )

    def seconds(column: Column) -> Column:
        return column.cast("double") / MICROS

    sampled = seconds(F.col("last") - F.col("first"))
    mean_gap = sampled / (F.col("n") - 1)
    to_start = seconds(F.col("first") - (F.col("_at") - reach))
    to_end = seconds(F.col("_at") - F.col("last"))
    to_zero = sampled * ieee_div(F.col("first_v"), F.col("grew"))
    counts_up = (F.col("grew") > 0) & (F.col("first_v") >= 0)
    to_start = F.when(counts_up & (to_zero < to_start), to_zero).otherwise(to_start)
    spread = (
        sampled
        + F.when(to_start < mean_gap * 1.1, to_start).otherwise(mean_gap / 2)
        + F.when(to_end < mean_gap * 1.1, to_end).otherwise(mean_gap / 2)
    )
    value = F.col("grew") * (spread / sampled)
    if kind == "rate":
        value = value / float(range_s)
    elif kind != "increase":
        raise ValueError("kind must be rate or increase")
    return windows.select(*labels, from_micros(F.col("_at")).alias("ts"), value.alias("value"))


def over_time(samples: DataFrame, labels: Sequence[str], range_s: float, step_s: float) -> DataFrame:
    """Sum, count, mean, min and max per series over a trailing range."""
    value = F.col("value").cast("double")
    part = pane(micros("ts"), range_s, step_s)
    panes = (
        samples.select(*labels, part.alias("_part"), value.alias("_v"))
        .groupBy(*labels, "_part")
        .agg(F.sum("_v").alias("s"), F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    )
    return (
        panes.withColumn("_at", F.explode(pane_times(F.col("_part"), range_s, step_s)))
        .groupBy(*labels, "_at")
        .agg(F.sum("s").alias("sum_v"), F.sum("n").alias("count_v"), F.min("low").alias("min_v"), F.max("high").alias("max_v"))
        .select(
            *labels,
            "sum_v",
            "count_v",
            F.when(F.col("count_v") > 0, F.col("sum_v") / F.col("count_v")).alias("avg_v"),
            "min_v",
            "max_v",
            from_micros(F.col("_at")).alias("ts"),
        )
    )


def instant(samples: DataFrame, labels: Sequence[str], step_s: float, lookback_s: float = LOOKBACK_S) -> DataFrame:
    """Value of each series at every grid time: its last sample within ``lookback_s``."""
    panes = (
        samples.select(*labels, micros("ts").alias("_us"), F.col("value").cast("double").alias("_v"))
        .groupBy(*labels, pane(F.col("_us"), lookback_s, step_s).alias("_part"))
        .agg(F.max(F.struct("_us", "_v")).alias("last"))
    )
    return (
        panes.withColumn("_at", F.explode(pane_times(F.col("_part"), lookback_s, step_s)))
        .groupBy(*labels, "_at")
        .agg(F.max("last")["_v"].alias("value"))
        .select(*labels, from_micros(F.col("_at")).alias("ts"), "value")
    )


def instant_at(samples: DataFrame, labels: Sequence[str], at: Column, lookback_s: float = LOOKBACK_S) -> DataFrame:
    """Value of each series at one time; the time bound reaches the scan."""
    oldest = at - F.make_dt_interval(secs=F.lit(float(lookback_s)))
    recent = samples.filter((F.col("ts") <= at) & (F.col("ts") >= oldest))
    return recent.groupBy(*labels).agg(F.max(F.struct("ts", "value"))["value"].alias("value"), F.max("ts").alias("sample_ts"))


def as_of(
    points: DataFrame, samples: DataFrame, labels: Sequence[str], lookback_s: float = LOOKBACK_S
) -> DataFrame:
    """For each point (labels, ts, other columns) the last sample at or before it within the lookback.

    Points and samples are merged and read in time order, chunk by chunk; no pairs are formed.
    """
    labels = list(labels)
    kept = [c for c in points.columns if c not in (*labels, "ts")]
    left = points.select(
        *labels, "ts", F.struct(*[F.col(c) for c in kept] or [F.lit(1).alias("one")]).alias("_point"), F.lit(None).cast("double").alias("_v")
    )
    nothing = F.when(F.lit(False), F.struct(*[F.col(c) for c in kept] or [F.lit(1).alias("one")]))
    empty = points.select(nothing.alias("_p")).schema["_p"].dataType
    right = samples.select(
        *labels, "ts", F.lit(None).cast(empty).alias("_point"), F.col("value").cast("double").alias("_v")
    )
    merged = left.unionByName(right).withColumn("_us", micros("ts"))
    seen = F.when(F.col("_point").isNull(), F.struct("_us", "_v"))
    # At equal times samples come first.
    order = Window.partitionBy(*labels, "_chunk").orderBy("_us", F.col("_point").isNotNull(), "_v")
    placed = (
        with_context(merged, F.col("_us"), lookback_s)
        .withColumn("_last", F.last(seen, ignorenulls=True).over(order))
        .filter(~F.col("_lent") & F.col("_point").isNotNull())
    )
    fresh = F.col("_last._us") >= F.col("_us") - int(lookback_s * MICROS)
    return placed.select(
        *labels,
        "ts",
        *[F.col(f"_point.{c}").alias(c) for c in kept],
        F.when(fresh, F.col("_last._v")).alias("value"),
    )


def avg_in_flight(
    samples: DataFrame, window_s: int = 60, step_s: int = 10, not_counted: Column | None = None, extra: Sequence[str] = ()
) -> DataFrame:
    """Mean in-flight load per API: sum of the series' sums over the largest count of one series.

    Series are (api_name, pod, *extra). ``not_counted`` marks series left out of the count only.
    """
    windows = over_time(samples, ["api_name", "pod", *extra], window_s, step_s)
    counted = F.col("count_v") if not_counted is None else F.when(~not_counted, F.col("count_v"))
    return (
        windows.groupBy("api_name", "ts")
        .agg(F.sum("sum_v").alias("_sum"), F.max(counted).alias("_n"))
        .filter(F.col("_n").isNotNull())
        .select("api_name", "ts", ieee_div(F.col("_sum"), F.col("_n")).alias("value"))
    )


def sample_in_flight(samples: DataFrame, keys: Sequence[str], interval_s: int = 10) -> DataFrame:
    """Mean per report interval, from a series' first to its last one; empty intervals report 0."""
    keys = list(keys)
    width = interval_s * MICROS
    us = micros("ts")
    slots = samples.groupBy(*keys, (us - F.pmod(us, F.lit(width))).alias("_slot")).agg(
        F.avg(F.col("value").cast("double")).alias("_mean")
    )
    spine = (
        slots.groupBy(*keys)
        .agg(F.min("_slot").alias("a"), F.max("_slot").alias("b"))
        .select(*keys, F.explode(F.sequence("a", "b", F.lit(width))).alias("_slot"))
    )
    return spine.join(slots, [*keys, "_slot"], "left").select(
        *keys, from_micros(F.col("_slot")).alias("ts"), F.coalesce("_mean", F.lit(0.0)).alias("value")
    )


def aggregate_by(samples: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Sum, count, mean, min and max of the series in each label group."""
    return samples.groupBy(*by).agg(
        F.sum(value).alias("sum_v"),
        F.count(value).alias("count_v"),
        F.avg(value).alias("avg_v"),
        F.min(value).alias("min_v"),
        F.max(value).alias("max_v"),
    )


def aggregate_without(
    samples: DataFrame, labels: Sequence[str], without: Sequence[str], keep: Sequence[str] = ("ts",), value: str = "value"
) -> DataFrame:
    """As :func:`aggregate_by`, over all labels but the named ones."""
    return aggregate_by(samples, [*[label for label in labels if label not in without], *keep], value)


def histogram(
    events: DataFrame, labels: Sequence[str], value: str, buckets: Sequence[float] = DEFAULT_BUCKETS
) -> DataFrame:
    """Cumulative counts per bound (``le``; infinity counts all), with count and sum, per label set.

    All bounds are counted in one pass; rows are not multiplied before the shuffle.
    """
    bounds = [*sorted(buckets), INF]
    counts = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    totals = events.groupBy(*labels).agg(*counts, F.count(value).alias("count"), F.sum(value).alias("sum"))
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_b{i}").alias("c")) for i, b in enumerate(bounds)])
    return totals.select(*labels, "count", "sum", F.inline(pairs).alias("le", "bucket_count"))


def histogram_quantiles(
    wanted: dict[str, float], buckets: DataFrame, by: Sequence[str], value: str = "value", name: str = "quantile"
) -> DataFrame:
    """Quantiles per label set from cumulative bucket counts (``le`` as double), linear within a bucket.

    The first bucket starts at 0; a quantile in the infinite bucket gives the last finite bound;
    no observations, or no infinite bucket, give NaN. A group holds one entry per bound, and all
    quantiles are read off the same groups: one row per label set and ``name``.
    """
    sums = buckets.groupBy(*by, "le").agg(F.sum(F.col(value).cast("double")).alias("c"))
    entries = F.sort_array(F.collect_list(F.struct("le", "c")))
    # Counts may dip through scrape races: make them rise.
    rising = F.transform(
        "_e",
        lambda e, i: F.struct(
            e["le"].alias("le"), F.array_max(F.transform(F.slice("_e", 1, i + 1), lambda x: x["c"])).alias("c")
        ),
    )
    asked = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in wanted.items()])
    total = F.element_at("_e", -1)["c"]
    below = F.size(F.filter(F.slice("_e", 1, F.greatest(F.col("_n") - 1, F.lit(0))), lambda e: e["c"] < F.col("_rank")))
    grouped = (
        sums.groupBy(*by)
        .agg(entries.alias("_e"))
        .withColumn("_e", rising)
        .withColumn("_n", F.size("_e"))
        .withColumn("_asked", F.explode(asked))
        .withColumn("_rank", F.col("_asked.q") * total)
        .withColumn("_i", below)
    )
    here, before = F.get("_e", F.col("_i")), F.get("_e", F.col("_i") - 1)
    start = F.when(F.col("_i") > 0, before["le"]).otherwise(0.0)
    counted = F.when(F.col("_i") > 0, before["c"]).otherwise(0.0)
    inside = start + (here["le"] - start) * ieee_div(F.col("_rank") - counted, here["c"] - counted)
    quantile = (
        F.when(F.col("_asked.q") < 0, F.lit(-INF))
        .when(F.col("_asked.q") > 1, F.lit(INF))
        .when((F.element_at("_e", -1)["le"] != INF) | (F.col("_n") < 2) | (total == 0), F.lit(NAN))
        .when(F.col("_i") == F.col("_n") - 1, F.get("_e", F.col("_n") - 2)["le"])
        .when((F.col("_i") == 0) & (here["le"] <= 0), here["le"])
        .otherwise(inside)
    )
    return grouped.select(*by, F.col("_asked.name").alias(name), quantile.alias("value"))


def histogram_quantile(q: float, buckets: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """One quantile per label set; see :func:`histogram_quantiles`."""
    return histogram_quantiles({"q": q}, buckets, by, value).drop("quantile")


OPERATORS = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": ieee_div,
}


def vector_op(left: DataFrame, right: DataFrame, op: str, on: Sequence[str], value: str = "value") -> DataFrame:
    """One-to-one arithmetic on equal labels; rows without a partner drop out."""
    a, b = left.select(*on, F.col(value).alias("_a")), right.select(*on, F.col(value).alias("_b"))
    return a.join(b, list(on)).select(*on, OPERATORS[op](F.col("_a"), F.col("_b")).alias(value))


def vector_op_group_left(many: DataFrame, one: DataFrame, op: str, on: Sequence[str], value: str = "value") -> DataFrame:
    """Many-to-one arithmetic; ``on`` are the labels both sides share, the many side keeps its own."""
    other = one.select(*on, F.col(value).alias("_b"))
    kept = [c for c in many.columns if c != value]
    return many.join(other, list(on)).select(*kept, OPERATORS[op](F.col(value), F.col("_b")).alias(value))


def scalar_op(vector: DataFrame, scalar: DataFrame, op: str, on: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Arithmetic with one number (``scalar`` has one row), or one per evaluation time (``on``)."""
    other = scalar.select(*on, F.col(value).alias("_b"))
    joined = vector.join(other, list(on)) if on else vector.withColumn("_b", other.scalar())
    return joined.select(
        *[c for c in vector.columns if c != value], OPERATORS[op](F.col(value), F.col("_b")).alias(value)
    )


def threshold_alerts(metric: DataFrame, bound: float | DataFrame, on: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Rows above a fixed bound, or above the value of another series with the same labels."""
    if isinstance(bound, DataFrame):
        other = bound.select(*on, F.col(value).alias("bound"))
        return metric.join(other, list(on)).filter(F.col(value) > F.col("bound"))
    return metric.filter(F.col(value) > bound).withColumn("bound", F.lit(float(bound)))
