"""Request summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_summary(requests: DataFrame, until: Column, days: int = 14) -> DataFrame:
    """Mean request time and counts by status class per API, over the last two weeks."""
    recent = requests.filter(F.col("ts") > until - F.make_dt_interval(days=F.lit(days)))
    cls = F.floor(F.col("status_code") / 100)
    return recent.groupBy("api_name").agg(
        F.count_if(cls == 2).alias("n_2xx"),
        F.count_if(cls == 4).alias("n_4xx"),
        F.count_if(cls == 5).alias("n_5xx"),
        F.avg("duration_s").alias("mean_s"),
    )
