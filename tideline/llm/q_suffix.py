"""Query of the suffix-array operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.llm import suffix
from tideline.llm.registry import query, table


@query("op5_suffix_dedup")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix.remove_repeats(docs, "text", length=200)
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return cut.select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
