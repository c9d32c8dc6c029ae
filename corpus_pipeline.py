"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last
return the columns of ``documents``. Toxic documents go, of near copies one stays, documents that hold benchmark
items go, secrets are blotted out, and what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontam, minhash, q_packing, secrets, toxicity
from tideline.llm.registry import table
from tideline.session import bound_batches, materialise


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar doesn't reject; ``labels`` of training rows teach it. Null keys are judged too."""
    bound_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, labels, "doc_id", "text", "toxic", toxicity.training_row("doc_id"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 of five-word shingles: that of the smallest doc_id.

    Texts under one doc_id are judged each, by a 64-bit hash of both; of rows that repeat a doc_id and its text one
    stays if the text does. Rows without a doc_id all stay.
    """
    bound_batches(spark)
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    named, nameless = keyed.filter("doc_id is not null"), docs.filter("doc_id is null")
    found = minhash.near_duplicates(named, "_key", "text").select("_key", "component_id").distinct()
    groups = found.join(named.select("_key", "doc_id").distinct(), "_key").groupBy("component_id")
    kept = groups.agg(F.min(F.struct("doc_id", "_key")).alias("row")).select(F.col("row._key").alias("_key"))
    return named.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns).unionByName(nameless)


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which tiles cover less than half of every benchmark item; each text is judged, whatever its doc_id."""
    bound_batches(spark)
    texts = docs.withColumn("_text", F.sha2("text", 256))
    found = decontam.leaks(texts.select("_text", "text"), "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return texts.join(found.select("_text").distinct(), "_text", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars counted anew where that changed a text."""
    bound_batches(spark)
    marked = secrets.redact(docs.withColumn("_before", F.col("text")), "text")
    changed = ~F.col("text").eqNullSafe(F.col("_before"))
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return marked.withColumn("n_chars", n_chars).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, in sequences of 2048."""
    bound_batches(spark)
    return q_packing.packed(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_copies),
    ("decontamination", leaked),
    ("secrets", without_secrets),
    ("packing", sequences),
]

#: No SQL tells a trained grammar's verdicts or a tokenizer's ids; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
