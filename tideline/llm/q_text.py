"""Queries of the operators that read each text on its own: secrets, toxicity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.llm import secrets, toxicity
from tideline.llm.registry import query, table


def _joined(spans: str) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op1_secret_layers")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, "text").select(
        "doc_id",
        *[_count(kind) for kind in secrets.KINDS],
        F.sha2(_joined("base_spans"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        "layers",
        "oversize",
    )


@query("op8_clause_toxicity")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = toxicity.score(docs, labels, "doc_id", "text", "toxic", toxicity.training_row("doc_id"))
    return scored.select(
        "doc_id",
        (~toxicity.training_row("doc_id")).alias("held_out"),
        "score",
        "predicted",
        "clauses",
    )
