"""Queries of the operators on pairs of documents: near duplicates, decontamination."""

from __future__ import annotations

from tideline.llm import decontam, minhash
from tideline.llm.registry import query, table


@query("op4_minhash_components")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, "doc_id", "text", size=3, percent=85)


@query("op6_tiled_leaks")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.leaks(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select(
        "doc_id", found["item"].alias("item_id"), "item_words", "covered_words", "n_tiles", "coverage"
    )
