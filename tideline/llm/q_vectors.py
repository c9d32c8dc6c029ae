"""Query of the operator on vectors."""

from __future__ import annotations

from tideline.llm import hnsw
from tideline.llm.registry import query, table


@query("op10_hnsw_components")
def op10(spark, sf_dir):
    return hnsw.links(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
