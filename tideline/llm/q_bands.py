"""Query of the quality rules."""

from __future__ import annotations

from tideline.llm import bands
from tideline.llm.registry import query, table


@query("op11_compression_bands")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bands.judge(docs, "text").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio",
        "n_chunks", "bad_share",
    )
