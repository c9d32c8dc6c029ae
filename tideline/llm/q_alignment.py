"""Query of the alignment of two tokenizers."""

from __future__ import annotations

import public_tokenizers

from tideline.llm import alignment
from tideline.llm.registry import query, table


def tokenizers() -> alignment.Pair:
    path = public_tokenizers.path
    return alignment.pair_of(path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


@query("op12_tokenizer_spans")
def op12(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", tokenizers())
