"""Query of the packing operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import packing
from tideline.llm.registry import query, table

#: Target token proportions of the mixture; all other sources share the rest.
WEIGHTS, REST = {"src0": 0.25, "src1": 0.05, "src2": 0.05, "src3": 0.05}, 0.6
LENGTH, WINDOW, END_ID = 2048, 64, 1


def encoder() -> packing.Encoder:
    path = public_tokenizers.path
    return packing.Encoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, "doc_id", "text", "source", WEIGHTS, REST, encoder(), LENGTH, WINDOW, END_ID)


@query("op3_mixture_packing")
def op3(spark, sf_dir):
    pieces = packed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id",
        "offset", "queue",
    )
