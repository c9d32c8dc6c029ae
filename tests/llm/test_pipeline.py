"""The pipeline's stages, each on its own input, against brute force."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import helpers as h  # noqa: E402

import corpus_pipeline  # noqa: E402
from tideline.llm import decontam, secrets  # noqa: E402

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = h.documents(spark, SF)
    texts = dict(zip(rows.doc_id, rows.text))
    clean = STAGES["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns
    labels = h.documents(spark, SF, "labels")
    kept = {r.doc_id for r in clean.collect()}
    fine = set(labels.doc_id[labels.toxic == 0])
    assert len(fine & kept) >= 0.98 * len(fine) and kept < set(texts)

    single = {r.doc_id for r in STAGES["near_duplicates"](spark, docs, SF).collect()}
    assert single == {low for _, low in h.near_components(list(texts), list(texts.values()), 5, 80).values()}

    free = {r.doc_id for r in STAGES["decontamination"](spark, docs, SF).collect()}
    held = set()
    for item in h.documents(spark, SF, "benchmark").text:
        wanted = " ".join(decontam.WORD.findall(item.lower()))
        held |= {d for d, t in texts.items() if wanted in " ".join(decontam.WORD.findall(t.lower()))}
    assert free == set(texts) - held and held

    for r in STAGES["secrets"](spark, docs, SF).collect():
        spans = secrets._scan_one(texts[r.doc_id], 1 << 26)[1]
        assert ("[redacted]" in r.text) == bool(spans)
        assert spans or r.text == texts[r.doc_id]
        assert not spans or r.n_chars == len(r.text)


def test_run_is_the_chain(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(repr, out)) == sorted(map(repr, docs.collect()))


def test_stages_on_odd_rows(spark):
    odd = h.odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        n = out.count()
        assert n == (10 if name == "near_duplicates" else 13), name
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert STAGES["packing"](spark, odd, SF).count() >= 13


def test_rows_are_judged_not_keys(spark):
    item = h.documents(spark, SF, "benchmark").text.iloc[0]
    text = " ".join(f"w{i}" for i in range(40))
    other, third = " ".join(f"v{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    docs = spark.createDataFrame(
        [(None, item), (None, text), (1, item), (1, other), (2, text)], "doc_id long, text string"
    )
    got = sorted(((r.doc_id or 0, r.text) for r in STAGES["decontamination"](spark, docs, SF).collect()))
    assert got == [(0, text), (1, other), (2, text)]

    docs = spark.createDataFrame(
        [(1, text), (2, text + " end"), (2, other), (2, other), (3, third), (3, other), (None, text)], "doc_id long, text string"
    )
    got = sorted(((r.doc_id or 0, r.text) for r in STAGES["near_duplicates"](spark, docs, SF).collect()))
    assert got == [(0, text), (1, text), (2, other), (3, third)]
