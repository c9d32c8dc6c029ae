"""Quality rules against plain loops, and bands against texts that must fall on either side."""

import base64
import os
import random
import re
import sys

import pytest
from hypothesis import given
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(__file__))
import helpers as h  # noqa: E402

from tideline.llm import bands  # noqa: E402
from tideline.llm.catalog import QUERIES  # noqa: E402


def plain(text):
    """The counts by definition, one window and one line at a time."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


def values(row):
    return tuple(row[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    want = {i: plain(t) for i, t in h.documents(spark, sf)[["doc_id", "text"]].itertuples(index=False)}
    rows = QUERIES["op11_compression_bands"](spark, sf).collect()
    assert {r.doc_id: values(r) for r in rows} == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    sound = [r for r in rows if not r.base_failed]
    assert sum(r.kept for r in sound) > 0.95 * len(sound)


@given(st.text(alphabet="ab#\n \t\x0b\x1c é", max_size=60))
def test_counts(text):
    assert bands.measure(text, bands.Bands())[:5] == plain(text)


def prose(n, seed=1):
    draw = random.Random(seed)
    syllables = ["ka", "ro", "len", "ti", "mus", "ver", "do", "sal", "pre", "ni", "ost", "ur", "gha", "be", "lin"]
    words = ["".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(800)]
    weights = [1 / (i + 3) for i in range(len(words))]
    return " ".join(draw.choices(words, weights, k=n))


@pytest.mark.parametrize("n", [60, 300, 3000, 30_000])
def test_prose_is_kept(n):
    assert bands.Bands().judge(prose(n).encode())[3]


@pytest.mark.parametrize("size", [400, 3000, 40_000])
def test_random_and_repeats_go(size):
    noise = base64.b64encode(random.Random(2).randbytes(size))
    assert not bands.Bands().judge(noise)[3]
    assert not bands.Bands().judge((prose(20) * (size // 40 + 4)).encode())[3]


def test_half_a_document_out_of_band():
    plain_half = prose(3000)
    noise = base64.b64encode(random.Random(3).randbytes(len(plain_half) * 3 // 4)).decode()
    ratio, n_chunks, share, kept = bands.Bands().judge((plain_half + noise).encode())
    assert not kept and 0.3 < share < 0.7 and bands.BANDS[3].low < ratio < bands.BANDS[3].high
    assert n_chunks == -(-len((plain_half + noise).encode()) // 4096)
    assert bands.Bands().judge(plain_half.encode())[2] == 0
    assert bands.Bands(share=0.9).judge((plain_half + noise).encode())[3]


def test_limits_follow_the_length():
    limits = (bands.Band(10, 0.5, 1.0), bands.Band(100, 1.0, 50.0))
    judge = bands.Bands(limits, chunk=1 << 20).judge
    assert judge(b"abc" * 3)[3]  # too short to tell
    assert not judge(b"a" * 90)[3]
    assert judge(b"a" * 110)[3]


def test_odd_rows(spark):
    docs = h.odd_documents(spark).withColumns({n: h_lit for n, h_lit in clash().items()})
    rows = bands.judge(docs, "text").collect()
    assert len(rows) == docs.count()
    assert all(values(r) == plain(r.text) for r in rows)
    assert all(r.base_failed and not r.kept and r.ratio is None for r in rows if not r.text)
    assert {r.source for r in rows} == {"src0", "src1", None} and {r.spans for r in rows} == {"mine"}
    assert bands.judge(h.empty_documents(spark), "text").collect() == []


def clash():
    from pyspark.sql import functions as F

    return {n: F.lit("mine") for n in [*bands.FIELDS, "base_failed", "_found"]}
