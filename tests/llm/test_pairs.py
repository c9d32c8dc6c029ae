"""MinHash, components, decontamination and suffix arrays against brute force."""

import random
import sys
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(__file__))
import helpers as h  # noqa: E402

from tideline.llm import decontam, gsaca, minhash, suffix  # noqa: E402
from tideline.llm.catalog import QUERIES  # noqa: E402
from tideline.llm.components import connected_components  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 50)] + [(9000, 9000), (None, 3), (1, 0)]
    random.Random(3).shuffle(links)
    got = dict(connected_components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect())
    assert got == {**{i: 0 for i in range(201)}, **{i: 500 for i in range(500, 550)}, 9000: 9000}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []


def test_minhash_query(spark):
    docs = h.documents(spark, SF)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_minhash_components"](spark, SF).collect()}
    assert got == h.near_components(list(docs.doc_id), list(docs.text), 3, 85)


def edited_family(seed, n=60):
    """A chain of texts, each an edit of the last: neighbours are linked, the ends are far apart."""
    draw = random.Random(seed)
    words = [f"w{draw.randrange(300)}" for _ in range(80)]
    out = []
    for _ in range(n):
        words = list(words)
        words[draw.randrange(80)] = f"x{draw.randrange(10_000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_minhash_chain_and_small_blocks(spark, block):
    texts = edited_family(1) + edited_family(2) + ["lone text of its own"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = minhash.near_duplicates(docs, "doc_id", "text", size=3, percent=85, block=block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == h.near_components(list(range(len(texts))), texts, 3, 85)


def test_minhash_odd_rows(spark):
    rows = minhash.near_duplicates(h.odd_documents(spark), "doc_id", "text").collect()
    assert len(rows) == 13
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by[i].component_id for i in range(10)] == [0, 1, 2, 3, 4, 5, 5, 7, 7, 9]
    assert [by[i].n_shingles for i in range(7)] == [0, 0, 0, 1, 1, 1, 1]
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert minhash.near_duplicates(h.empty_documents(spark), "doc_id", "text").collect() == []


def covered(item, text, least):
    return sum(k for _, _, k in decontam.tiles(np.array(item, np.uint64), np.array(text, np.uint64), least))


def slow_tiling(item, text, least):
    """Greedy string tiling by trying all pairs; the covered words of the item."""
    free_i, free_t = [True] * len(item), [True] * len(text)
    total = 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                k = 0
                while i + k < len(item) and t + k < len(text) and item[i + k] == text[t + k] and free_i[i + k] and free_t[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, t)
        k, i, t = best
        if k < least:
            return total
        total += k
        free_i[i : i + k] = [False] * k
        free_t[t : t + k] = [False] * k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=25), st.lists(st.integers(1, 4), max_size=40))
def test_tiles_are_common_and_apart(item, text):
    laid = decontam.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3)
    seen_i, seen_t = set(), set()
    for i, t, k in laid:
        assert k >= 3 and item[i : i + k] == text[t : t + k]
        assert not seen_i & set(range(i, i + k)) and not seen_t & set(range(t, t + k))
        seen_i |= set(range(i, i + k))
        seen_t |= set(range(t, t + k))
    marked_i = [x if n not in seen_i else -1 for n, x in enumerate(item)]
    marked_t = [x if n not in seen_t else -2 for n, x in enumerate(text)]
    assert slow_tiling(marked_i, marked_t, 3) == 0  # nothing long enough is left


def test_tiles_of_reordered_passage():
    item = list(range(1, 31))
    text = item[20:] + [99] * 5 + item[:10] + [98] + item[10:20]
    assert covered(item, text, 5) == slow_tiling(item, text, 5) == 30


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_leaks(spark, broadcast):
    first = " ".join(f"a{i}" for i in range(20))
    second = " ".join(f"b{i}" for i in range(30))
    halves = second.split()
    docs = [
        (1, f"before {first.upper()}, after"),
        (2, " ".join(["x", *halves[15:], "y", "z", *halves[:15]])),
        (3, " ".join(halves[:9])),
        (4, "nothing of interest"),
        (5, first + " . " + second),
        (5, first + " . " + second),
        (None, first),
        (6, None),
        (7, ""),
    ]
    items = [(10, first), (11, second), (12, "too short"), (13, None), (None, first), (14, "")]
    found = decontam.leaks(
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'mine' as item", "1 as coverage"),
        "text",
        spark.createDataFrame(items, "item_id long, text string"),
        "item_id",
        "text",
        broadcast=broadcast,
    )
    got = sorted(((r.doc_id or 0, r["item"], r.coverage) for r in found.collect()))
    assert got == [(0, 10, 1.0), (1, 10, 1.0), (2, 11, 1.0), (5, 10, 1.0), (5, 10, 1.0), (5, 11, 1.0), (5, 11, 1.0)]


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_leaks_of_items_that_repeat_themselves(spark, broadcast):
    same = " ".join(["la"] * 12)
    refrain = " ".join(f"r{i % 5}" for i in range(59))
    partly = " ".join(["na"] * 30 + [f"p{i}" for i in range(28)])
    docs = [(1, same), (2, f"so {refrain} it goes"), (3, " ".join(["na"] * 30)), (4, "la " * 4), (5, " ".join(["na"] * 28))]
    found = decontam.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        "text",
        spark.createDataFrame([(10, same), (11, refrain), (12, partly)], "item_id long, text string"),
        "item_id",
        "text",
        broadcast=broadcast,
    )
    got = sorted((r.doc_id, r["item"], r.covered_words) for r in found.collect())
    assert got == [(1, 10, 12), (2, 11, 59), (3, 12, 30)]


def test_tiles_of_long_repeats():
    assert covered([7] * 2_000, [7] * 30_000, 5) == 2_000
    assert covered([1, 2, 3] * 500, [9, *[1, 2, 3] * 400, 8, *[1, 2, 3] * 400], 5) == 1_500


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=25), st.lists(st.integers(1, 3), max_size=40))
def test_tiles_longest_first(item, text):
    assert covered(item, text, 3) == slow_tiling(item, text, 3)


def test_leaks_of_nothing(spark):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontam.leaks(h.empty_documents(spark), "text", items, "item_id", "text").collect() == []
    assert decontam.leaks(h.odd_documents(spark), "text", items.limit(0), "item_id", "text").collect() == []
    assert decontam.leaks(h.odd_documents(spark), "text", items, "item_id", "text").collect() == []


def test_leaks_query(spark):
    docs, items = h.documents(spark, SF), h.documents(spark, SF, "benchmark")
    want = set()
    sets = {i: [w for w in decontam.WORD.findall(t.lower())] for i, t in zip(items.item_id, items.text)}
    for doc, text in zip(docs.doc_id, docs.text):
        words = decontam.WORD.findall((text or "").lower())
        for item, wanted in sets.items():
            grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
            if sum(tuple(wanted[k : k + 5]) in grams for k in range(len(wanted) - 4)) * 5 >= len(wanted) / 2:
                if slow_tiling(wanted, words, 5) >= len(wanted) / 2:
                    want.add((doc, item))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_tiled_leaks"](spark, SF).collect()}
    assert got == want and got


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(symbols):
    text = [*symbols, 0]
    assert gsaca.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


REPEATS = ["a" * 90, "abc" * 40, None, "", "x" + "pq" * 30, "pq" * 30 + "y", "é" * 50, "short", "0123456789" * 3 + "!" + "pq" * 30]


@pytest.mark.parametrize("most", [1024, 1])
def test_repeats(spark, most):
    draw = random.Random(5)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(150))
    texts = [*REPEATS, *("".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(80))) + passage[draw.randrange(60) :] for _ in range(30))]
    texts += [passage, passage[:70], passage[80:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'mine' as kept")
    got = {r.doc_id: r for r in suffix.remove_repeats(docs, "text", length=40, gram=16, most=most).collect()}
    for i, (raw, mask) in enumerate(h.repeats(texts, 40)):
        assert bytes(got[i].kept) == bytes(b for b, m in zip(raw, mask) if not m), i
        runs = [(r.start, r.end) for r in got[i].removed]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
        assert runs == list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def test_repeats_odd_rows(spark):
    rows = suffix.remove_repeats(h.odd_documents(spark), "text").collect()
    assert len(rows) == 13
    assert {len(r.kept) for r in rows if r.text == h.LONG} == {0}
    assert all(r.n_bytes == 0 and not r.removed for r in rows if not r.text)
    assert suffix.remove_repeats(h.empty_documents(spark), "text").collect() == []


def test_pieces_of_a_long_text(monkeypatch):
    draw = random.Random(9)
    raw = "".join(draw.choice("abcd") for _ in range(5000)).encode()
    whole = [np.concatenate(x) for x in zip(*suffix.stretches(raw, 200, 32))]
    monkeypatch.setattr(suffix, "PIECE", 512)
    parts = [np.concatenate(x) for x in zip(*suffix.stretches(raw, 200, 32))]
    lead = lambda s: {(a, w): (h, a + o) for h, f, n, o in zip(*s) for a in [f] for w in range(n)}
    windows = lambda s: {f + k: f + o for h, f, n, o in zip(*s) for k in range(n)}
    assert windows(whole) == windows(parts) and len(lead(whole))


def test_anchors_come_to_the_driver_as_words_of_bits(spark, monkeypatch):
    draw = random.Random(7)
    numbers = [draw.getrandbits(64) - (1 << 63) & ~0xFFFF00 for _ in range(4000)] + [-1, (1 << 63) - 1, -(1 << 63)]
    anchors = spark.createDataFrame([(x,) for x in numbers], "anchor long")
    came, plain = [], type(anchors).toArrow
    monkeypatch.setattr(type(anchors), "toArrow", lambda self: came.append(plain(self)) or came[-1])
    monkeypatch.setattr(type(anchors), "toPandas", lambda self: pytest.fail("a row for each anchor"))
    want = np.zeros(1 << (suffix.SLOTS - 3), dtype=np.uint8)
    for x in numbers:
        want[(x & 0xFFFFFF) >> 3] |= 1 << (x & 7)
    assert (suffix._filter(anchors) == want).all() and not suffix._filter(anchors.limit(0)).any()
    assert came[0].num_rows == 5
    texts = ["a" * 30 + "".join(draw.choice("abcd") for _ in range(100)) for _ in range(20)]
    docs = spark.createDataFrame([(t + t[::-1],) for t in [*texts, texts[3][40:] + "b" * 60]], "text string")
    got = {r.text: bytes(r.kept) for r in suffix.remove_repeats(docs, "text", length=40, gram=16).collect()}
    assert got == {r.decode(): bytes(b for b, m in zip(r, mask) if not m) for r, mask in h.repeats([r.text for r in docs.collect()], 40)}
