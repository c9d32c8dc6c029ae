"""Aligned groups against byte ends of all tokens, and counts against plain dictionaries."""

import collections
import hashlib
import itertools
import os
import sys

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
import helpers as h  # noqa: E402

from tideline.llm import alignment, q_alignment  # noqa: E402
from tideline.llm.catalog import QUERIES  # noqa: E402

PAIR = q_alignment.tokenizers()
A = Tokenizer.from_file(PAIR.byte_level)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PAIR.pieces)
#: Mixed scripts, split characters, byte fallback, marks of the vocabularies, long runs.
TEXTS = [
    "plain words, and some more.", "日本語のテキスト", "h\u00e9llo 🤠🤠 x", "\u00ff\u0100\U0001f9d1\u200d\U0001f680", "a\u2581b", "<|endoftext|> <s> <unk>",
    "  two  spaces ", "\n\n\ttab\r\n", "=" * 300, " " * 200, "\x00\x01", "ｗｉｄｅ", "𝔘𝔫𝔦", "e\u0301a\u0308", "क्षि अनुच्छेद", "한국어 텍스트", "x" * 500 + "é" * 50,
]


def by_bytes(text):
    """Groups by the decoded bytes of all tokens; None where there are no tokens."""
    if not text:
        return None
    raw, table = (" " + text).encode(), alignment.byte_alphabet()
    a = A.encode(" " + text, add_special_tokens=False)
    b = B.encode(text)
    ids, bytes_a = a.ids, [bytes(table[c] for c in t) for t in a.tokens]
    names = [B.id_to_piece(i) for i in b]
    bytes_b = [bytes([int(n[3:5], 16)]) if B.is_byte(i) else n.replace("\u2581", " ").encode() for i, n in zip(b, names)]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    groups, left, right, i, j, at = [], [], [], 0, 0, [0, 0]
    while i < len(bytes_a) or j < len(bytes_b):
        if at[0] <= at[1]:
            at[0] += len(bytes_a[i])
            left.append(ids[i])
            i += 1
        else:
            at[1] += len(bytes_b[j])
            right.append(b[j])
            j += 1
        if at[0] == at[1]:
            groups.append((left, right))
            left, right = [], []
    return groups


def told(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def expected(texts):
    """All result columns per text, by loops over all links."""
    groups = [by_bytes(t) or [] for t in texts]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in groups]
    count = collections.Counter(p for found in links for p in set(found))
    top = collections.defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [
        (
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(found),
            sum(count[p] == top[p[0]] for p in found), sum(count[p] for p in found),
            hashlib.sha256(told(g).encode()).hexdigest() if g else "",
        )
        for g, found in zip(groups, links)
    ]


def values(row):
    return tuple(row[n] for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


def same(text):
    (found,), want = PAIR.align([text]), by_bytes(text)
    if want is None:
        assert found is None
        return
    assert found.digest() == hashlib.sha256(told(want).encode()).hexdigest()
    links = collections.Counter((x << alignment.B_BITS) | y for a, b in want for x in a for y in b)
    pairs, times = found.pairs()
    assert dict(zip(pairs.tolist(), times.tolist())) == links and found.n_links == sum(links.values())


def test_scripts():
    for text in [*TEXTS, "".join(TEXTS), " ".join(TEXTS[:4])]:
        same(text)
    assert PAIR.align(["", None, "a\u2581b", "a b \u2581 c"]) == [None] * 4


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab =\n\u00e9\u65e5\U0001f920\u0301\u00a0", max_size=60))
def test_split_characters(text):
    same(text)


def test_wide_groups():
    same("=- " * 7 + "=" * 4001 + "\u00e9" * 3000)
    found = PAIR.stretches(["=" * 20_001 + "\u2003" * 5000 + "=" * 3])[0]
    assert found is not None and sum(len(p) for p, _ in found[6]) < 5000


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'.1 \u00e9\u017f\u00ad\u00a0\n", max_size=40))
def test_borders(text):
    same(text)
    words = alignment.BORDER.split(text)
    assert " ".join(words) == text
    if text and PAIR.splits:
        assert by_bytes(text) is None or told(by_bytes(text)) == ";".join(part[4] for w in words for part in PAIR.stretches([w]))


def test_texts_together():
    """Pieces of many texts are encoded at once; those that a tokenizer doesn't give back are found among them."""
    texts = [*TEXTS, "good words a\u2581b more", "good words", "caf\u00e9 na\u00efve", "caf\u00e9 x\u2581"]
    PAIR.known.clear()
    PAIR.older.clear()
    for found, text in zip(PAIR.align(texts), texts):
        want = by_bytes(text)
        assert (found is None) == (want is None) and (found is None or found.groups() == told(want))


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    PAIR.known.clear()
    for i in range(100):
        same(f"word{i} and more{i}")
    assert len(PAIR.known) <= 10 and len(PAIR.older) <= 10


def test_words_cost_few_calls():
    """Python calls: a few for a new word, none for a known one."""
    words = ["".join(w) for w in itertools.product("abcde", repeat=6)]
    PAIR.known.clear()
    PAIR.older.clear()
    PAIR.align(["x"])  # opens the files

    def calls(text):
        n = 0

        def count(frame, event, arg):
            nonlocal n
            n += event.endswith("call")

        sys.setprofile(count)
        try:
            (found,) = PAIR.align([text])
        finally:
            sys.setprofile(None)
        assert found.groups() == told(by_bytes(text))
        return n

    assert calls(" ".join(words)) < 12 * len(words)
    assert calls(" ".join(words * 3)) < len(words)


def test_failed_words_are_not_remembered(monkeypatch):
    def fails(pieces):
        raise RuntimeError

    PAIR.known.clear()
    PAIR.older.clear()
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(PAIR, "stretches", fails)
        PAIR.align(["words of a failed try"])
    same("words of a failed try")


def test_remembered_wide_groups(monkeypatch):
    """Columns of words that move on to the next ten, large groups among them."""
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    monkeypatch.setattr(alignment, "WIDE", 1)
    PAIR.known.clear()
    PAIR.older.clear()
    for i in range(60):
        same(f"thesreer ciónezjaque undvereinpf{i % 7} Whin. word{i} ciónezjaque " + "=- " * (i % 3))
    assert PAIR.known.wide and PAIR.older.wide
    PAIR.known.clear()  # these words are as if of another setting
    PAIR.older.clear()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    table = h.documents(spark, sf)
    want = dict(zip(table.doc_id, expected(table.text)))
    assert {r.doc_id: values(r) for r in QUERIES["op12_tokenizer_spans"](spark, sf).collect()} == want


def test_counts_across_blocks_and_partitions(spark):
    texts = [*TEXTS, *TEXTS[:5], "plain words, again", "some plain words"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = dict(enumerate(expected(texts)))
    for limit in (1, 40, 1 << 20):
        got = alignment.align(docs, "text", PAIR, limit).collect()
        assert {r.doc_id: values(r) for r in got} == want


def test_odd_rows(spark):
    docs = h.odd_documents(spark).withColumns({n: F.lit("mine") for n in ["n_a", "n_best", "groups_sha256", "_block", "_pairs", "pair", "best", "documents"]})
    rows = alignment.align(docs, "text", PAIR).collect()
    texts = [r.text for r in docs.collect()]
    assert sorted(map(values, rows)) == sorted(expected(texts))
    assert {r.pair for r in rows} == {"mine"} and {r.documents for r in rows} == {"mine"}
    assert alignment.align(h.empty_documents(spark), "text", PAIR).collect() == []


def test_groups_in_words(spark):
    docs = spark.createDataFrame([("a b",), (None,), ("a\u2581b",)], "text string")
    rows = docs.select(alignment.groups_of(F.col("text"), PAIR).alias("g")).collect()
    assert [r.g for r in rows] == [told(by_bytes("a b")), None, None]
