"""Secrets, toxicity, packing against brute force, round trips and held-out labels."""

import base64
import bz2
import gzip
import hashlib
import lzma
import os
import re
import sys
import urllib.parse
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
import helpers as h  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402
from tideline.llm import packing, q_packing, secrets, toxicity  # noqa: E402
from tideline.llm.catalog import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
ASSIGN = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base_spans(text):
    """The contract's patterns, one by one."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


def test_secrets_query(spark):
    texts = dict(h.documents(spark, SF)[["doc_id", "text"]].values)
    for r in QUERIES["op1_secret_layers"](spark, SF).collect():
        want = base_spans(texts[r.doc_id] or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert set(joined.split(",")) <= set(r.spans.split(","))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "apikey", ":", "=", " ", "'", '"', "abcdef", "0123456789abcdef", "AKIA", "ZZ9", "ſecret", "\n", "%41", "é"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    found = sorted((s, k, e) for s, e, k in secrets.find(text))
    assert found == base_spans(text)


SECRET = "password=" + "hunter2hunter2x"
PLAIN = SECRET.encode()
WRAPS = {
    "url": lambda b: "".join(f"%{c:02X}" for c in b).encode(),
    "unicode": lambda b: "".join(f"\\u{c:04x}" for c in b).encode(),
    "entity": lambda b: "".join(f"&#x{c:x};" for c in b).encode(),
    "hexes": lambda b: "".join(f"\\x{c:02x}" for c in b).encode(),
    "base64": base64.b64encode,
    "urlsafe": base64.urlsafe_b64encode,
    "gzip": lambda b: base64.b64encode(gzip.compress(b)),
    "zlib": lambda b: base64.b64encode(zlib.compress(b)),
}


@pytest.mark.parametrize("inner", WRAPS)
@pytest.mark.parametrize("outer", [*WRAPS, "none"])
def test_layers_map_to_the_text(inner, outer):
    wrapped = WRAPS[inner](PLAIN)
    wrapped = (wrapped if outer == "none" else WRAPS[outer](wrapped)).decode()
    text = f"vör: {wrapped} :ende"
    _, spans, layers, _ = secrets._scan_one(text, 1 << 20)
    at = text.index(wrapped)
    hit = [s for s in spans if s["kind"] == "assign"]
    assert layers and hit and all(at <= s["start"] < s["end"] <= at + len(wrapped) for s in hit)


def test_span_inside_a_layer():
    inner = "some words before " + SECRET + " and words after it"
    text = "x " + base64.b64encode(inner.encode()).decode()
    (span,) = secrets._scan_one(text, 1 << 20)[1]
    first, last = inner.index(SECRET), inner.index(SECRET) + len(SECRET)
    assert span == {"kind": "assign", "start": 2 + first * 4 // 3, "end": 2 + (last * 4 + 2) // 3}
    escaped = "é%20" + urllib.parse.quote(SECRET, safe="")
    (span,) = secrets._scan_one(escaped, 1 << 20)[1]
    assert escaped[span["start"] : span["end"]] == urllib.parse.quote(SECRET, safe="")


@pytest.mark.parametrize("word", ["café", "日本", "plain", "\x85\xff"])
def test_escapes_that_are_no_utf8(word):
    """Bytes that aren't UTF-8 stand for themselves; what is around them is still read."""
    for raw in (word.encode(), word.encode("latin-1", "replace")):
        text = "".join(f"%{b:02X}" for b in raw + b" " + SECRET.encode() + b"\xe9\xe9 end")
        (span,) = [s for s in secrets._scan_one(text, 1 << 20)[1] if s["kind"] == "assign"]
        assert bytes.fromhex(text[span["start"] : span["end"]].replace("%", "")) == SECRET.encode()
    units = "".join(f"%u{ord(c):04x}" for c in word + " " + SECRET)
    (span,) = [s for s in secrets._scan_one(units, 1 << 20)[1] if s["kind"] == "assign"]
    assert units[span["start"] : span["end"]].count("%u") == len(SECRET)


def found_in(text):
    """The stretches of ``text`` that hold an assignment."""
    return {text[s["start"] : s["end"]] for s in secrets._scan_one(text, 1 << 20)[1] if s["kind"] == "assign"}


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\n    "])
@pytest.mark.parametrize("width", [10, 64, 76])
def test_wrapped_base64(width, newline):
    for shift in range(0, 60, 7):
        coded = base64.b64encode(b"." * shift + PLAIN + b" and so on" * 9).decode()
        text = "see " + newline.join(coded[i : i + width] for i in range(0, len(coded), width)) + " end"
        hit = max(found_in(text), key=len)  # a line alone may show the beginning of it
        low, high = text.index(hit), text.index(hit) + len(hit)
        assert len("".join(text[:low].split())) - 3 == shift * 4 // 3
        assert len("".join(text[:high].split())) - 3 == ((shift + len(PLAIN)) * 4 + 2) // 3


@pytest.mark.parametrize("before", ["https://host.io/cb/", "id_", "a-", "x/", "/"])
def test_base64_after_a_path_or_name(before):
    coded = base64.b64encode(PLAIN + b" ").decode()
    assert found_in(f"go {before}{coded}")


@pytest.mark.parametrize(
    "raw", [SECRET.encode("utf-16"), SECRET.encode("utf-16-be"), b"\x00\xff" + PLAIN + b"\x01\xfe", b"\x7fELF" + SECRET.encode("utf-16-le")]
)
def test_payloads_that_are_no_text(raw):
    assert found_in("x " + base64.b64encode(raw).decode())


def _zstd(raw):
    import zstandard

    return zstandard.compress(raw)


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, _zstd])
def test_every_member_and_any_size(pack):
    noise = os.urandom(300)
    half = len(PLAIN) // 2
    for packed in (
        pack(noise) + pack(b"clean") + pack(PLAIN),
        pack(noise + PLAIN[:half]) + pack(PLAIN[half:]),
        b"\xff\0" + pack(noise) + b"\0" * 8 + pack(PLAIN),
    ):
        assert found_in("x " + base64.b64encode(packed).decode())
        assert found_in("see host/cb/" + base64.b64encode(packed).decode())
    for at in (0, 1 << 20, (3 << 20) - 10):
        large = bytearray(b" " * (3 << 20))
        large[at:at] = b" " + PLAIN
        _, spans, _, oversize = secrets._scan_one(base64.b64encode(pack(bytes(large))).decode(), 1 << 20)
        assert oversize == 1 and [s["kind"] for s in spans] == ["assign"]


def test_bombs_and_loops_end():
    bomb = base64.b64encode(zlib.compress(b"a" * (1 << 21))).decode()
    assert secrets._scan_one(bomb, 1 << 20)[3] == 1
    assert secrets._scan_one(bomb, 1 << 22)[3] == 0
    text = PLAIN
    for _ in range(12):
        text = base64.b64encode(text)
    assert len(secrets._scan_one(text.decode(), 1 << 20)[1]) == 1


def test_secrets_odd_rows(spark):
    rows = secrets.scan(h.odd_documents(spark), "text").collect()
    assert len(rows) == 13 and all(r.base_spans == r.spans == [] for r in rows)
    assert secrets.scan(h.empty_documents(spark), "text").collect() == []


def test_redact(spark):
    texts = [None, "", "clean text", f"a {SECRET} b", f"{SECRET} {'0123456789abcdef' * 2}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(secrets.redact(docs, "text").collect())
    assert got == {0: None, 1: "", 2: "clean text", 3: "a [redacted] b", 4: "[redacted] [redacted]"}


def test_grammar():
    read = toxicity.Grammar(stems=["vequ"]).read
    assert read("the idiot came") == {"insult_plain"}
    assert read("you are an idiot") == {"insult_aimed"}
    assert read("idiot that you are") == {"insult_aimed"}
    assert read("he is not an idiot") == {"insult_negated"}
    assert read("not that it matters much, idiot") == {"insult_plain"}
    assert read("she said he was an idiot") == {"insult_reported"}
    assert read('the word "idiot" is old') == {"insult_reported"}
    assert read("i will kill you") == {"threat_aimed"}
    assert read("never kill time") == {"threat_negated"}
    assert read("la vequance de jour") == {"insult_plain"}
    assert read("idiotic is another word") == set()


def test_clauses_are_separate():
    grammar = toxicity.Grammar()
    finder = grammar.finder()
    found = list(grammar.clauses("Not now. You idiot! He said: fine. A clown; a moron\nscum, scum", finder))
    assert found == [{"insult_aimed"}, {"insult_plain"}, {"insult_plain"}, {"insult_plain"}]
    assert list(grammar.clauses("", finder)) == list(grammar.clauses("classless scumble", finder)) == []


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op8_clause_toxicity"](spark, sf).collect()}
    labels = h.documents(spark, sf, "labels")
    held = [(got[d], t) for d, t in zip(labels.doc_id, labels.toxic) if got[d].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    caught = sum(r.predicted for r, t in held if t)
    wrong = sum(r.predicted for r, t in held if not t)
    assert caught / sum(t for _, t in held) > 0.75 and wrong / len(held) < 0.01


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(0, 0), (5, None), (None, 1), (7, 1)], "doc_id long, toxic int")
    train = toxicity.training_row("doc_id")
    for known in (labels, labels.limit(0)):
        rows = toxicity.score(h.odd_documents(spark), known, "doc_id", "text", "toxic", train).collect()
        assert len(rows) == 13 and len({r.score for r in rows}) == 1 and 0 < rows[0].score < 1
    assert toxicity.score(h.empty_documents(spark), labels, "doc_id", "text", "toxic", train).collect() == []
    docs = h.odd_documents(spark).withColumn("clauses", F.lit("mine"))
    kept = toxicity.keep_clean(docs, labels, "doc_id", "text", "toxic", train)
    assert kept.columns == docs.columns and kept.count() == 13 and kept.first().clauses == "mine"


def test_fit_learns_readings(spark):
    names = toxicity.FEATURES
    rows = [[1 if n == "insult_aimed" else 0 for n in names] + [1]] * 30 + [[0] * len(names) + [0]] * 200
    rows += [[1 if n == "insult_reported" else 0 for n in names] + [0]] * 30
    known = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in [*names, "toxic"]))
    bias, weights = toxicity.fit(known, "toxic")
    by = dict(zip(names, weights))
    assert 1 / (1 + np.exp(-bias - by["insult_aimed"])) > 0.7 > 0.1 > 1 / (1 + np.exp(-bias - by["insult_reported"]))


def whole(pieces, length):
    """Checks that pieces tile documents and sequences; the ids by document place."""
    by_doc, by_sequence = {}, {}
    for r in pieces:
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length > 0
        by_doc.setdefault(r.doc_id, []).append((r.start, ids))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.queue))
    for parts in by_sequence.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    full = {s: sum(n for _, n, _ in p) for s, p in by_sequence.items()}
    assert sorted(full) == list(range(len(full)))
    assert all(n == length for s, n in full.items() if s < len(full) - 1)
    return {d: [int(x) for _, ids in sorted(p, key=lambda q: q[0]) for x in ids] for d, p in by_doc.items()}, by_sequence


def test_packing_round_trip(spark):
    docs = h.documents(spark, SF)
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = q_packing.packed(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    got, _ = whole(pieces, 2048)
    assert got == {d: [*slow.encode(t or "", add_special_tokens=False).ids, 1] for d, t in zip(docs.doc_id, docs.text)}
    digests = {(r.doc_id, r.start): zlib.crc32(r.ids) for r in pieces}
    for r in QUERIES["op3_mixture_packing"](spark, SF).collect():
        assert digests[r.doc_id, r.start] == r.ids_crc32 and r.doc_tokens == len(got[r.doc_id])


def test_mixture_and_deficits(spark):
    """Every window holds the target shares to a token or two, until a queue runs dry."""
    rows = [(i, "a b c d e f g " * 30, f"s{i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    encoder = q_packing.encoder()
    pieces = packing.pack(docs, "doc_id", "text", "source", {"s0": 0.5, "s1": 0.3}, 0.2, encoder, length=64, window=8).collect()
    got, sequences = whole(pieces, 64)
    assert len(got) == 300
    total = {q: sum(r.length for r in pieces if r.queue == q) for q in range(3)}
    last = min(int(total[q] / w // 512) for q, w in enumerate((0.5, 0.3, 0.2)))
    sent = np.zeros(3)
    for k in range(last):
        own = [p for s in range(8 * k, 8 * k + 8) for p in sequences[s]]
        sent += [sum(n for _, n, q in own if q == i) for i in range(3)]
        assert np.abs(sent - np.array([0.5, 0.3, 0.2]) * 512 * (k + 1)).max() < 3
    assert last > 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=4), st.data())
def test_places_are_a_permutation(sizes, data):
    shares = np.array([data.draw(st.integers(1, 50 << packing.BITS)) for _ in sizes])
    totals = np.array(sizes, dtype=np.int64)
    taken = []
    for q, n in enumerate(sizes):
        for begin, size, place in packing.places(q, 0, n, totals, shares) if n else ():
            taken += range(place, place + size)
    assert sorted(taken) == list(range(sum(sizes)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(min_codepoint=9, max_codepoint=0x180), st.sampled_from(list(" \t\n'1a<|endoftext|>"))), max_size=60))
def test_both_tokenizers_agree(text):
    encoder = q_packing.encoder()
    test_both_tokenizers_agree.known = known = getattr(test_both_tokenizers_agree, "known", None) or encoder
    known.ids("")
    want = known.slow.encode(text, add_special_tokens=False).ids
    assert known.ids(text).tolist() == want
    assert known.ids(text + "<|endoftext|>").tolist() == known.slow.encode(text + "<|endoftext|>", add_special_tokens=False).ids


def test_packing_odd_rows(spark):
    docs = h.odd_documents(spark)
    pieces = q_packing.packed(docs).collect()
    assert sum(r.length for r in pieces if r.doc_id == 0) == 1
    assert sum(r.start == 0 for r in pieces) == 13
    assert q_packing.packed(h.empty_documents(spark)).collect() == []
    joined = packing.pack(docs, "doc_id", "text", "source", {"src0": 1.0}, 1.0, q_packing.encoder(), broadcast=0).collect()
    assert sum(r.length for r in joined) == sum(r.length for r in pieces)
