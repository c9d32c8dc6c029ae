"""Alignment of two tokenizers over the same texts, and corpus-wide counts of the aligned ids.

Both tokenizers cut a text into tokens. Where tokens of both end at the same byte, the text falls apart into
groups, the smallest stretches that both cover with whole tokens; ids of one group are linked.

The places come in two steps. The spans that the libraries report, character offsets on one side and byte spans of
pieces on the other, give the coarse cuts: all common ends between whole characters. Tokens that end inside a
character (parts of a multibyte character, byte-fallback pieces) share a span, so their ends are told by the bytes that
they decode to, and only those are compared there.

How many documents hold an id pair is a count over all documents. Documents of a task are dealt into blocks of a
bounded number of pairs; each block asks once for every pair it holds, the answers come back by block, and each document
adds up its own. So what is shuffled are the blocks' distinct pairs, not the links of all documents.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import materialise

#: Ids of an aligned pair, side by side in one number.
B_BITS = 24


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: characters for bytes, by the published rule."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


#: A space between two of these characters is a border that no token of either side crosses: byte-level splitting begins
#: a new word there, and no piece goes on after a space mark.
BORDER = re.compile("(?<=[!-~¡-¬®-ſ]) (?=[!-~¡-¬®-ſ])")
#: What may stand between such borders.
JOINED = re.compile("[!-~¡-¬®-ſ](?:.*[!-~¡-¬®-ſ])?", re.DOTALL)
#: Stretches of up to so many characters are remembered, up to twice so many of them.
SHORT, REMEMBERED = 48, 250_000
#: Characters of texts that are aligned at a time, and stretches that are encoded together.
TOGETHER, ENCODED = 1 << 20, 500
#: A group of more links than this has its equal ids counted before they are paired.
WIDE = 4096


#: Aligned tokens of one stretch of text: numbers of tokens of either side, of groups and of links, the groups in words,
#: links as 64-bit pair numbers, and links of large groups as (pairs, times).
Stretch = tuple[int, int, int, int, str, bytes, tuple[tuple[np.ndarray, np.ndarray], ...]]


class Known(dict):
    """Numbers of stretches, and columns of what is known of each number.

    Texts look their stretches up by number and column, so that a known one costs no Python step of its own.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.size = 0
        self.counts = np.zeros((0, 4), dtype=np.int64)  # without groups: not given back byte for byte
        self.told, self.links = np.zeros(0, dtype=object), np.zeros(0, dtype=object)
        self.wide: dict[int, tuple] = {}

    def room(self, n: int) -> np.ndarray:
        """Numbers for as many more, whose columns :meth:`put` and :meth:`take` fill."""
        first, self.size = self.size, self.size + n
        if self.size > len(self.told):
            more = max(self.size, 2 * len(self.told)) - len(self.told)
            self.counts = np.concatenate([self.counts, np.zeros((more, 4), dtype=np.int64)])
            self.told, self.links = (np.concatenate([c, np.zeros(more, dtype=object)]) for c in (self.told, self.links))
        return np.arange(first, self.size)

    def empty(self, at: list[int]) -> None:
        self.told[at] = self.links[at] = None
        for n in at:
            self.wide.pop(n, None)

    def put(self, at: np.ndarray, parts: list[Stretch | None]) -> None:
        columns = list(zip(*[(0, 0, 0, 0, "", b"", ()) if p is None else p for p in parts], strict=True))
        self.counts[at] = np.array(columns[:4], dtype=np.int64).T
        self.told[at], self.links[at] = columns[4:6]
        self.wide.update((n, w) for n, w in zip(at.tolist(), columns[6], strict=True) if w)

    def take(self, at: np.ndarray, other: Known, there: np.ndarray) -> None:
        self.counts[at], self.told[at], self.links[at] = other.counts[there], other.told[there], other.links[there]
        if other.wide:
            self.wide.update((n, other.wide[o]) for n, o in zip(at.tolist(), there.tolist(), strict=True) if o in other.wide)


def filled(told: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``ends`` where these are ``told``; from there on tokens add their ``sizes``."""
    own = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(told, np.arange(len(told)), -1))
    return own + np.where(last < 0, 0, (ends - own)[last])


class Pair:
    """The two tokenizers, opened from their files in each worker."""

    def __init__(self, byte_level: str, pieces: str):
        self.byte_level, self.pieces = byte_level, pieces
        self.a = self.b = None
        self.known, self.older = Known(), Known()

    def __reduce__(self):
        return pair_of, (self.byte_level, self.pieces)

    def open(self) -> None:
        if self.a is not None:
            return
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(self.byte_level)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = all(c in alphabet for c in token)
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=self.pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)
        ]
        self.a_size, self.b_size = (np.array([len(b) for b in side]) for side in (self.a_bytes, self.b_bytes))
        # Ids in words, each before the next of its side and as the last of its group.
        self.said = np.array(
            [f"{i}{mark}" for n, marks in ((len(self.a_bytes), ",|"), (len(names), ",;")) for i in range(n) for mark in marks],
            dtype=object,
        )
        self.said_size = np.array([len(s) for s in self.said])
        stored = json.loads(self.a.to_str())
        splits = stored["pre_tokenizer"] or {}
        plain = splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")
        self.splits = plain and not stored["normalizer"] and not any("▁" in n.lstrip("▁") for n in names)

    def ends_a(self, text: str, raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of the byte-level tokens and the byte at which each ends; None where their bytes are not the text's.

        Character offsets tell the ends between characters. Tokens that share a character overlap in their offsets; these
        end where the bytes that they decode to end.
        """
        code = self.a.encode(text, add_special_tokens=False)
        ids = code.ids
        if b"".join(map(self.a_bytes.__getitem__, ids)) != raw:
            return None
        starts, stops = spans(code.offsets)
        ids = np.array(ids, dtype=np.int64)
        if len(raw) == len(text):  # no token shares a character
            return ids, stops
        leads = np.frombuffer(raw, dtype=np.uint8)  # byte positions of characters
        at = np.append(np.flatnonzero((leads & 0xC0) != 0x80), len(raw))
        return ids, filled(stops <= np.append(starts[1:], len(text)), at[stops], self.a_size[ids])

    def ends_b(self, raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for the pieces, from their byte spans; these count without the space before the text.

        Byte pieces but the last of a character have an empty span, as has the added space: their decoded bytes
        tell their ends.
        """
        found = self.b.encode(raw[1:], return_type="offset_mapping")
        ids = found["ids"]
        if b"".join(map(self.b_bytes.__getitem__, ids)) != raw:
            return None
        starts, stops = spans(found["offsets"])
        ids = np.array(ids, dtype=np.int64)
        return ids, filled(stops > starts, stops + 1, self.b_size[ids])

    def stretches(self, pieces: list[str]) -> list[Stretch | None]:
        """The groups of each piece, all of them encoded as one text; None where either side doesn't give it back byte for byte.

        Several pieces must be such as :data:`BORDER` may stand between.
        """
        text = " ".join(pieces)
        spaced = " " + text
        raw = spaced.encode()
        left, right = self.ends_a(spaced, raw), self.ends_b(raw)
        if left is None or right is None:
            half = len(pieces) // 2
            return self.stretches(pieces[:half]) + self.stretches(pieces[half:]) if half else [None]
        (a, ends_a), (b, ends_b) = left, right
        common, i, j = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        borders = np.cumsum([len(p.encode()) + 1 for p in pieces])
        last = np.searchsorted(common, borders)
        # The exact check: both sides end together, with every piece.
        if not len(common) or (common[np.minimum(last, len(common) - 1)] != borders).any():
            raise RuntimeError("spans of the tokenizers disagree with their bytes")
        stop_a, stop_b = i + 1, j + 1
        size_a, size_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        first_a, first_b = stop_a - size_a, stop_b - size_b
        links = size_a * size_b
        # A token in words stands after the tokens of its side so far, and the other side's of whole groups.
        places = np.zeros(len(a) + len(b), dtype=np.int64)
        places[np.arange(len(a)) + np.repeat(first_b, size_a)] = 2 * a
        places[np.arange(len(b)) + np.repeat(stop_a, size_b)] = 2 * (b + len(self.a_bytes))
        places[stop_a + first_b - 1] += 1
        places[stop_a + stop_b - 1] += 1
        told = "".join(self.said[places].tolist())
        told_to = np.cumsum(self.said_size[places])[(stop_a + stop_b)[last] - 1].tolist()
        # Link k of a group is its token k // size_b on one side and k % size_b on the other.
        own = np.where(links <= WIDE, links, 0)
        upto = np.cumsum(own)
        k = np.arange(upto[-1]) - np.repeat(upto - own, own)
        row, col = np.divmod(k, np.repeat(size_b, own))
        pairs = a[np.repeat(first_a, own) + row] << B_BITS | b[np.repeat(first_b, own) + col]
        wide: dict[int, list] = {}
        for g in np.flatnonzero(links > WIDE).tolist():
            x, n = np.unique(a[first_a[g] : stop_a[g]], return_counts=True)
            y, m = np.unique(b[first_b[g] : stop_b[g]], return_counts=True)
            piece = int(np.searchsorted(last, g))
            wide.setdefault(piece, []).append(((x[:, None] << B_BITS | y[None]).ravel(), (n[:, None] * m[None]).ravel()))
        totals = (stop_a, stop_b, np.arange(1, len(common) + 1), np.cumsum(links))
        counts = [np.diff(t[last], prepend=0).tolist() for t in totals]
        links_to, linked = (8 * upto[last]).tolist(), pairs.tobytes()
        in_words = [told[at : to - 1] for at, to in zip([0, *told_to], told_to)]
        in_bytes = [linked[at:to] for at, to in zip([0, *links_to], links_to)]
        wides = [tuple(wide.get(piece, ())) for piece in range(len(pieces))]
        return list(zip(*counts, in_words, in_bytes, wides, strict=True))

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, list[int]]:
        """Numbers of the pieces, and which of these are not remembered. Pieces that no text had before are encoded together, once."""
        numbers = np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        missing = numbers < 0
        unknown = list(itertools.compress(pieces, missing.tolist()))
        fresh = list(dict.fromkeys(unknown))
        if self.known.size and self.known.size + len(fresh) > REMEMBERED:  # the words used last stay
            self.known, self.older = Known(), self.known
            return self.learn(pieces)
        at = self.known.room(len(fresh))
        there = np.fromiter(map(self.older.get, fresh, itertools.repeat(-1)), np.int64, len(fresh))
        had = there >= 0
        self.known.take(at[had], self.older, there[had])
        joined, alone = [], []
        for n in np.flatnonzero(~had).tolist():
            (joined if self.splits and JOINED.fullmatch(fresh[n]) else alone).append(n)
        for some in [*([n] for n in alone), *(joined[k : k + ENCODED] for k in range(0, len(joined), ENCODED))]:
            self.known.put(at[some], self.stretches([fresh[n] for n in some]))
        given = dict(zip(fresh, at.tolist(), strict=True))
        numbers[missing] = np.fromiter(map(given.__getitem__, unknown), np.int64, len(unknown))
        long = [given.pop(p) for p in fresh if len(p) > SHORT]
        self.known.update(given)
        return numbers, long

    def align(self, texts: list[str | None]) -> list[Aligned | None]:
        """The groups of each text; None where it has no tokens.

        A text falls apart at borders that tokens of neither side cross, so its alignment is that of its pieces, words
        mostly. Short ones are remembered for later texts.
        """
        self.open()
        cut = [(BORDER.split(t) if self.splits else [t]) if t else [] for t in texts]
        pieces = list(itertools.chain.from_iterable(cut))
        out: list[Aligned | None] = [None] * len(texts)
        if not pieces:
            return out
        numbers, long = self.learn(pieces)
        known = self.known
        counts, told, links = known.counts[numbers], known.told[numbers].tolist(), known.links[numbers].tolist()
        whole = [k for k, c in enumerate(cut) if c]
        stops = np.cumsum([len(cut[k]) for k in whole])
        starts = np.append(0, stops[:-1])
        sums = np.add.reduceat(counts, starts).tolist()
        given = (np.minimum.reduceat(counts[:, 2], starts) > 0).tolist()
        many = np.flatnonzero(counts[:, 3] > WIDE) if known.wide else np.zeros(0, dtype=np.int64)
        for k, start, stop, total, good in zip(whole, starts.tolist(), stops.tolist(), sums, given, strict=True):
            if good:
                own = many[np.searchsorted(many, start) : np.searchsorted(many, stop)] if len(many) else many
                wide = [w for n in numbers[own].tolist() for w in known.wide.get(n, ())]
                out[k] = Aligned(*total, ";".join(told[start:stop]), b"".join(links[start:stop]), wide)
        known.empty(long)
        return out


def spans(offsets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops."""
    flat = np.fromiter(itertools.chain.from_iterable(offsets), np.int64, 2 * len(offsets))
    return flat[::2], flat[1::2]


def pair_of(byte_level: str, pieces: str) -> Pair:
    """One pair for all tasks of a worker, so that its tables are built and its words are aligned once.

    This package travels to the workers by value, so what shall outlive a task is kept in a module of its own.
    """
    kept = sys.modules.setdefault("_tideline_kept", types.ModuleType("_tideline_kept")).__dict__
    key = f"pair {byte_level} {pieces}"
    if key not in kept:
        kept[key] = Pair(byte_level, pieces)
    return kept[key]


class Aligned:
    """The aligned stretches of a text in a row."""

    def __init__(self, n_a: int, n_b: int, n_groups: int, n_links: int, told: str, links: bytes, wide: list):
        self.n_a, self.n_b, self.n_groups, self.n_links = n_a, n_b, n_groups, n_links
        self.told, self.links, self.wide = told, links, wide

    def groups(self) -> str:
        """``a1,a2|b1;a3|b2,b3``."""
        return self.told

    def digest(self) -> str:
        return hashlib.sha256(self.groups().encode()).hexdigest()

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked id pairs, sorted, and how many links each has.

        A group's links are all pairs of its tokens. Where these are many, equal ids of a side have been counted first,
        so that a long stretch of few distinct tokens costs those, not the square of its length.
        """
        links = np.frombuffer(self.links, dtype=np.int64)
        found, times = np.unique(links, return_counts=True)
        if self.wide:
            found, place = np.unique(np.concatenate([found, *(p for p, _ in self.wide)]), return_inverse=True)
            n = np.concatenate([times, *(t for _, t in self.wide)])
            times = np.zeros(len(found), dtype=np.int64)
            np.add.at(times, place, n)
        return found, times


COUNTS = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string"}
#: What a block holds beside its documents: its distinct pairs and in how many of its documents each stands.
INNER = {"_block": "long", "_places": "binary", "_times": "binary", "_pairs": "array<long>", "_holders": "array<long>"}


class _Block:
    """Documents of one task up to ``limit`` pairs; a document's pairs are places among the block's distinct ones."""

    def __init__(self, number: int):
        self.number, self.rows, self.pairs, self.times, self.n = number, [], [], [], 0

    def add(self, row: tuple, pairs: np.ndarray, times: np.ndarray) -> None:
        self.rows.append(row)
        self.pairs.append(pairs)
        self.times.append(times)
        self.n += len(pairs) + 1

    def columns(self) -> dict[str, list]:
        distinct, place, holders = np.unique(
            np.concatenate(self.pairs), return_inverse=True, return_counts=True
        )
        places = np.split(place.astype(np.int32), np.cumsum([len(p) for p in self.pairs])[:-1])
        return {
            "_block": [self.number] * len(self.rows),
            "_places": [p.tobytes() for p in places],
            "_times": [t.astype(np.uint8 if t.max(initial=0) < 256 else np.int64).tobytes() for t in self.times],
            # Once a block, with its first document.
            "_pairs": [distinct, *[None] * (len(self.rows) - 1)],
            "_holders": [holders, *[None] * (len(self.rows) - 1)],
        }


def aligned(docs: DataFrame, text: str, pair: Pair, limit: int = 1 << 20) -> DataFrame:
    """``docs`` without ``text``, with :data:`COUNTS` and the block columns, written to the shared folder."""
    others = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*others, *_typed(COUNTS), *_typed(INNER)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        nothing = np.zeros(0, dtype=np.int64)
        for batch in batches:
            rest, texts = batch.drop_columns([text]), batch.column(text)
            block, first, at = _Block(next(number)), 0, 0
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and size < TOGETHER:
                    some.append(texts[at + len(some)].as_py())
                    size += len(some[-1] or "")
                for found in pair.align(some):
                    if found is None:
                        block.add((0, 0, 0, 0, ""), nothing, nothing)
                    else:
                        row = (found.n_a, found.n_b, found.n_groups, found.n_links, found.digest())
                        block.add(row, *found.pairs())
                    at += 1
                    if block.n >= limit or at == batch.num_rows:
                        yield _written(rest.slice(first, at - first), block)
                        block, first = _Block(next(number)), at

    return materialise(docs.select(text, *[f.name for f in others]).mapInArrow(run, schema), "aligned")


def _typed(types: dict[str, str]) -> list[T.StructField]:
    return T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in types.items())).fields


def _written(rest: pa.RecordBatch, block: _Block) -> pa.RecordBatch:
    counts = zip(*block.rows, strict=True)
    columns = {n: pa.array(list(v), pa.string() if COUNTS[n] == "string" else pa.int64()) for n, v in zip(COUNTS, counts, strict=True)}
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    inner = {n: pa.array(v, kinds[INNER[n]]) for n, v in block.columns().items()}
    arrays = [*rest.columns, *columns.values(), *inner.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*rest.schema.names, *columns, *inner])


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, a, b, documents, best``: in how many documents each linked pair stands, and whether none of its ``a`` has more."""
    held = rows.filter(F.col("_pairs").isNotNull()).select(
        F.explode(F.arrays_zip("_pairs", "_holders")).alias("_e")
    )
    counts = held.groupBy(F.col("_e._pairs").alias("pair")).agg(F.sum("_e._holders").alias("documents"))
    counts = counts.withColumns(
        {"a": F.shiftright("pair", B_BITS), "b": F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))}
    )
    top = counts.groupBy("a").agg(F.max("documents").alias("_top"))
    return counts.join(top, "a").select("pair", "a", "b", "documents", (F.col("documents") == F.col("_top")).alias("best"))


def align(docs: DataFrame, text: str, pair: Pair, limit: int = 1 << 20) -> DataFrame:
    """``docs`` without ``text``, row for row, with token, group and link counts and the counts of the linked pairs.

    ``n_best`` counts the links whose pair no other pair of the same first id beats, ties included;
    ``count_sum`` adds the document counts of all links; ``groups_sha256`` is the digest of the groups, '' without tokens.
    Null and empty texts, and those that either tokenizer doesn't give back byte for byte, have no tokens: zeros.
    Repeated rows count each as a document. Extra columns stay, those named like a result are replaced. A task holds
    the pairs of ``limit`` and one more document; a document's memory follows its length and its distinct pairs.
    """
    results = [*COUNTS, "n_best", "count_sum"]
    docs = docs.drop(*[n for n in (*results, *INNER) if n != text])
    rows = aligned(docs, text, pair, limit)
    counts = materialise(pair_counts(rows).select("pair", "documents", "best"), "pairs")
    asked = rows.filter(F.col("_pairs").isNotNull()).select(F.col("_block").alias("_asks"), F.posexplode("_pairs").alias("_place", "pair"))
    replies = asked.join(counts, "pair").select("_asks", "_place", "documents", "best")
    kept = [f for f in rows.schema.fields if f.name not in INNER]
    inner = rows.drop("_pairs", "_holders")
    schema = T.StructType([*kept, *_typed({"n_best": "long", "count_sum": "long"})])

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("_place").to_numpy()
        documents, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        documents[place] = right.column("documents").to_numpy()
        best[place] = right.column("best").to_numpy(zero_copy_only=False)
        n_best, total = [], []
        for places, times in zip(left.column("_places"), left.column("_times"), strict=True):
            at, n = np.frombuffer(places.as_py(), dtype=np.int32), times.as_py()
            n = np.frombuffer(n, dtype=np.uint8 if len(n) == len(at) else np.int64).astype(np.int64)
            n_best.append(int((best[at] * n).sum()))
            total.append(int((documents[at] * n).sum()))
        out = left.select([f.name for f in kept])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    return inner.groupBy("_block").cogroup(replies.groupBy("_asks")).applyInArrow(answered, schema)


def groups_of(text: Column, pair: Pair) -> Column:
    """The groups of a text as ``a1,a2|b1;a3|b2,b3``; null without tokens."""

    @F.udf("string")
    def told(value):
        (found,) = pair.align([value])
        return None if found is None else found.groups()

    return told(text)
