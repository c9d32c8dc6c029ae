"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts somewhere else, in any text. All texts' suffixes
can't be sorted in one place, so equal strings are first brought together:

1. Every window of ``length`` bytes is led by an anchor: the ``gram`` bytes in it of the smallest hash, the leftmost if there are
   several. Equal windows have equal anchors at equal offsets. Neighbouring windows share one, so a text is a row
   of stretches, one per anchor and some ninety bytes apart: (anchor, digest of all the stretch's windows).
2. Stretches that occur twice as a whole repeat entirely. Those are counted with partial aggregates, so copies and
   common passages cost a row per stretch, wherever they stand.
3. Stretches that occur once but share their anchor with others may repeat in part: the edges of passages. Their
   bytes, cut to what some other stretch of the anchor continues in common, are joined into blocks, and the
   block's suffix array (linear grouping, :mod:`gsaca`) brings equal windows side by side.
4. An anchor of more than ``most`` different stretches is no single group: blocks of its windows are counted by
   digest, and only blocks that repeat in part are taken apart, with the same result.
5. The runs of repeated windows go back to the texts, which are cut.

Texts are known by a digest on the way, so equal texts are one until the end and rows need no key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.gsaca import suffix_array
from tideline.session import materialise

#: Windows of one text that are hashed at a time; the position in a piece shares a word with the hash.
PIECE = 1 << 23
LOW = np.uint64(0xFFFFFF)
BASE = np.uint64(0x9E3779B97F4A7C15)

#: Bits of the numbers that stand for anchors in the filter sent to the tasks: 2 MB.
SLOTS = 24

#: Bytes of a block whose suffix array is built at once, unless one anchor has more.
BLOCK = 1 << 18


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit hashes of all runs of ``gram`` bytes, a power of two."""
    h, power, have = data.astype(np.uint64) + np.uint64(1), BASE, 1
    while have < gram:
        h = h[:-have] * power + h[have:]
        with np.errstate(over="ignore"):
            power = power * power
        have *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    padded = padded.reshape(-1, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def stretches(raw: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first window, windows, offset of the anchor in the first) of a text's stretches, by pieces."""
    for at in range(0, max(len(raw) - length + 1, 0), PIECE):
        data = np.frombuffer(raw, dtype=np.uint8)[at : at + PIECE + length - 1]
        hashes = _gram_hashes(data, gram)
        packed = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
        lead = _least(packed, length - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
        place = (lead[first] & LOW).astype(np.int64)
        yield hashes[place], first + at, np.diff(np.append(first, len(lead))), place - first


def _continued(sides: list[bytes]) -> list[int]:
    """For each string, the longest beginning it shares with any other of them."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    best = [0] * len(sides)
    for i, j in zip(order, order[1:], strict=False):
        a, b = sides[i], sides[j]
        low, high = 0, min(len(a), len(b))
        while low < high:
            middle = (low + high + 1) // 2
            if a[:middle] == b[:middle]:
                low = middle
            else:
                high = middle - 1
        best[i], best[j] = max(best[i], low), max(best[j], low)
    return best


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, the starts of its windows of ``length`` that also start elsewhere in ``strings``."""
    text = b"".join(strings)
    owner, symbols, at = [], [], 0
    for s in strings:
        owner.append(at)
        symbols += [c + 2 for c in s]
        symbols.append(1)
        at += len(s) + 1
    symbols.append(0)
    starts = np.array(owner)
    sizes = np.array([len(s) for s in strings])
    order = np.array(suffix_array(symbols))
    string = np.searchsorted(starts, order, "right") - 1
    inside = order - starts[string]
    whole = (order < at) & (inside + length <= sizes[string])
    order, string, inside = order[whole], string[whole], inside[whole]
    # Equal windows are neighbours in the array; the separators stand in ``symbols`` only.
    plain = (order - string).tolist()
    same = np.zeros(len(plain) + 1, dtype=bool)
    for k in range(1, len(plain)):
        a, b = plain[k - 1], plain[k]
        same[k] = text[a : a + length] == text[b : b + length]
    twice = same[:-1] | same[1:]
    string, inside = string[twice], inside[twice]
    back = np.lexsort((inside, string))
    return np.split(inside[back], np.searchsorted(string[back], np.arange(1, len(strings))))


def _runs(starts: np.ndarray) -> list[dict]:
    """Runs of consecutive numbers as first and last."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return [{"first": int(a), "last": int(b)} for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True)]


def _anchored(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """(digest, anchor, whole, first, windows): the stretches of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"digest": [], "anchor": [], "whole": [], "first": [], "windows": []}
            for content in batch[text]:
                raw = (content or "").encode("utf-8", "surrogatepass")
                name = hashlib.md5(raw).digest()
                for anchor, first, windows, _ in stretches(raw, length, gram):
                    out["digest"] += [name] * len(anchor)
                    out["anchor"].append(anchor.view(np.int64))
                    out["first"].append(first)
                    out["windows"].append(windows)
                    out["whole"] += [
                        xxhash.xxh3_64_intdigest(raw[a : a + n + length - 1]) - (1 << 63)
                        for a, n in zip(first.tolist(), windows.tolist(), strict=True)
                    ]
            for name in ("anchor", "first", "windows"):
                out[name] = np.concatenate(out[name]) if out[name] else np.empty(0, dtype=np.int64)
            yield pd.DataFrame(out)

    schema = "digest binary, anchor long, whole long, first long, windows int"
    return docs.select(text).mapInPandas(run, schema)


def _filter(anchors: DataFrame) -> np.ndarray:
    """The bits of the anchors' numbers, eight to a byte.

    They are set in words of 64 by the tasks, so at most 2^(SLOTS - 6) words come to the driver, whatever the corpus. They come as
    columns: a collected row would take many times its bytes.
    """
    slot = F.col("anchor").bitwiseAND((1 << SLOTS) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    words = anchors.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    held = np.zeros(1 << (SLOTS - 6), dtype="<i8")
    held[words["word"].to_numpy()] = words["bits"].to_numpy()
    return held.view(np.uint8)


def _contexts(docs: DataFrame, text: str, length: int, gram: int, bits: np.ndarray) -> DataFrame:
    """(anchor, whole, lead, context): the bytes of the stretches whose anchor may be in ``bits``."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sent.value
        for batch in batches:
            rows = []
            for content in batch[text]:
                raw = (content or "").encode("utf-8", "surrogatepass")
                for anchor, first, windows, lead in stretches(raw, length, gram):
                    slot = (anchor & np.uint64((1 << SLOTS) - 1)).astype(np.int64)
                    for k in np.flatnonzero(held[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).tolist():
                        a = int(first[k])
                        part = raw[a : a + int(windows[k]) + length - 1]
                        mark = xxhash.xxh3_64_intdigest(part) - (1 << 63)
                        rows.append((int(anchor[k].view(np.int64)), mark, int(lead[k]), part))
            yield pd.DataFrame(rows, columns=["anchor", "whole", "lead", "context"])

    return docs.select(text).mapInPandas(run, "anchor long, whole long, lead int, context binary")


RUNS = "array<struct<first:int,last:int>>"


def _partly(groups: DataFrame, length: int) -> DataFrame:
    """(anchor, whole, runs): the repeated windows of stretches that occur once, from their anchor's suffix arrays."""

    def solve(names: list[tuple], strings: list[bytes], shifts: list[int]) -> pd.DataFrame:
        rows = []
        for name, found, shift in zip(names, repeated_windows(strings, length), shifts, strict=True):
            if len(found) and name[2] == 1:
                rows.append((name[0], name[1], _runs(found + shift)))
        return pd.DataFrame(rows, columns=["anchor", "whole", "runs"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, strings, shifts, size = [], [], [], 0
        for anchor, rows in _by_anchor(batches):
            right = _continued([c[lead:] for _, _, lead, c in rows])
            left = _continued([c[:lead][::-1] for _, _, lead, c in rows])
            for (whole, copies, lead, context), before, after in zip(rows, left, right, strict=True):
                if before + after >= length:
                    names.append((anchor, whole, copies))
                    strings.append(context[lead - before : lead + after])
                    shifts.append(lead - before)
                    size += before + after
            if size >= BLOCK:
                yield solve(names, strings, shifts)
                names, strings, shifts, size = [], [], [], 0
        if strings:
            yield solve(names, strings, shifts)

    def _by_anchor(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[tuple]]]:
        last, rows = None, []
        for batch in batches:
            columns = [batch[n].tolist() for n in ("anchor", "whole", "copies", "lead", "context")]
            for anchor, *row in zip(*columns, strict=True):
                if anchor != last and rows:
                    yield last, rows
                    rows = []
                last = anchor
                rows.append(tuple(row))
        if rows:
            yield last, rows

    ready = groups.repartition("anchor").sortWithinPartitions("anchor", "whole")
    return ready.select("anchor", "whole", "copies", "lead", "context").mapInPandas(
        run, f"anchor long, whole long, runs {RUNS}"
    )


#: Windows per block at the successive levels of counting.
LEVELS = (16, 4, 1)


def _blocks(groups: DataFrame, spots: DataFrame, width: int, length: int) -> DataFrame:
    """(anchor, whole, wanted, lead, block, low, high, outer, core) of the windows low .. high of each spot, by blocks.

    Windows are numbered by their distance to the anchor, so blocks of different stretches correspond. ``outer`` is
    the digest of all bytes under the block's windows, ``core`` that of the bytes that all windows of a
    whole block share.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            columns = [batch[n].tolist() for n in ("anchor", "whole", "wanted", "lead", "low", "high", "context")]
            for anchor, whole, wanted, lead, low, high, context in zip(*columns, strict=True):
                for block in range(low // width, high // width + 1):
                    first, last = max(low, block * width), min(high, block * width + width - 1)
                    outer = xxhash.xxh3_128_digest(context[lead - last : lead - first + length])
                    inner = context[lead - block * width : lead - block * width - width + 1 + length]
                    rows.append((anchor, whole, wanted, lead, block, first, last, outer, xxhash.xxh3_128_digest(inner)))
            yield pd.DataFrame(
                rows, columns=["anchor", "whole", "wanted", "lead", "block", "low", "high", "outer", "core"]
            )

    schema = "anchor long, whole long, wanted boolean, lead int, block int, low int, high int, outer binary, core binary"
    held = spots.join(groups.select("anchor", "whole", "lead", "context"), ["anchor", "whole"])
    return held.select("anchor", "whole", "wanted", "lead", "low", "high", "context").mapInPandas(run, schema)


def _partly_by_digest(groups: DataFrame, length: int) -> DataFrame:
    """As :func:`_partly` for anchors of very many stretches: blocks of windows are counted by digest.

    A block that occurs twice repeats entirely, one whose core occurs once has no repeated window, and what
    lies between is looked at again in smaller blocks, down to single windows. Of equal blocks one goes on.
    """
    windows = F.length("context") - length
    spots = groups.select(
        "anchor", "whole", (F.col("copies") == 1).alias("wanted"), (F.col("lead") - windows).alias("low"), F.col("lead").alias("high")
    )
    found = []
    for width in LEVELS:
        rows = materialise(_blocks(groups, spots, width, length), "blocks")
        same, core = ["anchor", "block", "low", "high", "outer"], ["anchor", "block", "core"]
        kinds = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("one"))
        cores = rows.groupBy(*core).agg(F.count(F.lit(1)).alias("sharing"), F.min("outer").alias("o0"), F.max("outer").alias("o1"))
        counted = rows.join(kinds, same)
        found.append(counted.filter("wanted AND n > 1").select("anchor", "whole", "lead", "low", "high"))
        if width > 1:
            left = counted.filter("n = 1 OR whole = one").join(cores.filter("sharing > 1 AND o0 <> o1"), core)
            spots = left.select("anchor", "whole", (F.col("wanted") & (F.col("n") == 1)).alias("wanted"), "low", "high")
    every = found[0].unionByName(found[1]).unionByName(found[2])
    run = F.struct((F.col("lead") - F.col("high")).alias("first"), (F.col("lead") - F.col("low")).alias("last"))
    return every.groupBy("anchor", "whole").agg(F.array_sort(F.collect_list(run)).alias("runs"))


def remove_repeats(
    docs: DataFrame, text: str, length: int = 200, gram: int = 32, most: int = 1024
) -> DataFrame:
    """``docs`` with n_bytes, removed (array of first and end byte of maximal removed runs) and kept (binary).

    Texts are taken as UTF-8; strings never cross texts, are judged on the input, and may overlap themselves. Of a
    repeated string every occurrence goes. Null texts count as empty; texts shorter than ``length`` lose nothing; rows
    are kept one for one, so a row that repeats loses all its text if that is long enough. ``kept`` may
    begin or end inside a character. Columns of ``docs`` named like a result are replaced.
    """
    results = ["n_bytes", "removed", "kept"]
    own = docs.drop(*results, "_digest", "_spans")
    rows = materialise(_anchored(own, text, length, gram), "stretches")
    counted = materialise(
        rows.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("copies")), "counted"
    )
    kinds = counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    shared = materialise(counted.join(kinds, "anchor"), "shared")
    # A full filter only lets more contexts through to the join below.
    contexts = (
        _contexts(own, text, length, gram, _filter(shared))
        .groupBy("anchor", "whole")
        .agg(F.first("lead").alias("lead"), F.first("context").alias("context"))
    )
    groups = materialise(shared.join(contexts, ["anchor", "whole"]), "contexts")
    partly = _partly(groups.filter(F.col("kinds") <= most), length).unionByName(
        _partly_by_digest(groups.filter(F.col("kinds") > most), length)
    )
    status = counted.filter("copies > 1").select("anchor", "whole", F.lit(None).cast(RUNS).alias("runs")).unionByName(partly)
    status = materialise(status, "status")
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("windows") - 1).alias("last")))
    spans = (
        rows.join(status, ["anchor", "whole"])
        .select(
            "digest",
            F.transform(
                F.coalesce("runs", whole),
                lambda r: F.struct(
                    (F.col("first") + r["first"]).alias("start"), (F.col("first") + r["last"] + length).alias("end")
                ),
            ).alias("spans"),
        )
        .select("digest", F.explode("spans").alias("span"))
        .distinct()
        .groupBy("digest")
        .agg(F.array_sort(F.collect_list("span")).alias("_spans"))
    )
    marked = own.withColumn("_digest", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    joined = marked.join(spans.withColumnRenamed("digest", "_digest"), "_digest", "left")

    @F.pandas_udf("struct<n_bytes:long,removed:array<struct<start:long,end:long>>,kept:binary>")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for content, low, high in zip(texts, starts, ends, strict=True):
            raw = (content or "").encode("utf-8", "surrogatepass")
            runs: list[dict] = []
            for a, b in zip(low, high, strict=True) if low is not None else ():
                if runs and a <= runs[-1]["end"]:
                    runs[-1]["end"] = max(runs[-1]["end"], int(b))
                else:
                    runs.append({"start": int(a), "end": int(b)})
            edges = [0, *(x for r in runs for x in (r["start"], r["end"])), len(raw)]
            out.append((len(raw), runs, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
        return pd.DataFrame(out, columns=["n_bytes", "removed", "kept"])

    ends = F.transform("_spans", lambda s: s["end"])
    done = joined.withColumn("_cut", cut(F.col(text), F.transform("_spans", lambda s: s["start"]), ends))
    return done.select(*own.columns, *[F.col(f"_cut.{n}").alias(n) for n in results])
