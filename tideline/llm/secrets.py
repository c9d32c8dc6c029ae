"""Secrets in texts, also where they are hidden under layers of encoding.

Every text starts a worklist. A layer taken from it is scanned, and every encoding found in it yields
further layers: percent escapes, Unicode and character escapes, base64 runs, and compressed bytes
inside them. The list runs dry at the fixpoint; a layer whose content was seen at the same place
before is dropped, so archives that unpack to themselves end too. Each layer knows for each of its
characters which stretch of the original text it came from, so every finding is reported there.

Rows are independent: one Arrow batch at a time, no shuffle. Memory is a few times the longest text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")

# The patterns of the three kinds and the shortest finding of each.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
SHORTEST_ASSIGN, SHORTEST_ACCESS = 12, 18

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:%u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
# Runs go on over line breaks; those of one line have 16 characters or more, others at least that many in all.
BASE64 = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r\n?|\n)[ \t]*+[A-Za-z0-9+/_-]++)++|[A-Za-z0-9+/_-]{16,}+)={0,2}"
)
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
SHORTEST_RUN = 16
URL_SAFE = str.maketrans("-_", "+/")

# What can hold a finding, or an encoding of one, in bytes that are no text: as ASCII, as UTF-16 of either order.
STRETCHES = (
    (re.compile(rb"[\t\n\r\x20-\x7e]{16,}"), 0, 1),
    (re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){16,}"), 0, 2),
    (re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){16,}"), 1, 2),
)

# Where compressed members may start: gzip, zlib, bzip2, xz, zstd.
MEMBER = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
ZSTD = b"\x28\xb5\x2f\xfd"
STEP = 1 << 20

SPAN = "struct<kind:string,start:long,end:long>"
RESULT = f"struct<base:array<{SPAN}>,spans:array<{SPAN}>,layers:int,oversize:int>"


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the findings in one layer, leftmost and non-overlapping per kind."""
    out = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= SHORTEST_ASSIGN:
                out.append((m.start(), m.end(), 0))
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= SHORTEST_ACCESS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


class Layer:
    """A decoded text; ``first[i]`` and ``last[i]`` bound the original characters of its character i, or ``whole`` those of all."""

    def __init__(
        self,
        text: str,
        first: list[int] | None = None,
        last: list[int] | None = None,
        whole: tuple[int, int] | None = None,
    ):
        self.text, self.first, self.last, self.whole = text, first, last, whole

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        if self.first is None:
            return start, end
        return min(self.first[start:end]), max(self.last[start:end])


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with all matches decoded; ``decode`` gives (text, offset, length) pieces, or None to keep one."""
    parts, first, last, at, changed = [], [], [], 0, False

    def keep(a: int, b: int) -> None:
        parts.append(layer.text[a:b])
        if layer.whole is not None:
            return
        first.extend(range(a, b) if layer.first is None else layer.first[a:b])
        last.extend(range(a + 1, b + 1) if layer.last is None else layer.last[a:b])

    for m in pattern.finditer(layer.text):
        pieces = decode(m.group())
        if pieces is None:
            continue
        keep(at, m.start())
        for text, offset, length in pieces:
            parts.append(text)
            if layer.whole is not None:
                continue
            low, high = layer.span(m.start() + offset, m.start() + offset + length)
            first.extend([low] * len(text))
            last.extend([high] * len(text))
        at, changed = m.end(), True
    if not changed:
        return None
    keep(at, len(layer.text))
    return Layer("".join(parts), first, last) if layer.whole is None else Layer("".join(parts), whole=layer.whole)


def _byte_pieces(raw: bytes, width: int) -> list[tuple[str, int, int]]:
    """Characters of ``raw`` whose bytes take ``width`` characters each: UTF-8 where it is that, else byte for byte."""
    out, at = [], 0
    for c in raw.decode("utf-8", "surrogateescape"):
        bad = "\udc80" <= c <= "\udcff"
        n = 1 if bad else len(c.encode("utf-8"))
        out.append((chr(ord(c) - 0xDC00) if bad else c, at * width, n * width))
        at += n
    return out


def _percent(found: str) -> list[tuple[str, int, int]]:
    return _byte_pieces(bytes.fromhex(found.replace("%", "")), 3)


def _escape(found: str) -> list[tuple[str, int, int]] | None:
    if found.startswith("\\x"):
        raw = bytes.fromhex(found.replace("\\x", ""))
        return _byte_pieces(raw, 4)
    if found[:2] in ("\\u", "%u"):
        units = b"".join(int(u, 16).to_bytes(2, "big") for u in found.split(found[:2])[1:])
        out, at = [], 0
        for c in units.decode("utf-16-be", "replace"):
            n = 2 if ord(c) > 0xFFFF else 1
            out.append((c, 6 * at, 6 * n))
            at += n
        return out
    number = int(found[2:], 16) if found[0] == "\\" else int(found[3:-1], 16) if found[2] in "xX" else int(found[2:-1])
    if not 0 < number < 0x110000 or 0xD800 <= number < 0xE000:
        return None
    return [(chr(number), 0, len(found))]


def _machine(raw: bytes, at: int, limit: int):
    """A decompressor for what starts at ``at``; None if that is no compressed member."""
    head = raw[at : at + 6]
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 1 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=max(limit * 2, 128 << 20))
    if head[:4] == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor(max_window_size=max(limit, 128 << 20)).decompressobj()
    return None


def _unfolded(raw: bytes, at: int, limit: int, end: list[int]) -> Iterator[bytes]:
    """The content of the members from ``at`` on, one after the other, in short pieces; ``end`` is where the last whole one ends.

    What comes before damage or a missing end counts.
    """
    import zstandard

    view = memoryview(raw)
    try:
        while (machine := _machine(raw, at, limit)) is not None:
            zstd = raw[at : at + 4] == ZSTD
            fed = 256 if zstd else 1 << 16  # zstd gives all it has at once
            while not machine.eof and at < len(raw):
                out = machine.decompress(view[at : at + fed], *(() if zstd else (STEP,)))
                at = min(len(raw), at + fed)
                yield out
                while not zstd and not machine.eof:  # what the step had no room for
                    left = getattr(machine, "unconsumed_tail", b"")
                    if not left and getattr(machine, "needs_input", True):
                        break
                    yield machine.decompress(left, STEP)
            if not machine.eof:
                yield machine.flush() if hasattr(machine, "flush") else b""
                return
            at -= len(machine.unused_data)
            end[0] = at
            while raw[at : at + 1] == b"\0":  # padding between members
                at += 1
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return


def _contents(raw: bytes, limit: int) -> Iterator[Iterator[tuple[bytes, bool]]]:
    """For each place of ``raw`` where compressed members start: their content, in pieces if it is beyond ``limit`` (true).

    Pieces have ``limit`` bytes and share half of them with the next one.
    """

    def pieces(at: int, end: list[int]) -> Iterator[tuple[bytes, bool]]:
        held, large = bytearray(), False
        for out in _unfolded(raw, at, limit, end):
            held += out
            while len(held) > limit:
                large = True
                yield bytes(held[:limit]), True
                del held[: max(1, limit // 2)]
        if held:
            yield bytes(held), large

    at = 0
    while (m := MEMBER.search(raw, at)) is not None:
        end = [m.start() + 1]
        yield pieces(m.start(), end)
        at = end[0]


def _readable(raw: bytes) -> str | None:
    """The text of UTF-8 bytes without control characters."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if any(c < " " and c not in "\t\n\r\f\v" or c == "\x7f" for c in text) else text


def _base64(found: str) -> bytes | None:
    body = found.rstrip("=")
    body = body[: len(body) - (len(body) % 4 == 1)].translate(URL_SAFE)
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def _runs(text: str) -> Iterator[tuple[str, Sequence[int]]]:
    """Base64 characters that may be decoded from their first one on, and their places in ``text``.

    A name or path before a payload shifts it by up to three characters, so each run is tried in all four phases; of a run
    of several lines, each line is tried alone as well.
    """
    for m in BASE64.finditer(text):
        lines = list(LINE.finditer(text, m.start(), m.end()))
        if len(lines) == 1:
            run, places = m.group().rstrip("="), range(m.start(), m.end())
        else:
            run, places = "".join(x.group() for x in lines), [i for x in lines for i in range(x.start(), x.end())]
            for x in lines:
                if x.end() - x.start() >= SHORTEST_RUN:
                    yield x.group(), range(x.start(), x.end())
        if len(run) >= SHORTEST_RUN:
            for phase in range(4):
                yield run[phase:], places[phase:]


def _texts(raw: bytes) -> Iterator[tuple[str, Sequence[tuple[int, int]] | None]]:
    """The texts in ``raw`` and (offset, length) of their characters: all of it, or what reads as ASCII or UTF-16 in it."""
    if (plain := _readable(raw)) is not None:
        yield plain, None
        return
    for pattern, offset, width in STRETCHES:
        parts, places = [], []
        for m in pattern.finditer(raw):
            parts.append(m.group()[offset::width].decode("ascii"))
            places.append((m.start(), width))
        if parts:
            yield "\0".join(parts), [
                (start + i * width, width) for part, (start, width) in zip(parts, places) for i in range(len(part) + 1)
            ][:-1]  # the character after each part is the zero between two


def unwrap(text: str, limit: int) -> Iterator[Layer | None]:
    """All layers of ``text`` but the text itself; None for one of more than ``limit`` bytes, which comes in pieces."""
    seen = {(0, len(text), hashlib.md5(text.encode("utf-8", "replace")).digest())}
    yield from _walk(Layer(text), limit, seen)


def _walk(start: Layer, limit: int, seen: set) -> Iterator[Layer | None]:
    """The layers below ``start``, breadth first."""
    work: deque[Layer | tuple[bytes, tuple[int, int]]] = deque([start])

    def new(origin: tuple[int, int], content: bytes) -> bool:
        key = (*origin, hashlib.md5(content).digest())
        if key in seen:
            return False
        seen.add(key)
        return True

    def opened(raw: bytes, origin: tuple[int, int]) -> Iterator[Layer | None]:
        """Puts what ``raw`` unpacks to on the list; pieces of what is beyond the limit are walked at once, one by one."""
        for content in _contents(raw, limit):
            counted = False
            for piece, large in content:
                if not large:
                    work.append((piece, origin))
                    continue
                if not counted:
                    yield None
                    counted = True
                if new(origin, piece):
                    for plain, _ in _texts(piece):
                        part = Layer(plain, whole=origin)
                        yield part
                        yield from _walk(part, limit, seen)
                    yield from opened(piece, origin)

    while work:
        layer = work.popleft()
        if isinstance(layer, tuple):
            raw, origin = layer
            if new(origin, raw):
                for plain, _ in _texts(raw):
                    out = Layer(plain, whole=origin)
                    yield out
                    work.append(out)
                yield from opened(raw, origin)
            continue
        made = []
        if "%" in layer.text:
            made.append(_replaced(layer, PERCENT, _percent))
        if "\\" in layer.text or "&#" in layer.text or "%u" in layer.text:
            made.append(_replaced(layer, ESCAPE, _escape))
        whole = layer.span(0, len(layer.text)) if layer.text else (0, 0)
        out = [x for x in made if x is not None and x.text and new(whole, x.text.encode("utf-8", "replace"))]
        for run, places in _runs(layer.text):
            raw = _base64(run)
            if not raw:
                continue
            origin = layer.span(places[0], places[-1] + 1)
            if not new(origin, raw):
                continue
            for plain, at in _texts(raw):
                if layer.whole is not None:
                    out.append(Layer(plain, whole=layer.whole))
                    continue
                first, last, byte = [], [], 0
                for i, c in enumerate(plain):
                    byte, n = (byte, len(c.encode("utf-8"))) if at is None else at[i]
                    end = min(((byte + n) * 4 + 2) // 3, len(places))
                    low, high = layer.span(places[byte * 4 // 3], places[end - 1] + 1)
                    first.append(low)
                    last.append(high)
                    byte += n
                out.append(Layer(plain, first, last))
            yield from opened(raw, origin)
        for x in out:
            yield x
            work.append(x)


def _scan_one(text: str, limit: int) -> tuple:
    base = {(start, kind, end) for start, end, kind in find(text)}
    found, layers, oversize = set(base), 0, 0
    for layer in unwrap(text, limit):
        if layer is None:
            oversize += 1
            continue
        layers += 1
        for start, end, kind in find(layer.text):
            low, high = layer.span(start, end)
            found.add((low, kind, high))
    rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(x)] for x in (base, found)]
    return rows[0], rows[1], layers, oversize


def spans_of(text: str | Column, limit: int = 64 << 20) -> Column:
    """Struct column: ``base`` findings in the text itself, all ``spans``, counts of ``layers`` and ``oversize``.

    Spans are (kind, start, end) in code points, end exclusive, by start, kind, end. Null and empty
    texts have none. ``limit`` bounds the bytes of one compressed layer that are held at a time, against
    decompression bombs: a layer beyond it is searched in pieces that overlap by half and counted in ``oversize``;
    texts themselves have no limit.
    """

    @F.pandas_udf(RESULT)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = [_scan_one(t or "", limit) for t in texts]
        return pd.DataFrame(rows, columns=["base", "spans", "layers", "oversize"])

    return scanned(F.col(text) if isinstance(text, str) else text)


def scan(docs: DataFrame, text: str, limit: int = 64 << 20) -> DataFrame:
    """``docs`` with base_spans, spans, layers and oversize of :func:`spans_of`, row for row.

    Repeated rows stay; columns of ``docs`` with these names are replaced.
    """
    results = ["base_spans", "spans", "layers", "oversize"]
    marked = docs.drop(*results, "_found").withColumn("_found", spans_of(text, limit))
    names = {"base_spans": "base", "spans": "spans", "layers": "layers", "oversize": "oversize"}
    return marked.withColumns({n: F.col(f"_found.{f}") for n, f in names.items()}).drop("_found")


def redact(docs: DataFrame, text: str, mark: str = "[redacted]", limit: int = 64 << 20) -> DataFrame:
    """``docs`` with every finding, in any layer, replaced by ``mark``; overlapping ones share a mark.

    Null texts stay null, texts without findings stay as they are, and no row is dropped.
    """

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if not t:
                return t
            parts, at = [], 0
            for span in _scan_one(t, limit)[1]:
                if span["start"] >= at:
                    parts += [t[at : span["start"]], mark]
                at = max(at, span["end"])
            return "".join(parts) + t[at:] if parts else t

        return texts.map(one)

    return docs.withColumn(text, cleaned(F.col(text)))
