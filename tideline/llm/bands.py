"""Quality rules of a text: counts of words, symbols and repeats, and bands of compression ratios.

Prose compresses within a narrow band that rises with its length: a short text has little to refer back to. What
repeats itself lies above the band, what is random (keys, encoded bytes, shuffled characters) below it. The
zstandard ratio is taken over the whole document and over fixed chunks of it, each against the limits for its own
length, so that a document can't hide a repetitive or random half behind a plain one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")


class Band(NamedTuple):
    """Ratios (bytes over compressed bytes) allowed to texts of ``length`` bytes or more, up to the next band."""

    length: int
    low: float
    high: float


#: Shorter texts than the first band are not judged by their ratio. Random letters and digits stay below 1.35 at any
#: length, prose in any alphabet above 1.4 from a few hundred bytes on; a text that says everything twice has about
#: twice the ratio of its half.
BANDS = (
    Band(256, 1.15, 3.5),
    Band(512, 1.25, 4.0),
    Band(1 << 10, 1.35, 4.5),
    Band(1 << 12, 1.35, 5.0),
    Band(1 << 14, 1.40, 6.0),
    Band(1 << 16, 1.40, 8.0),
)

FIELDS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "ratio": "double",
    "n_chunks": "long",
    "bad_share": "double",
    "in_band": "boolean",
}
RESULT = ", ".join(f"{n} {t}" for n, t in FIELDS.items())


def repeated_words(words: list[str], size: int = 3) -> int:
    """How many words stand in a window of ``size`` words that occurs twice or more, first occurrences included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    codes = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    number = codes[:n]
    for k in range(1, size):  # exact: pairs are renumbered, so products stay below the square of the length
        number = pd.factorize(number * len(words) + codes[k : k + n])[0].astype(np.int64)
    twice = np.bincount(number)[number] > 1
    change = np.zeros(len(words) + 1, dtype=np.int64)
    change[:n] += twice
    change[size:] -= twice
    return int((np.cumsum(change) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return again


def band_of(length: int, bands: Sequence[Band]) -> Band | None:
    return next((b for b in reversed(bands) if length >= b.length), None)


class Bands:
    """Ratios of one text after another against ``bands``; whole texts, and chunks of ``chunk`` bytes."""

    def __init__(self, bands: Sequence[Band] = BANDS, chunk: int = 1 << 12, share: float = 0.3, level: int = 3):
        self.bands, self.chunk, self.share, self.level = bands, chunk, share, level
        self.packer = None

    def __getstate__(self):
        return {**self.__dict__, "packer": None}

    def ratio(self, raw: bytes | memoryview) -> float:
        if self.packer is None:
            self.packer = zstandard.ZstdCompressor(level=self.level, write_checksum=False, write_content_size=False)
        return len(raw) / len(self.packer.compress(raw))

    def outside(self, raw: bytes | memoryview) -> bool | None:
        """Whether ``raw`` lies outside the band for its length; None where it is too short to tell."""
        band = band_of(len(raw), self.bands)
        return None if band is None else not band.low <= self.ratio(raw) <= band.high

    def judge(self, raw: bytes) -> tuple[float | None, int, float, bool]:
        """Ratio of the whole, chunks judged, share of their bytes outside the band, and the verdict."""
        if not raw:
            return None, 0, 0.0, True
        whole = self.outside(raw)
        judged = bad = n_chunks = 0
        if len(raw) > self.chunk:
            view = memoryview(raw)
            for at in range(0, len(raw), self.chunk):
                piece = view[at : at + self.chunk]
                out = self.outside(piece)
                if out is not None:
                    n_chunks, judged, bad = n_chunks + 1, judged + len(piece), bad + out * len(piece)
        part = bad / judged if judged else 0.0
        return self.ratio(raw), n_chunks, part, not whole and part <= self.share


def measure(text: str | None, bands: Bands) -> tuple:
    """The values of :data:`FIELDS` for one text; a null text is an empty one."""
    text = text or ""
    words = WORD.findall(text)
    return (
        len(words),
        sum(map(len, words)),
        len(SYMBOL.findall(text)),
        duplicate_lines(text),
        repeated_words(words),
        *bands.judge(text.encode()),
    )


def measures(text: str | Column, bands: Bands | None = None) -> Column:
    """Struct column of :data:`FIELDS`; texts are read one at a time, whole."""
    bands = bands or Bands()

    @F.pandas_udf(RESULT)
    def measured(texts: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([measure(t, bands) for t in texts], columns=list(FIELDS))
        return rows.astype({n: "float64" for n, t in FIELDS.items() if t == "double"})

    return measured(F.col(text) if isinstance(text, str) else text)


def judge(
    docs: DataFrame, text: str, bands: Bands | None = None, min_words: int = 50, max_repeat_percent: int = 50
) -> DataFrame:
    """``docs`` with the counts and ratios of :func:`measures`, ``base_failed`` and ``kept``, row for row.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of them in repeated
    three-word windows. ``kept``: not that, and ratios within the bands (``in_band``). Null and empty texts have no words
    and fail; ``ratio`` is null for them. Repeated rows stay, extra columns too; columns named like a result are
    replaced. Memory is a small multiple of the longest text.
    """
    names = [*FIELDS, "base_failed", "kept"]
    rows = docs.withColumn("_found", measures(text, bands)).drop(*[n for n in names if n != text])
    rows = rows.withColumns({n: F.col(f"_found.{n}") for n in FIELDS}).drop("_found")
    repeats = 100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    failed = (F.col("n_words") < min_words) | repeats
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("in_band"))
