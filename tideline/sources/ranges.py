"""Files as byte ranges: lines and JSON values read in place, whatever the size of a file.

A range owns the lines that begin in it. What a range can't know by itself, the nesting depth at its first line and how
many items lie before it, comes from a first light pass that sends one small row per range; running sums over the ranges
of a file settle it. So text is never shuffled, sorted or numbered by Spark, and a file may be cut anywhere.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.session import materialise

#: Files that only a reader from their beginning can open are one range.
WHOLE = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"
#: Bytes read at a time, and about as many sent on at a time.
BLOCK = 4 << 20
BREAK = re.compile(rb"\r\n?|\n")
ESCAPED, STRING = re.compile(rb"\\."), re.compile(rb'"[^"\n]*"')
NO_BRACKET = bytes(set(range(256)) - set(b"{}[]\n"))
END = 1 << 62


def byte_ranges(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, int]:
    """``file, start, end`` of all ranges, dealt over tasks, and their number.

    A range is at most ``spark.sql.files.maxPartitionBytes`` long; small files share tasks. Only names and lengths are read here.
    """
    conf = spark.conf.get("spark.sql.files.maxPartitionBytes")
    size = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf))
    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"), "length")
    whole = F.col("file").rlike(WHOLE)
    starts = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long")))
    ranges = files.filter("length > 0").select("file", "length", F.explode(starts).alias("start"))
    end = F.when(whole, F.lit(END)).otherwise(F.least(F.col("start") + size, F.col("length")))
    ranges = ranges.withColumn("end", end)
    number, total = ranges.agg(F.count(F.lit(1)), F.sum(F.least("length", F.col("end")) - F.col("start"))).first()
    tasks = min(number, spark.sparkContext.defaultParallelism + (total or 0) // size)
    return ranges.select("file", "start", "end").repartition(max(1, tasks)), number


def _open(file: str):
    """The bytes of a file on any file system that all executors reach; packed ones unpacked."""
    if file.startswith("file:") or "://" not in file:
        system, path = fs.LocalFileSystem(), "/" + unquote(file.removeprefix("file:")).lstrip("/")
    else:
        system, path = fs.FileSystem.from_uri(unquote(file).replace("s3a://", "s3://"))
    return system.open_input_stream(path) if re.search(WHOLE, file) else system.open_input_file(path)


def _blocks(file: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the whole lines that begin in [start, end), a block of lines at a time."""
    with _open(file) as source:
        at, held, skipping = max(0, start - 1), bytearray(), start > 0
        if source.seekable():
            source.seek(at)  # the byte before the range tells whether a line begins with it
        else:
            at, skipping, left = start, False, start
            while left:
                left -= len(source.read(min(BLOCK, left)))
        while True:
            piece = source.read(BLOCK)
            held += piece
            if skipping:
                cut = held.find(b"\n") + 1
                at += cut or len(held)
                del held[: cut or len(held)]
                skipping = not cut
            if at >= end or not (held or piece):
                return
            fresh = max(0, len(held) - len(piece))
            if at + len(held) >= end:  # the line that holds the last byte of the range is the last
                cut = held.find(b"\n", max(fresh, end - 1 - at)) + 1
                if cut or not piece:
                    yield at, bytes(held[: cut or len(held)])
                    return
            elif not piece:
                yield at, bytes(held)
                return
            else:
                cut = held.rfind(b"\n", fresh) + 1
                if cut:
                    yield at, bytes(held[:cut])
                    at += cut
                    del held[:cut]


def _lines(block: bytes) -> list[bytes]:
    """The lines of a block that aren't blank; a carriage return breaks lines too."""
    return [line for line in BREAK.split(block) if line.strip()]


def _summarised(ranges: DataFrame, row: Callable[[str, int, int], tuple], schema: str) -> DataFrame:
    """One row per range, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(f, s, e, *row(f, s, e)) for f, s, e in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    fields = T.StructType.fromDDL(f"file string, start long, end long, {schema}")
    names, types = fields.names, [to_arrow_type(f.dataType) for f in fields]
    return materialise(ranges.mapInArrow(run, fields), "ranges")


def _sent(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], size: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BLOCK bytes, told by the text in place ``size``."""
    ready, n = [], 0
    for row in rows:
        ready.append(row)
        n += len(row[size]) + 32
        if n >= BLOCK:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), types, strict=True)], names=names)
            ready, n = [], 0
    if ready:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), types, strict=True)], names=names)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, item_index, line``: the lines that aren't blank, numbered within their file.

    The files are read twice, first to count the lines of each range; no text is shuffled or written.
    """
    ranges, _ = byte_ranges(spark, paths)
    counts = _summarised(ranges, lambda f, s, e: (sum(len(_lines(b)) for _, b in _blocks(f, s, e)),), "n long")
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.select("file", "start", "end", F.coalesce(before, F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for file, start, end, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for _, block in _blocks(file, start, end):
                        for line in _lines(block):
                            yield file, number, line.decode("utf-8", "replace")
                            number += 1

        yield from _sent(rows(), [pa.string(), pa.int64(), pa.string()], ["file", "item_index", "line"], 2)

    tasks = max(1, ranges.rdd.getNumPartitions())
    return placed.repartition(tasks).mapInArrow(run, "file string, item_index long, line string")


def _deltas(block: bytes) -> list[int]:
    """Change of nesting depth of every line of a block; brackets inside strings don't count.

    A raw line break can't occur inside a JSON string, so each line tells its own.
    """
    bare = STRING.sub(b"", ESCAPED.sub(b"", block)).translate(None, NO_BRACKET)
    known: dict[bytes, int] = {b"": 0}
    out = []
    for line in bare.split(b"\n"):
        if line not in known:
            known[line] = line.count(b"{") + line.count(b"[") - line.count(b"}") - line.count(b"]")
        out.append(known[line])
    return out


def _profiled(file: str, start: int, end: int) -> Iterator[tuple[int, bytes, int]]:
    """(offset, line, delta) of the lines that begin in a range and aren't blank."""
    for at, block in _blocks(file, start, end):
        for line, delta in zip(block.split(b"\n"), _deltas(block), strict=True):
            if line.strip():
                yield at, line, delta
            at += len(line) + 1


PROFILE = """n long, first long, delta long, low long, levels array<struct<level:long,offset:long>>,
  open struct<level:long,offset:long,low:long>"""


def _profile(file: str, start: int, end: int) -> tuple:
    """What other ranges and the reader need to know of a range, depths counted from its first line.

    ``levels``: where the depth falls to a new low, and the offset of the next line. ``open``: the first line that begins with a
    bracket in its first column and below whose depth no later line of the range falls, and the lowest depth before it. Both are
    bounded by the nesting.
    """
    n, depth, low, first = 0, 0, None, None
    levels: list[tuple[int, int]] = []
    fallen = False  # the line before reached a new low; this line's offset belongs to it
    opens: list[tuple[int, int, int | None]] = []
    for at, line, delta in _profiled(file, start, end):
        n += 1
        if first is None:
            first = at
        if fallen:
            levels.append((low, at))
            fallen = False
        if line[:1] in b"{[" and (not opens or opens[-1][0] < depth):
            opens.append((depth, at, low))
        depth += delta
        while opens and opens[-1][0] > depth:
            opens.pop()
        if low is None or depth < low:
            low, fallen = depth, True
    first_open = dict(zip(("level", "offset", "low"), opens[0], strict=True)) if opens else None
    return n, first, depth, low, [{"level": v, "offset": o} for v, o in levels], first_open


def read_values(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, item_index, item, valid``: JSON values however they are laid out, numbered within their file.

    Depth is counted from 0 at the beginning of a file. A line at the lowest depth so far begins a group of lines; so
    does one that begins with a bracket in its first column and below whose depth the file never falls again: after a
    value that was never closed, this is where reading goes on. A range reads the groups that begin in it, the last one
    past its end; values are decoded group by group, what can't be decoded is one invalid item to the end of its group.
    The files are read twice; what is written are the decoded items, once, with their place in the range. A task
    holds a block and a group of lines.
    """
    ranges, number = byte_ranges(spark, paths)
    known = _summarised(ranges, _profile, PROFILE).filter("n > 0")
    by_file = Window.partitionBy("file").orderBy("start")
    earlier, later = by_file.rowsBetween(Window.unboundedPreceding, -1), by_file.rowsBetween(1, Window.unboundedFollowing)
    known = known.withColumn("depth", F.coalesce(F.sum("delta").over(earlier), F.lit(0)))
    lowest = F.col("depth") + F.col("low")
    known = known.withColumns({"lowest": F.least(F.lit(0), F.min(lowest).over(earlier)), "later": F.min(lowest).over(later)})
    fallen = F.get(F.filter("levels", lambda x: x["level"] <= F.col("lowest") - F.col("depth")), F.lit(0))
    opened = F.when(F.coalesce(F.col("open.level") + F.col("depth") <= F.col("later"), F.lit(True)), F.col("open"))
    at = "struct<offset:long,depth:long,lowest:long>"
    begins = F.array_compact(
        F.array(
            F.when(F.col("depth") <= F.col("lowest"), F.struct("first", "depth", "lowest")).cast(at),
            F.when(fallen.isNotNull(), F.struct(fallen["offset"], F.col("depth") + fallen["level"], F.col("depth") + fallen["level"])).cast(at),
            F.when(
                opened.isNotNull(),
                F.struct(opened["offset"], F.col("depth") + opened["level"], F.least("lowest", F.col("depth") + opened["low"])),
            ).cast(at),
        )
    )
    regions = known.withColumn("begin", F.array_min(begins)).filter("begin is not null")
    to = F.lead("begin.offset").over(by_file)
    regions = regions.select("file", "begin.offset", "end", F.coalesce(to, F.lit(END)).alias("to"), "begin.depth", "begin.lowest", "later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for file, *region in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for place, (item, valid) in enumerate(_values(file, *region)):
                        yield file, region[0], place, item, valid

        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        yield from _sent(rows(), types, ["file", "region", "place", "item", "valid"], 3)

    tasks = max(1, ranges.rdd.getNumPartitions())
    schema = "file string, region long, place long, item string, valid boolean"
    decoded = materialise(regions.repartition(tasks).mapInArrow(run, schema), "items")
    counts = decoded.groupBy("file", "region").agg(F.count(F.lit(1)).alias("n"))
    by_region = Window.partitionBy("file").orderBy("region").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file", "region", F.coalesce(F.sum("n").over(by_region), F.lit(0)).alias("before"))
    # One row per range at most; beyond a million of them the join is left to Spark.
    counts = F.broadcast(counts) if number <= 1_000_000 else counts
    return decoded.join(counts, ["file", "region"]).select(
        "file", (F.col("before") + F.col("place")).alias("item_index"), "item", "valid"
    )


def _standing(file: str, begin: int, end: int, depth: int, lowest: int, later: int | None) -> array:
    """Offsets of the lines of [begin, end) that begin with a bracket above the lowest depth, and below whose depth the file never falls again."""
    offsets, depths = array("q"), array("q")
    for at, line, delta in _profiled(file, begin, end):
        if depth > lowest and line[:1] in b"{[":
            offsets.append(at)
            depths.append(depth)
        depth += delta
        lowest = min(lowest, depth)
        while depths and depths[-1] > depth:
            offsets.pop()
            depths.pop()
    while depths and later is not None and depths[-1] > later:
        offsets.pop()
        depths.pop()
    return offsets


def _values(file: str, begin: int, end: int, to: int, depth: int, lowest: int, later: int | None) -> Iterator[tuple[str, bool]]:
    """The values of the groups that begin in [begin, end); the last group goes on up to ``to``.

    Lines are read as a stream. Whether a bracket above the lowest depth begins a group depends on all lines after it: where there
    is one, the rest of the range is read once ahead.
    """
    group: list[bytes] = []
    standing, place = None, 0
    for at, line, delta in _profiled(file, begin, end):
        begins = depth <= lowest
        if not begins and line[:1] in b"{[":
            if standing is None:
                standing = _standing(file, at, end, depth, lowest, later)
            while place < len(standing) and standing[place] < at:
                place += 1
            begins = place < len(standing) and standing[place] == at
        if group and begins:
            yield from _decoded(group)
            group = []
        group.append(line)
        depth += delta
        lowest = min(lowest, depth)
    if to > end:
        group += [line for _, line, _ in _profiled(file, end, to)]
    yield from _decoded(group)


def _decoded(lines: list[bytes]) -> Iterator[tuple[str, bool]]:
    text = b"\n".join(line.removesuffix(b"\r") for line in lines).decode("utf-8", "replace")
    at, decoder = 0, json.JSONDecoder()
    while True:
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        if at >= len(text):
            return
        try:
            _, end = decoder.raw_decode(text, at)
        except ValueError:
            yield text[at:], False
            return
        yield text[at:end], True
        at = end
