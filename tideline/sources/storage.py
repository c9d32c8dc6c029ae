"""Stored files as a data source: prefixes are listed in parallel, in key order, from a key on and up to a number.

A listing walks folders in the order of full keys and leaves out every folder that can't hold a wanted key, so a start, a
prefix or a limit shortens the walk itself, not only its result. Nothing is listed on the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    StringStartsWith,
)

from tideline.sources.listing import glob_to_regex, list_bounded

FORMAT = "storage_listing"


def _file_system(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path there, and what its keys lack to be paths again."""
    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def walk(system: fs.FileSystem, folder: str, prefix: str, after: str | None) -> Iterator[fs.FileInfo]:
    """Files below ``folder`` in key order whose key begins with ``prefix`` and is greater than ``after``.

    A folder's key ends in a slash: keys of all it holds lie together in the order, so it is entered or left out whole.
    """
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    keyed = sorted((f.path + "/" * (f.type == fs.FileType.Directory), f) for f in found if f.type != fs.FileType.NotFound)
    for key, file in keyed:
        if key.endswith("/"):
            passed = after is not None and key < after and not after.startswith(key)
            if not passed and (key.startswith(prefix) or prefix.startswith(key)):
                yield from walk(system, file.path, prefix, after)
        elif key.startswith(prefix) and (after is None or key > after):
            yield file


class StorageListing(DataSource):
    """Options: ``paths`` (a JSON array of prefixes or keys), ``after``, ``limit`` (per prefix) and ``pattern`` (a regular expression)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path_index int, path string, size long, mtime timestamp"

    def reader(self, schema) -> StorageReader:
        return StorageReader(self.options)


class StorageReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])
        self.after, self.pattern = options.get("after"), options.get("pattern")
        self.limit = int(options["limit"]) if options.get("limit") else None
        self.starts: list[str] = []
        self.index: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds, prefixes and a place among the paths shorten the walk; Spark looks at all filters again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",):
                if isinstance(f, GreaterThan):
                    self.after = max(self.after or "", f.value)
                elif isinstance(f, (StringStartsWith, EqualTo)):
                    self.starts.append(f.value)
                elif isinstance(f, GreaterThanOrEqual) and f.value:
                    # All that is smaller than the value and its first possible predecessor.
                    self.after = max(self.after or "", f.value[:-1])
            elif isinstance(f, EqualTo) and f.attribute == ("path_index",):
                self.index = f.value
            yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, p)) for i, p in enumerate(self.paths) if self.index in (None, i)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # no prefix is wanted
            return
        index, path = partition.value
        system, prefix, scheme = _file_system(path)
        inner = [s.removeprefix(scheme) for s in (prefix, *self.starts)]
        narrow = max(inner, key=len)
        if not all(narrow.startswith(s) for s in inner):
            return
        after = self.after.removeprefix(scheme) if self.after is not None else None
        folder, n = narrow.rpartition("/")[0] or "/", 0
        for file in walk(system, folder, narrow, after):
            key = scheme + file.path
            if self.pattern and not re.fullmatch(self.pattern, key):
                continue
            yield index, key, file.size, file.mtime
            n += 1
            if n == self.limit:
                return


def list_keys(
    spark: SparkSession,
    paths: Sequence[str],
    max_results: int | None = None,
    start_after: str | tuple[str, int] | None = None,
    include: str | None = None,
) -> DataFrame:
    """``path_index, path, size, mtime`` of the files below prefixes (or equal to keys), one task per prefix.

    A file under two prefixes is listed for both. ``max_results`` takes the first in the order of (path, path_index), after
    ``start_after``: a key, or a key with the path_index of the row that was last, where keys repeat. ``include`` is a glob;
    what doesn't match it doesn't count.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StorageListing)
    reader = spark.read.format(FORMAT).option("paths", json.dumps(list(paths)))
    if include is not None:
        reader = reader.option("pattern", glob_to_regex(include))
    if max_results is not None:
        # With a place among repeated keys, the last key itself may be wanted once more by a later prefix.
        reader = reader.option("limit", max_results + isinstance(start_after, tuple))
    if isinstance(start_after, str):
        reader = reader.option("after", start_after)
    elif start_after is not None:
        reader = reader.option("after", start_after[0][:-1])
    if max_results is None and start_after is None:
        return reader.load()
    return list_bounded(reader.load(), max_results, start_after, ties=("path_index",))
