"""A state table: one current row per key, written as versions.

An upsert writes its own rows and nothing else, as one more segment. What belongs to the table is said by a
manifest, a small file that lists the segments; each change writes the next manifest, last of all. A change that fails
before has written files nobody reads, and readers that started earlier keep the manifest they opened. Two writers may
meet: the manifest of a number is created by exactly one of them, the other builds on the new one and tries again.

A read merges the segments: per key the row with the latest ``updated`` counts, of equal ones the one written last.
Small segments are merged when they become many (:func:`compact`), each into one of about the size of all that
follow, so that a row is rewritten a logarithmic number of times. A merged segment is split by key hash into as many
buckets as its rows need; a read of a few keys opens their buckets only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import drop_path

#: Rows of a bucket of a merged segment.
BUCKET_ROWS = 1_000_000
#: Segments that a table may have before an upsert merges the small ones.
MAX_SEGMENTS = 8


@dataclass(frozen=True)
class Segment:
    """A folder of rows; ``buckets`` is 0 for an upsert's own rows, which aren't split. ``number`` orders segments in time."""

    folder: str
    number: int
    rows: int
    buckets: int = 0


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    segments: tuple[Segment, ...] = ()
    schema: str = ""

    def text(self) -> str:
        return json.dumps({"schema": self.schema, "segments": [asdict(s) for s in self.segments]})

    @classmethod
    def read(cls, number: int, text: str) -> Manifest:
        stored = json.loads(text)
        return cls(number, tuple(Segment(**s) for s in stored["segments"]), stored["schema"])


class StateTable:
    """The table under ``path``, keyed by ``key``, its versions told by ``updated``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "job_id", updated: str = "updated_at"):
        self.spark, self.path, self.key, self.updated = spark, path.rstrip("/"), key, updated
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def manifest(self) -> Manifest:
        """The latest one; an absent table has no segments."""
        fs, folder = self._fs(), self._path("manifest")
        if not fs.exists(folder):
            return Manifest()
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."]
        if not numbers:
            return Manifest()
        stream = fs.open(self._path("manifest", f"{max(numbers):012d}.json"))
        try:
            return Manifest.read(max(numbers), self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, after: Manifest) -> bool:
        """Put a manifest in place whole, or tell that another writer took its number."""
        fs = self._fs()
        fs.mkdirs(self._path("manifest"))
        draft = self._path("manifest", f".{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(after.text().encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path("manifest", f"{after.number:012d}.json"), options)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def upsert(self, rows: DataFrame, max_segments: int = MAX_SEGMENTS) -> None:
        """Add versions of keys. The rows are written once, as they come; nothing that is there is rewritten, but for a merge."""
        folder, seen = f"segments/{uuid.uuid4().hex}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{folder}")
        while True:
            now = self.manifest()
            added = Segment(folder, max((s.number for s in now.segments), default=0) + 1, seen.get["n"])
            schema = now.schema or rows.schema.json()
            if self._commit(Manifest(now.number + 1, (*now.segments, added), schema)):
                break
        if len(now.segments) + 1 > max_segments:
            self.compact()

    def read(self, keys: Sequence | None = None) -> DataFrame:
        """The current row of every key, or of ``keys``."""
        now = self.manifest()
        if not now.segments:
            raise FileNotFoundError(f"no state table at {self.path}")
        return self._merged(now, now.segments, keys)

    def _merged(self, now: Manifest, segments: Sequence[Segment], keys: Sequence | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(now.schema))
        bucketed = T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())])
        parts = []
        for s in segments:
            part = self.spark.read.schema(bucketed if s.buckets else schema).parquet(f"{self.path}/{s.folder}")
            if keys is not None:
                if s.buckets:
                    asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([schema[self.key]]))
                    wanted = [r[0] for r in asked.select(self._bucket(s.buckets)).distinct().collect()]
                    part = part.filter(F.col("_bucket").isin(wanted))
                part = part.filter(F.col(self.key).isin(list(keys)))
            parts.append(part.select(*schema.names, F.lit(s.number).alias("_number")))
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        newest = F.max_by(F.struct(*[c for c in union.columns if c != "_number"]), F.struct(self.updated, "_number"))
        return union.groupBy(self.key).agg(newest.alias("_s")).select("_s.*")

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int").alias("_bucket")

    def compact(self, bucket_rows: int = BUCKET_ROWS, whole: bool = False) -> bool:
        """Merge the newest segments, as many as weigh no more than twice what follows them; ``whole`` merges all.

        False if another writer was first, or nothing is to be merged; the table is right either way.
        """
        now = self.manifest()
        first, follows = len(now.segments) - 1, 0
        while first >= 0 and (whole or first >= len(now.segments) - 2 or now.segments[first].rows <= 2 * follows):
            follows += now.segments[first].rows
            first -= 1
        merging = now.segments[first + 1 :]
        if len(merging) < 2:
            return False
        buckets = max(1, -(-sum(s.rows for s in merging) // bucket_rows))
        folder, seen = f"segments/{uuid.uuid4().hex}", Observation()
        merged = self._merged(now, merging).observe(seen, F.count(F.lit(1)).alias("n"))
        merged = merged.withColumn("_bucket", self._bucket(buckets)).repartition(buckets, "_bucket")
        merged.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        one = Segment(folder, merging[-1].number, seen.get["n"], buckets)
        return self._commit(replace(now, number=now.number + 1, segments=(*now.segments[: first + 1], one)))

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests but the last ``keep`` and segments that none of those lists; no reader may still use older ones.

        Segments that writers have begun but not committed look the same: run it while nobody writes.
        """
        fs, latest = self._fs(), self.manifest().number
        listed, deleted = set(), 0
        for status in fs.listStatus(self._path("manifest")):
            name = status.getPath().getName()
            number = int(name.removesuffix(".json")) if name.endswith(".json") else -1
            if number <= latest - keep:
                deleted += fs.delete(status.getPath(), False)
                continue
            stream = fs.open(status.getPath())
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            listed |= {s.folder for s in Manifest.read(number, text).segments}
        for status in fs.listStatus(self._path("segments")):
            folder = f"segments/{status.getPath().getName()}"
            if folder not in listed:
                deleted += drop_path(self.spark, f"{self.path}/{folder}")
        return deleted


def write_job_state(state: DataFrame, path: str, job: str = "job_id", updated: str = "updated_at") -> None:
    """Upsert one row per job; the row with the latest ``updated`` wins, of equal ones the one written last."""
    StateTable(state.sparkSession, path, job, updated).upsert(state)


def read_job_state(spark: SparkSession, path: str, job: str = "job_id", updated: str = "updated_at") -> DataFrame:
    return StateTable(spark, path, job, updated).read()
