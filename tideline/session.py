"""Session helpers: time zone, shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tideline", cpus: str | int = "*", partitions: int | None = None) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone, so that NTZ columns and epoch values agree on any machine."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A machine-local folder stands in only where the session is local and names none.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tideline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


#: Paths below the shared folder that this process has handed out.
_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder; :func:`release` deletes what was written there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all it holds; False where there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))


def release(spark: SparkSession) -> int:
    """Delete the stages of this process: for callers who have read the results that rest on them."""
    deleted = 0
    while _made:
        deleted += drop_path(spark, _made.pop())
    return deleted


def shares(scan: DataFrame, rows: int) -> int:
    """The number of tasks that hold about ``rows`` rows of a scan each, one per core at least."""
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // rows))


def spread(scan: DataFrame, tasks: int | None = None) -> DataFrame:
    """Give every core a share of a small scan (one file, one task) ahead of heavy per-row work.

    A scan that already has a task per core, or as many as ``tasks``, is returned as it is, so large inputs never
    shuffle unless :func:`shares` asks for it. Pass plain scans and projections of them.
    """
    tasks = tasks or scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Let Arrow batches on their way to Python hold at most ``size`` bytes, or what is set if that is less.

    A batch stands in memory on both sides. Spark's own limit is 64 MB or 10,000 rows, which long texts reach.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))
    if not 0 < now <= size:
        spark.conf.set(name, str(size))


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and fixes values that may differ
    between two evaluations, such as range-partition numbers.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
