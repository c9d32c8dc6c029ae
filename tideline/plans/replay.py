"""Given tables as streams of several micro-batches, for the streaming queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_turn(rows: DataFrame, part: Column, path: str) -> DataFrame:
    """Replay ``rows`` as a stream of one file, and so one micro-batch, per value of ``part``, the smallest first.

    All parts are written by one job; the source takes files by their modification time, which is then set part by part.
    """
    spark = rows.sparkSession
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    tagged = rows.withColumn("_part", part.cast("long"))
    tagged.repartition("_part").write.partitionBy("_part").parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory()]
    parts.sort(key=lambda p: int(p.getName().partition("=")[2]))
    for turn, folder in enumerate(parts):
        for file in fs.listStatus(folder):
            fs.setTimes(file.getPath(), 1_000_000_000_000 + 1000 * turn, -1)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return reader.parquet(path)


def heartbeat(rows: DataFrame, **values: Column) -> DataFrame:
    """One row of nulls but for ``values``."""
    return rows.sparkSession.range(1).select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]
    )


def out_of_order_stream(rows: DataFrame, path: str, span_s: float, jitter_s: float) -> DataFrame:
    """Replay ``rows`` by one file per ``span_s`` of ``ts``, each row up to ``jitter_s`` late, and a heartbeat.

    The delay of a row follows its content. The last file holds one row of nulls but for a ``ts`` far
    ahead, which closes all windows.
    """
    late = F.pmod(F.xxhash64(*rows.columns), F.lit(1000)) / 1000.0 * jitter_s
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ahead = rows.agg(F.max("ts") + F.make_dt_interval(days=F.lit(400))).first()[0]
    beat = heartbeat(rows, ts=F.lit(ahead))
    parted = rows.withColumn("_turn", F.floor((seconds + late) / span_s))
    return in_turn(parted.unionByName(beat.withColumn("_turn", F.lit(1 << 40))), F.col("_turn"), path).drop("_turn")
