"""Incremental batch processing of arriving files, and small stream helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.batching import assign_batches, collect_batches
from tideline.operators.execute import Handler, run_batches
from tideline.operators.ordering import numbered
from tideline.session import drop_path, fresh_path, materialise


def read_table_stream(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """A stream over the parquet files called ``name`` in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_to_end(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a stream over what is there now and return what it wrote to the shared folder.

    ``append`` writes parquet with the exactly-once file sink. ``update`` writes each epoch's
    changed rows to a folder of its own, which a repeated epoch overwrites; ``epoch`` orders them.
    """
    spark = stream.sparkSession
    path, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(path).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def save(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer.foreachBatch(save).start().awaitTermination()
    return spark.read.parquet(path)


def latest_updates(updates: DataFrame, key: str) -> DataFrame:
    """The last version of each key among the rows of an update stream."""
    columns = [c for c in updates.columns if c != "epoch"]
    return (
        updates.groupBy(key).agg(F.max_by(F.struct(*columns), "epoch").alias("_r")).select("_r.*")
    )


def stream_batches(
    items: DataFrame,
    order: str,
    item: str,
    batch_size: int,
    setup: Callable[[dict], Handler],
    path: str,
    checkpoint: str,
    config: dict | None = None,
    keys: Sequence[str] = (),
    bucket: int = 10_000,
) -> None:
    """Batch the items of a stream, run the handler on every full batch, and store the results.

    Batches of a job (``keys``) run on over micro-batches: what doesn't fill a batch is carried into the next
    micro-batch, with the number of batches given out so far. So the batches are those of
    :func:`~tideline.operators.batching.assign_batches` over all items, in the order of their arrival and within a micro-batch by
    ``order``. A row whose ``item`` is null is its job's last: it gives out the batch that is still open, short, and ends
    the job's numbers.

    The numbering of a micro-batch is parallel, also within a job; what is carried are fewer than ``batch_size`` items
    a job. Each epoch writes its results and its carried rows to folders of its own, from the carried rows of the epoch
    before, so an epoch that is repeated after a failure replaces both and nothing is lost or given out twice. The stream's
    checkpoint stands in for a queue.
    """
    job = list(keys) or ["_job"]
    rows = items if keys else items.withColumn("_job", F.lit(0))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    entry = f"struct<{order}:{kinds[order]},{item}:{kinds[item]}>"
    carried_schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in job), "_next long", f"_open array<{entry}>"])

    def process(arrived: DataFrame, epoch: int) -> None:
        session = arrived.sparkSession
        if epoch > 0:
            carried = session.read.schema(carried_schema).parquet(f"{checkpoint}/open/epoch={epoch - 1}")
        else:
            carried = session.createDataFrame([], carried_schema)
        waiting = carried.select(*job, F.posexplode("_open").alias("_place", "_e"))
        waiting = waiting.select(*job, F.col(f"_e.{order}").alias(order), F.col(f"_e.{item}").alias(item), "_place")
        new = arrived.filter(F.col(item).isNotNull()).select(*job, order, item, F.lit(None).cast("int").alias("_place"))
        # Carried items come first, in one bucket; after them the new ones by their order.
        all_items = waiting.unionByName(new).withColumn("_new", F.col("_place").isNull().cast("int"))
        section = F.when(F.col("_new") == 1, F.floor(F.col(order) / bucket)).cast("long")
        placed = numbered(all_items, job, ["_new", "_place", order], F.struct("_new", section.alias("_section")))
        placed = materialise(placed.select(*job, order, item, "pos"), "arrived")

        ended = arrived.filter(F.col(item).isNull()).select(*job).distinct().withColumn("_ended", F.lit(True))
        counts = placed.groupBy(*job).agg(F.count(F.lit(1)).alias("_n"))
        heads = carried.select(*job, "_next").join(counts, job, "full").join(ended, job, "left")
        n, ended_now = F.coalesce("_n", F.lit(0)), F.coalesce("_ended", F.lit(False))
        heads = heads.select(
            *job,
            F.coalesce("_next", F.lit(0)).alias("_next"),
            F.when(ended_now, n).otherwise(n - n % batch_size).alias("_given"),
            ended_now.alias("_ended"),
        )
        ready = placed.join(heads, job)
        full = assign_batches(ready.filter(F.col("pos") < F.col("_given")), batch_size)
        full = full.withColumn("batch_id", F.col("batch_id") + F.col("_next"))
        results = run_batches(collect_batches(full, item, job), setup, config, keep=(*job, "batch_id"))
        results.drop("_job").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

        left = ready.filter(F.col("pos") >= F.col("_given")).groupBy(*job)
        left = left.agg(F.sort_array(F.collect_list(F.struct("pos", order, item))).alias("_left"))
        after = heads.filter(~F.col("_ended")).join(left, job, "left").select(
            *job,
            (F.col("_next") + F.floor(F.col("_given") / batch_size)).alias("_next"),
            F.coalesce(F.transform("_left", lambda s: F.struct(s[order].alias(order), s[item].alias(item))), F.array().cast(f"array<{entry}>")).alias("_open"),
        )
        after.write.mode("overwrite").parquet(f"{checkpoint}/open/epoch={epoch}")
        if epoch > 1:  # a repeated epoch reads the one before it, never an earlier one
            drop_path(session, f"{checkpoint}/open/epoch={epoch - 2}")

    (
        rows.writeStream.option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(availableNow=True)
        .foreachBatch(process)
        .start()
        .awaitTermination()
    )
