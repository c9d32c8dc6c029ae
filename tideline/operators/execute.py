"""Running a user's handler over batches, with failure isolation, retries and dead letters."""

from __future__ import annotations

import json
import multiprocessing
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.numeric import hash_bucket

Handler = Callable[[dict], Any]

RUN_FIELDS = [
    T.StructField("result", T.StringType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("secs", T.DoubleType()),
    T.StructField("error", T.StringType()),
]


def run_batches(
    batches: DataFrame,
    setup: Callable[[dict], Handler],
    config: dict | None = None,
    keep: tuple[str, ...] = ("job_id", "batch_id"),
    max_attempts: int = 1,
    deadline_s: float | None = None,
) -> DataFrame:
    """Apply a handler to every batch (one row each) and report how it went.

    ``setup(config)`` runs once per task and returns the handler, which gets the row as a
    dict and returns anything JSON can hold. A handler that raises fails its own batch only:
    the row comes back with ``ok = false``, the error text and a null result. Parallelism is
    that of ``batches``; repartition it beforehand to match the handler's cost.

    With ``deadline_s`` the handler runs in a process of its own beside the task (:class:`_Apart`). A try that takes
    longer, or that ends its process (a crash of native code, an exit, too much memory), is a failed try
    like any other, and the next one gets a new process, for which ``setup`` is called again.
    """
    if max_attempts < 1:
        raise ValueError("max_attempts must be at least 1")
    schema = T.StructType([batches.schema[c] for c in keep] + RUN_FIELDS)
    settings = dict(config or {})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        handler = None
        try:
            for frame in frames:
                if handler is None:
                    handler = setup(settings) if deadline_s is None else _Apart(setup, settings, deadline_s)
                yield reported(frame, [_attempt(handler, row, max_attempts) for row in frame.to_dict("records")])
        finally:
            if isinstance(handler, _Apart):
                handler.stop()

    def reported(frame: pd.DataFrame, outcomes: list[tuple]) -> pd.DataFrame:
        done = pd.DataFrame(outcomes, columns=[f.name for f in RUN_FIELDS])
        return pd.concat([frame[list(keep)].reset_index(drop=True), done], axis=1)

    return batches.mapInPandas(work, schema)


class _Apart:
    """A handler in a process of its own, which is replaced once it has died or was too slow.

    The process is a copy of the task's, so handlers needn't be sent; rows go there and JSON texts come back.
    """

    def __init__(self, setup: Callable[[dict], Handler], settings: dict, deadline_s: float):
        self.setup, self.settings, self.deadline_s = setup, settings, deadline_s
        self.process = self.line = None

    def _start(self) -> None:
        copies = multiprocessing.get_context("fork")
        self.line, theirs = copies.Pipe()
        self.process = copies.Process(target=_serve, args=(theirs, self.line, self.setup, self.settings), daemon=True)
        self.process.start()
        theirs.close()

    def stop(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.line.close()
            self.process = None

    def __call__(self, row: dict) -> _Json:
        if self.process is None:
            self._start()
        try:
            self.line.send(row)
            if not self.line.poll(self.deadline_s):
                self.stop()
                raise TimeoutError(f"no answer within {self.deadline_s} s")
            ok, text = self.line.recv()
        except (EOFError, BrokenPipeError, ConnectionResetError):
            self.process.join()
            code = self.process.exitcode
            self.stop()
            raise RuntimeError(f"the handler's process ended with code {code}") from None
        if ok:
            return _Json(text)
        raise _Told(text)


class _Json(str):
    """A result that is JSON already."""


class _Told(Exception):
    """An error that the handler's process has put in words."""


def _serve(line, other_end, setup: Callable[[dict], Handler], settings: dict) -> None:
    other_end.close()  # so that the end of the task is seen
    handler = None
    while True:
        try:
            row = line.recv()
        except EOFError:
            return
        try:
            handler = handler or setup(settings)
            answer = True, json.dumps(handler(row), default=_plain)
        except Exception as failure:
            answer = False, f"{type(failure).__name__}: {failure}"
        line.send(answer)


def _plain(value):
    """Arrays and numbers of numpy as JSON holds them."""
    if hasattr(value, "tolist"):
        return value.tolist()
    raise TypeError(f"{type(value).__name__} is not JSON")


def _attempt(handler: Handler, row: dict, max_attempts: int) -> tuple:
    error = None
    for attempt in range(1, max_attempts + 1):
        start = time.perf_counter()
        try:
            result = handler(row)
            result = str(result) if isinstance(result, _Json) else json.dumps(result, default=_plain)
            return result, True, attempt, time.perf_counter() - start, None
        except Exception as failure:  # the batch fails, never the job
            error = str(failure) if isinstance(failure, _Told) else f"{type(failure).__name__}: {failure}"
    return None, False, max_attempts, None, error


def run_with_dead_letters(
    batches: DataFrame,
    setup: Callable[[dict], Handler],
    max_receive_count: int,
    config: dict | None = None,
    keep: tuple[str, ...] = ("job_id", "batch_id"),
    deadline_s: float | None = None,
) -> DataFrame:
    """As :func:`run_batches` with up to ``max_receive_count`` tries; adds ``dead_letter`` and
    ``failed_attempts`` (every failed try counts as a failure)."""
    runs = run_batches(batches, setup, config, keep, max_receive_count, deadline_s)
    return runs.withColumn("dead_letter", ~F.col("ok")).withColumn(
        "failed_attempts", F.col("attempts") - F.col("ok").cast("int")
    )


def split_dead_letters(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results and dead letters; write ``runs`` first if the handler must not run twice."""
    return runs.filter(~F.col("dead_letter")), runs.filter("dead_letter")


def _record(spark: SparkSession, path: str) -> bool:
    """Whether the step that leaves a record at ``path`` was finished."""
    try:
        return spark.read.schema("done boolean").parquet(path).first() is not None
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def on_complete(results: DataFrame, path: str, hook: Callable[[DataFrame], Any], expected: int | None = None) -> Any:
    """Write the results, then call ``hook`` with the stored table, once however often the job is run.

    The write is the barrier: the hook runs only after every batch is done. If ``expected`` is given and
    batches are missing, the hook is withheld and an error raised. Both steps leave a record beside ``path`` when they
    are through: a run that finds the results stored doesn't compute them again, and one that finds
    the hook done returns None. A hook that was cut off is called again.
    """
    spark = results.sparkSession
    if _record(spark, f"{path}-completed"):
        return None
    done = spark.range(1).selectExpr("true AS done")
    if not _record(spark, f"{path}-stored"):
        results.write.mode("overwrite").parquet(path)
        done.write.mode("overwrite").parquet(f"{path}-stored")
    stored = spark.read.schema(results.schema).parquet(path)
    if expected is not None:
        found = stored.count()
        if found != expected:
            raise RuntimeError(f"{expected - found} batches remain")
    value = hook(stored)
    done.write.mode("overwrite").parquet(f"{path}-completed")
    return value


def sum_items(batches: DataFrame, items: str = "items") -> DataFrame:
    """The example handler without Python: the sum of each integer list."""
    return batches.withColumn("total", F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x))


def centroids(vectors: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(label, mean): the mean vector of each label, averaged per dimension before anything is gathered."""
    return (
        vectors.select(label, F.posexplode(vector).alias("i", "x"))
        .groupBy(label, "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(label)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    )


def classify(vectors: DataFrame, means: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vectors`` with ``class``, the label of the centroid of the highest dot product (the larger label of equals).

    The centroids are one array value of the plan, so vectors are scored where they are read. A null
    vector, and any vector when there are no centroids, has a null class.
    """
    model = means.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "mean")))).scalar()

    def dot(mean: Column) -> Column:
        products = F.zip_with(vector, mean, lambda x, y: x.cast("double") * y)
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    scores = F.transform("_model", lambda c: F.struct(dot(c["mean"]).alias("score"), c["label"].alias("label")))
    held = vectors.withColumn("_model", model)
    return held.withColumn("class", F.when(F.col(vector).isNotNull(), F.array_max(scores)["label"])).drop("_model")


def train_classifier(
    vectors: DataFrame,
    path: str | None = None,
    key: str = "vec_id",
    features: str = "embedding",
    label: str = "label",
    salt: str = "split",
) -> DataFrame:
    """Split, fit a multinomial logistic regression, score the held-out part, save the model.

    A quarter of the rows is held out, by a digest of their key, so the split is the same in every evaluation and
    engine. One row: ``n_train, n_test, accuracy``.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(
        hash_bucket(F.col(key), salt, 4).alias("part"),
        array_to_vector(F.col(features).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("label"),
    )
    train, test = rows.filter("part > 0"), rows.filter("part = 0")
    model = LogisticRegression(family="multinomial", maxIter=50).fit(train)
    if path is not None:
        model.write().overwrite().save(path)
    scored = model.transform(test)
    n_train = train.agg(F.count(F.lit(1))).scalar()
    held_out = scored.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
    )
    return held_out.select(n_train.alias("n_train"), "n_test", "accuracy")
