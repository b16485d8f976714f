"""Structured Streaming: mini-batch k-means and incremental indexing, safe to replay.

State lives in folders named by batch id, so a batch that runs again overwrites what it wrote before and starts
from the state before it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clustering import MinibatchKMeans
from ..operators.ivf import IVFPQIndex
from ..sources import scratch


def _write_state(spark: SparkSession, path: str, batch: int, model: MinibatchKMeans) -> None:
    rows = [(i, c.tolist(), float(n), model.inertia, model.error) for i, (c, n) in enumerate(zip(model.centroids, model.counts, strict=True))]
    state = spark.createDataFrame(rows, "cell int, centroid array<double>, n double, inertia double, error double")
    state.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest state (of a batch before `before`): batch, cell, centroid, n, inertia, error."""
    try:
        state = spark.read.parquet(path)
    except AnalysisException:
        return None
    if before is not None:
        state = state.where(F.col("batch") < before)
    newest = state.agg(F.max("batch")).first()[0]
    return None if newest is None else state.where(F.col("batch") == newest)


def minibatch_kmeans(stream: DataFrame, path: str, checkpoint: str, n_clusters: int, distance: str = "euclidean", seed: int = 0, init: np.ndarray | None = None) -> StreamingQuery:
    """Fits mini-batch k-means to a stream of (id, vec) until its available input is used up."""

    def fit(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark, model = batch.sparkSession, MinibatchKMeans(n_clusters, distance, seed)
        if (old := read_state(spark, path, number)) is not None:
            rows = old.orderBy("cell").collect()  # k rows
            model.centroids, model.counts = np.array([r["centroid"] for r in rows]), np.array([r["n"] for r in rows])
        batch = batch.persist()
        model.fit_minibatch(batch, init)
        batch.unpersist()
        _write_state(spark, path, number, model)

    return stream.writeStream.foreachBatch(fit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _appended(make: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, number: make(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")


def _ordered(batch: DataFrame, otherwise: int) -> DataFrame:
    """The batch with seq; where the stream has none, one number for all."""
    return batch if "seq" in batch.columns else batch.withColumn("seq", F.lit(otherwise).cast("long"))


def _coded(index: IVFPQIndex, batch: DataFrame) -> DataFrame:
    """id, cell, code, seq: codes do not carry seq, so rows are told apart by their number in the batch."""
    rows = scratch.cut(batch.withColumn("_row", F.monotonically_increasing_id()))
    codes = index.encode(rows.select(F.col("_row").alias("id"), "vec")).withColumnRenamed("id", "_row")
    return codes.join(rows.select("_row", F.col("id").cast("long").alias("id"), F.col("seq").cast("long").alias("seq")), "_row").select("id", "cell", "code", "seq")


def index_adds(stream: DataFrame, index: IVFPQIndex, path: str, checkpoint: str) -> StreamingQuery:
    """Encodes a stream of (id, vec and, if it has it, seq) into the codes table at path."""
    make = lambda batch: _coded(index, _ordered(batch, 0))
    return stream.writeStream.foreachBatch(_appended(make, f"{path}/codes")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _named(batch: DataFrame) -> DataFrame:
    return _ordered(batch, 1).groupBy(F.col("id").cast("long").alias("id")).agg(F.max(F.col("seq").cast("long")).alias("seq"))


def index_removes(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of ids (and, if it has it, seq) to the table of deletes at path."""
    return stream.writeStream.foreachBatch(_appended(_named, f"{path}/deletes")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_changes(stream: DataFrame, index: IVFPQIndex, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of adds and removes in one: (id, vec, removed, seq)."""

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        _appended(lambda b: _coded(index, b), f"{path}/codes")(batch.where("not removed").select("id", "vec", "seq"), number)
        _appended(_named, f"{path}/deletes")(batch.where("removed").select("id", "seq"), number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_codes(spark: SparkSession, path: str) -> DataFrame:
    """id, cell, code of what was added and not removed later: no remove of its id has a larger seq. Streams without seq give
    their adds 0 and their removes 1, so that a remove hides whatever was added."""
    codes = spark.read.parquet(f"{path}/codes").drop("batch")
    try:
        deletes = spark.read.parquet(f"{path}/deletes")
    except AnalysisException:
        return codes.drop("seq")
    last = deletes.groupBy("id").agg(F.max("seq").alias("_last"))
    return codes.join(last, (codes["id"] == last["id"]) & (codes["seq"] < last["_last"]), "left_anti").select("id", "cell", "code")
