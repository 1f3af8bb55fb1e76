"""Heartbeats as keyed state: count and monotonic progress of each worker, with expiry.

Progress never falls. A key without a beat for the lease time gives one expired row and loses its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ingest import _folder, shared_folder

OUTPUT = "id long, beats long, progress long, expired boolean"
STATE = "beats long, progress long"


def track(beats: DataFrame, lease_ms: int = 300_000) -> DataFrame:
    """Updates (id, beats, progress, expired) of a stream of (id, progress)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, progress = state.get
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "beats": [n], "progress": [progress], "expired": [True]})
            return
        n, progress = state.get if state.exists else (0, 0)
        for frame in frames:
            n += len(frame)
            progress = max(progress, int(frame["progress"].max()))
        state.update((n, progress))
        state.setTimeoutDuration(lease_ms)
        yield pd.DataFrame({"id": [key[0]], "beats": [n], "progress": [progress], "expired": [False]})

    return beats.groupBy("id").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def run_available(updates: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream over what is there now, then stop.

    Processing-time timers ask for one batch without data after another, so a bounded run
    does without those; keys that have expired are told in its next batch with data.
    """
    spark, name = updates.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        query = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()


def progress_available(spark: SparkSession, source: str) -> DataFrame:
    """Last state of every key after all of source (events) went through the stream."""
    out = shared_folder(spark, "lease-updates")
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(_folder(source)).select(F.col("user_id").alias("id"), F.rint("value").cast("long").alias("progress"))

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    run_available(track(stream), save, shared_folder(spark, "lease-checkpoint"))
    rows = spark.read.schema(f"{OUTPUT}, batch long").parquet(out).where("not expired")
    return rows.groupBy("id").agg(F.max("beats").alias("beats"), F.max("progress").alias("progress"))
