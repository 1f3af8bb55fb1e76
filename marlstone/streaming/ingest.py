"""Continuous ingestion: new rows join the current index once.

A file stream is read in micro-batches (T4: maxFilesPerTrigger bounds a slice). Ids that the stream has delivered are kept
as keyed state in RocksDB, changed by each batch's rows alone, so the time of a batch does not grow with the index; rows
that an upstream delivers again, in whatever file, add nothing (T3). A batch that Spark itself repeats after a failure replaces
its own folder.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keywords import ranked_terms

INDEX = "id long, digest string, keywords array<string>"


_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that the cluster names in spark.checkpoint.dir; a temporary one where Spark is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="spark-"))
        root = _OWN_FOLDER[0]
    return f"{root.rstrip('/')}/marlstone/{name}-{uuid.uuid4().hex}"


def indexed(batch: DataFrame) -> DataFrame:
    """The index's columns of a batch."""
    return batch.select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"), ranked_terms(F.col("text")).alias("keywords"))


_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def start(spark: SparkSession, source: str, target: str, checkpoint: str, every: str | None = None, files: int = 100):
    """A query that adds source (Parquet folder) to target, each doc_id once; every: polling interval, else what is there now.

    A restart with the same checkpoint knows all earlier ids.
    """
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).dropDuplicates(["doc_id"])
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, number: int) -> None:
        indexed(batch).write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

    before = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:  # a query takes the session's settings when it starts
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def index(spark: SparkSession, target: str) -> DataFrame:
    """What the batches of all runs have added."""
    return spark.read.schema(INDEX).option("basePath", target).parquet(f"{target}/run=*/batch=*")


def ingest_available(spark: SparkSession, source: str) -> DataFrame:
    """Add all of source to a fresh index, then all of it again as files of another name, which must change nothing; the index."""
    target, checkpoint, inbox = (shared_folder(spark, n) for n in ("stream-index", "stream-checkpoint", "stream-inbox"))
    rows = spark.read.parquet(_folder(source))
    for _ in range(2):
        rows.write.mode("append").parquet(inbox)
        start(spark, inbox, target, checkpoint).awaitTermination()
    return index(spark, target)


def _folder(source: str) -> str:
    """Streams read folders; a single file is matched as a pattern."""
    return source if not source.endswith(".parquet") else f"{source[:-1]}[t]"
