"""Shared helpers of the training-data operators: table access, scratch space, word pattern."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and the word it delimits (Java and RE2 syntax alike).
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast up to so many narrow rows (some 40 bytes each).
BROADCAST_ROWS = 1_000_000
_OWN_SCRATCH: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one where Spark is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_SCRATCH:
        _OWN_SCRATCH.append(tempfile.mkdtemp(prefix="spark-"))
    return _OWN_SCRATCH[0]


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder."""
    return f"{shared_root(spark)}/marlstone/{name}-{uuid.uuid4().hex}"


#: Spark's switch to delete the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch space and read it back: cuts lineage, survives lost executors, frees its shuffle files."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete tables of materialize() that no later step reads."""
    for df in written:
        hadoop = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(hadoop).delete(folder, True)


#: Rows of an Arrow batch at most, where whole texts pass through Python: bounds what a task holds beside the heap.
ARROW_ROWS = 4_000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ARROW_ROWS rows; a smaller setting of the user stands."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def releasing(run):
    """run (batches to batches) that gives Arrow's unused memory back when a task ends: Python workers live on for other stages."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint where a count shows that it is small; else the join shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text (null as empty), as two longs."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has (names differ by case alone nowhere)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
