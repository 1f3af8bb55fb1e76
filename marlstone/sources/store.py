"""Versioned tables on any Hadoop store, and relational sources (S15, S21, M6's swap).

A version is a folder with a number of its own. A commit claims a number, writes the folder, and then publishes the number; claims and publications are empty
files that the store creates only if absent. So a reader, who takes the highest published number, sees a version wholly or not at
all and always finds one after the first commit, and of two writers neither loses a version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, name: str):
    """A Hadoop path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    path, store = _path(spark, folder)
    return [int(x.getPath().getName()) for x in store.listStatus(path)] if store.exists(path) else []


def _create(spark: SparkSession, name: str) -> bool:
    """Whether this call made the empty file."""
    path, store = _path(spark, name)
    store.mkdirs(path.getParent())
    return store.createNewFile(path)


def commit(df: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write df as a new version of the table at root and make it current."""
    spark = df.sparkSession
    number = max(_numbers(spark, f"{root}/_claimed"), default=0) + 1
    while not _create(spark, f"{root}/_claimed/{number}"):
        number += 1
    df.write.partitionBy(*partition_by).parquet(f"{root}/v-{number}")
    _create(spark, f"{root}/_current/{number}")
    return f"v-{number}"


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The current version, or None before the first commit."""
    number = max(_numbers(spark, f"{root}/_current"), default=None)
    return None if number is None else spark.read.parquet(f"{root}/v-{number}")


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational source; pass partitionColumn, lowerBound, upperBound and numPartitions for parallel reads."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Append to or replace a table of a relational sink."""
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, **options).save()


def read_graph_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A CSV file with headers, every column as text; unnamed columns are null."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    from pyspark.sql import functions as F

    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])
