"""Ingest of a batch of uploads that leaves nothing behind where it fails."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..shipping import ship_package
from .decode import archive_code, upload_code

log = logging.getLogger(__name__)
STORED = "document_id string, name string, suffix string, sha256 string, size long, content binary"
ARCHIVES = (".docx", ".xlsx")


class ConfigurationError(ValueError):
    """The indexing configuration contradicts itself."""


@dataclass(frozen=True)
class Ingested:
    """documents: document_id, name, sha256, duplicate. rejected: name, code. status: queued, pending (not dispatched) or rejected (nothing accepted)."""

    batch: str
    documents: DataFrame
    rejected: DataFrame
    status: str


def check_configuration(config: dict) -> dict:
    """config with its defaults; an error where its technique and its segmentation don't go together."""
    if not isinstance(config, dict):
        raise ConfigurationError("the configuration must be an object")
    full = {"indexing_technique": "high_quality", "embedding_model": "bge-m3", "segmentation": {"mode": "general"}} | config
    if full["indexing_technique"] not in ("high_quality", "economy"):
        raise ConfigurationError("unknown indexing technique")
    if full["indexing_technique"] == "economy" and full["segmentation"].get("mode") == "parent_child":
        raise ConfigurationError("parent-child segmentation requires high-quality indexing")
    if full["indexing_technique"] == "high_quality" and not full["embedding_model"]:
        raise ConfigurationError("high-quality indexing requires an embedding model")
    return full


def stored(spark: SparkSession, root: str) -> DataFrame:
    """All uploads below root."""
    try:
        return spark.read.schema(STORED).option("recursiveFileLookup", "true").parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


@F.pandas_udf(StringType())
def _archive_code(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in contents:
        yield part.map(lambda data: archive_code(bytes(data)), na_action="ignore").astype(object)


def checked(files: DataFrame) -> DataFrame:
    """Name, content, suffix, sha256, size, code (null: acceptable) of files (name, content); null content is empty, a null name has no suffix."""
    ship_package(files.sparkSession)
    content = F.coalesce("content", F.lit(b""))
    named = files.select("name", content.alias("content"), F.lower(F.regexp_extract(F.trim(F.coalesce("name", F.lit(""))), r"\.[^./\\]*$", 0)).alias("suffix"))
    zipped = F.col("suffix").isin(*ARCHIVES)
    first = F.when(F.length("content") == 0, "EMPTY_FILE").otherwise(upload_code(F.col("suffix"), F.col("content")))
    code = F.coalesce(first, F.when(zipped, _archive_code(F.when(zipped & first.isNull(), F.col("content")))))
    return named.select("*", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"), F.coalesce(code, F.when(F.col("suffix") == "", "UNSUPPORTED_FILE_TYPE")).alias("code"))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ingest(files: DataFrame, root: str, config: dict, confirm: Callable[[DataFrame, dict], None], dispatch: Callable[[DataFrame], None] | None = None, delete: Callable = _delete) -> Ingested:
    """Check the configuration, store the acceptable files, confirm them, hand them on.

    The batch is one folder below root. If storing or confirm(documents, config) fails, the folder is deleted and the error
    raised again; a folder that can't be deleted is logged, for a later clean-up. What earlier batches stored stays: such
    content (by sha256) is a duplicate, keeps its document_id and isn't written again, as are repeats within the batch, of
    which the first by name counts. A failing dispatch leaves the batch stored and its status pending. An empty table of
    files is rejected as a whole. Errors of single files are rows of rejected.
    """
    spark, config = files.sparkSession, check_configuration(config)
    batch = uuid.uuid4().hex
    folder, judged = f"{root.rstrip('/')}/{batch}", checked(files)
    known = stored(spark, root).select("sha256", "document_id")
    try:
        accepted = judged.where("code is null")
        # contents aren't aggregated: names are, and the smallest one of a digest picks its row
        names = accepted.groupBy("sha256").agg(F.min(F.struct("name", "suffix")).alias("first")).join(known, "sha256", "left_anti").select("sha256", "first.*")
        new = accepted.join(names, ["sha256", "name", "suffix"], "left_semi").dropDuplicates(["sha256"])
        new.select(F.concat(F.lit(batch[:8] + "-"), F.substring("sha256", 1, 24)).alias("document_id"), "name", "suffix", "sha256", "size", "content").write.parquet(folder)
        written = spark.read.schema(STORED).parquet(folder).select("sha256", "document_id", "name")
        listed = accepted.select("name", "sha256").distinct()
        ours = written.select("sha256", "document_id", F.col("name").alias("__first"))
        earlier = known.groupBy("sha256").agg(F.min("document_id").alias("document_id")).withColumn("__first", F.lit(None).cast("string"))
        documents = listed.join(ours.unionByName(earlier), "sha256").select("document_id", "name", "sha256", (~F.col("name").eqNullSafe(F.col("__first"))).alias("duplicate"))
        rejected = judged.where("code is not null").select("name", "code")
        if documents.isEmpty():
            delete(spark, folder)
            return Ingested(batch, documents, rejected, "rejected")
        confirm(documents, config)
    except Exception:
        try:
            delete(spark, folder)
        except Exception:
            log.warning("uploads of batch %s are left for clean-up", batch)
        raise
    try:
        if dispatch:
            dispatch(documents)
    except Exception:
        log.warning("batch %s is stored but not dispatched", batch)
        return Ingested(batch, documents, rejected, "pending")
    return Ingested(batch, documents, rejected, "queued")
