"""Validation of commands, previews and collections, and the options catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of commands and previews.
MAX_EMBED_BATCH, MAX_PREVIEW_REFERENCES, MAX_PREVIEW_DOCUMENTS = 512, 100, 20
COLLECTION = r"^[A-Za-z_][A-Za-z0-9_]{0,254}$"


def command_code() -> Column:
    """First reason why an index command can't run: identifier, economy's rules, batch range; null if it can."""
    blank = F.trim("document_id") == ""
    economy = (F.col("technique") == "economy") & ((F.col("mode") != "general") | F.col("model").isNotNull())
    unknown = ~F.col("technique").isin("economy", "high_quality") | ~F.col("mode").isin("general", "parent_child")
    batch = ~F.col("batch").between(1, MAX_EMBED_BATCH)
    return F.when(blank, "INVALID_IDENTIFIER").when(unknown, "UNKNOWN_MODE").when(economy, "ECONOMY_MODE").when(batch, "INVALID_BATCH")


def collection_name_valid(name: Column) -> Column:
    """A letter or underscore, then letters, digits and underscores, 255 at most."""
    return F.coalesce(name.rlike(COLLECTION), F.lit(False))


def preview_code(ids: list) -> str | None:
    """At most 100 references to at most 20 documents, and at least one."""
    if not ids:
        return "PREVIEW_EMPTY"
    if len(ids) > MAX_PREVIEW_REFERENCES or len(set(ids)) > MAX_PREVIEW_DOCUMENTS:
        return "PREVIEW_LIMIT_EXCEEDED"
    return None


def preview_ids(document_id: Column, local_id: Column) -> Column:
    """Name of a previewed chunk."""
    return F.concat(document_id.cast("string"), F.lit(":"), local_id)


def collection_mismatch(found: T.StructType, expected: T.StructType, dimension: int, expected_dimension: int) -> str | None:
    """Why a stored collection can't be used, or None when schema and dimension match exactly."""
    if [(f.name, f.dataType) for f in found] != [(f.name, f.dataType) for f in expected]:
        return "schema differs"
    return None if dimension == expected_dimension else f"dimension {dimension}, expected {expected_dimension}"


def options_catalogue(spark: SparkSession) -> DataFrame:
    """Kind, name, value of what a user may choose."""
    rows = [("technique", n, "") for n in ("economy", "high_quality")] + [("mode", n, "") for n in ("general", "parent_child")] + [("retrieval", n, "") for n in ("vector", "full_text", "hybrid", "graph")]
    rows += [("default", "max_length", "1024"), ("default", "overlap", "100"), ("default", "separator", "\\n"), ("limit", "separator", "100"), ("limit", "embed_batch", str(MAX_EMBED_BATCH)), ("limit", "preview_documents", str(MAX_PREVIEW_DOCUMENTS))]
    return spark.createDataFrame(rows, "kind string, name string, value string")


def setting(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A value of spark.marlstone.<name>; functions take parameters, this is for engine-wide ones."""
    return spark.conf.get(f"spark.marlstone.{name}", default)
