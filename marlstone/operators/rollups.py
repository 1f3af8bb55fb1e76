"""Roll-ups over knowledge-base metadata: counts, flags, derived status, statistics, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dealing import dealt, tasks_for

#: States that count as in progress or failed.
DOCUMENT_BUSY = ("downloading", "parsing", "splitting", "embedding", "indexing", "queued", "retry_wait")
DOCUMENT_FAILED = ("error", "failed")
JOB_BUSY = ("pending", "queued", "running", "retry_wait")
JOB_FAILED = ("failed", "partial_success")
#: Permissions behind each visibility filter.
VISIBILITY = {"private": ("private", "only_me"), "team": ("team", "all_team_members"), "public": ("public", "all_members")}


def flag(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0)).cast("long")


def document_counts(docs: DataFrame) -> DataFrame:
    """A1: documents of each dataset; usable ones alone set the processing and failed flags."""
    usable = F.col("enabled") & ~F.col("archived")
    return docs.where(~F.col("deleted")).groupBy("dataset_id").agg(
        F.count("id").alias("document_count"), flag(usable & F.col("indexing_status").isin(*DOCUMENT_BUSY)).alias("processing"), flag(usable & F.col("indexing_status").isin(*DOCUMENT_FAILED)).alias("failed")
    )


def chunk_counts(segments: DataFrame, docs: DataFrame, indexes: DataFrame) -> DataFrame:
    """Usable segments of each dataset; those without an index count while their document is completed."""
    d = docs.select(F.col("id").alias("document_id"), "dataset_id", F.col("indexing_status").alias("document_status"), (~F.col("deleted") & F.col("enabled") & ~F.col("archived")).alias("usable"))
    i = indexes.select(F.col("id").alias("dataset_index_id"), "dataset_id", ((F.col("status") == "active") & ~F.col("deleted")).alias("live"))
    ready = segments.where(~F.col("deleted") & (F.col("status") == "completed") & F.col("embedding_status").isin("completed", "not_required"))
    joined = ready.join(d, ["document_id", "dataset_id"]).join(i, ["dataset_index_id", "dataset_id"], "left")
    legacy = F.col("dataset_index_id").isNull() & (F.col("document_status") == "completed")
    return joined.where(F.col("usable") & (legacy | F.coalesce("live", F.lit(False)))).groupBy("dataset_id").agg(F.count("*").alias("chunk_count"))


def job_flags(jobs: DataFrame) -> DataFrame:
    """A dataset processes while any job does; it failed if its latest job did."""
    latest = F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc("created_at"), F.desc("id")))
    ranked = jobs.select("dataset_id", "status", latest.alias("rank"))
    return ranked.groupBy("dataset_id").agg(flag(F.col("status").isin(*JOB_BUSY)).alias("processing"), flag((F.col("rank") == 1) & F.col("status").isin(*JOB_FAILED)).alias("failed"))


def derived_status(processing: Column, chunks: Column, failed: Column) -> Column:
    """A4: indexing before ready before failed before draft."""
    return F.when(processing, "indexing").when(chunks > 0, "ready").when(failed, "failed").otherwise("draft")


def summaries(datasets: DataFrame, docs: DataFrame, segments: DataFrame, indexes: DataFrame, jobs: DataFrame) -> DataFrame:
    """dataset_id, document_count, chunk_count, status of every dataset that isn't deleted."""
    d = document_counts(docs).withColumnsRenamed({"processing": "d_busy", "failed": "d_failed"})
    j = job_flags(jobs).withColumnsRenamed({"processing": "j_busy", "failed": "j_failed"})
    live = datasets.where(~F.col("deleted")).select(F.col("id").alias("dataset_id"))
    joined = live.join(d, "dataset_id", "left").join(chunk_counts(segments, docs, indexes), "dataset_id", "left").join(j, "dataset_id", "left")
    on = lambda a, b: (F.coalesce(a, F.lit(0)) == 1) | (F.coalesce(b, F.lit(0)) == 1)
    chunks = F.coalesce("chunk_count", F.lit(0)).cast("long")
    status = derived_status(on(F.col("d_busy"), F.col("j_busy")), chunks, on(F.col("d_failed"), F.col("j_failed")))
    return joined.select("dataset_id", F.coalesce("document_count", F.lit(0)).cast("long").alias("document_count"), chunks.alias("chunk_count"), status.alias("status"))


def stats(summary: DataFrame) -> DataFrame:
    """A5: one row of totals, zeros for no datasets."""
    count = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, 1).otherwise(0)), F.lit(0)).cast("long").alias(s)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return summary.agg(F.count("*").alias("total"), *map(count, ("ready", "indexing", "draft", "failed")), total("document_count", "documents"), total("chunk_count", "chunks"))


def matches(q: str) -> Column:
    """Name, description or type contains q in any case; % and _ keep their meaning."""
    return F.col("name").ilike(f"%{q}%") | F.col("description").ilike(f"%{q}%") | F.col("dataset_type").ilike(f"%{q}%")


def visible(visibility: str) -> Column:
    """Permissions that a visibility filter covers; other names filter nothing."""
    return F.col("permission").isin(*VISIBILITY[visibility]) if visibility in VISIBILITY else F.lit(True)


def dataset_page(datasets: DataFrame, summary: DataFrame, page: int, size: int, status: str = "all", visibility: str = "all", q: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of datasets, and the count of all that match."""
    found = datasets.where(visible(visibility)).join(summary, datasets["id"] == summary["dataset_id"])
    found = found.where(matches(q)) if q else found
    found = found if status == "all" else found.where(F.col("status") == status)
    order = (F.col("updated").desc_nulls_last(), F.col("created_at").desc(), F.col("id").asc())
    return found.orderBy(*order).offset((page - 1) * size).limit(size), found.agg(F.count("*").alias("total"))


def document_page(docs: DataFrame, dataset_id: int, page: int, size: int) -> DataFrame:
    """Live documents of a dataset by position, then id."""
    return docs.where((F.col("dataset_id") == dataset_id) & ~F.col("deleted")).orderBy("position", "id").offset((page - 1) * size).limit(size)


def job_page(jobs: DataFrame, dataset_id: int, size: int) -> DataFrame:
    """Latest jobs first; ties by id, which the reference leaves open."""
    return jobs.where(F.col("dataset_id") == dataset_id).orderBy(F.desc("created_at"), F.desc("id")).limit(size)


def terminal_status() -> Column:
    """A7, as an aggregate: all completed, all cancelled, some completed, or failed."""
    total = F.count("*")
    done, cancelled = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "cancelled")
    return F.when(done == total, "completed").when(cancelled == total, "cancelled").when(done > 0, "partial_success").otherwise("failed")


def job_summary(job_documents: DataFrame) -> DataFrame:
    """Counts, progress, status and first running stage of each job.

    A job whose rows are completed and cancelled, none failed, keeps its status: null here.
    """
    s, total = F.col("status"), F.count("*")
    done, failed, cancelled, running = (F.count_if(s == x) for x in ("completed", "failed", "cancelled", "running"))
    status = (
        F.when(running > 0, "running").when(F.count_if(s.isin(*JOB_BUSY)) > 0, "queued").when(done == total, "completed")
        .when((failed > 0) & (done > 0), "partial_success").when(failed > 0, "failed").when(cancelled == total, "cancelled")
    )
    progress = F.when(done == total, F.lit(100)).otherwise(F.floor(F.avg("progress"))).cast("long")
    first = F.min(F.when(s == "running", F.struct("id", "document_id", "stage")))
    return job_documents.groupBy("job_id").agg(
        total.alias("total"), F.count_if(s.isin("completed", "failed", "cancelled")).alias("processed"), done.alias("completed"), failed.alias("failed"),
        progress.alias("progress"), status.alias("status"), first["stage"].alias("stage"),
    )


def next_position(docs: DataFrame) -> DataFrame:
    """The position after the last live document of each dataset."""
    return docs.groupBy("dataset_id").agg((F.coalesce(F.max(F.when(~F.col("deleted"), F.col("position"))), F.lit(0)) + 1).alias("next_position"))


def legacy_visible(segments: DataFrame, indexes: DataFrame, tasks: int | None = None) -> DataFrame:
    """Segments of active indexes, and those without index only in datasets that have no active index. tasks: for `dealing.dealt`."""
    segments = segments.select("id", "document_id", "position", "status", "dataset_id", "dataset_index_id")
    tasks = tasks_for(segments) if tasks is None else tasks
    active = indexes.where((F.col("status") == "active") & ~F.col("deleted"))
    of_index = dealt(segments.where(F.col("dataset_index_id").isNotNull()), "dataset_index_id", tasks=tasks).join(active.select(F.col("id").alias("dataset_index_id")), "dataset_index_id", "left_semi")
    legacy = dealt(segments.where(F.col("dataset_index_id").isNull()), "dataset_id", tasks=tasks).join(active.select("dataset_id"), "dataset_id", "left_anti")
    return of_index.select("id", "document_id", "position", "status").unionAll(legacy.select("id", "document_id", "position", "status"))


def has_unpublished(jobs: DataFrame, segments: DataFrame) -> DataFrame:
    """Jobs with a live segment that is not yet published."""
    waiting = segments.where(~F.col("deleted") & (F.col("status") == "indexing")).select(F.col("document_id").alias("id"))
    return jobs.join(waiting, "id", "left_semi")
