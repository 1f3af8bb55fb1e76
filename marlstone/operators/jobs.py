"""State transitions of indexing jobs as pure functions over snapshots (M15-M20, D6-D7, T1's batch form, O9, J20).

The clock is an argument; a transition returns the whole table with new values where its guard holds. Row
locks of the source system become one writer a snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Retry delays in seconds, attempts, and document states by stage.
RETRY_DELAYS = (30, 120, 600)
MAX_ATTEMPTS = 3
STAGE_STATUS = {
    "download": "downloading", "parse": "parsing", "split": "splitting", "stage": "indexing", "embed-or-keywords": "embedding",
    "vector-upsert": "indexing", "graph-extract": "indexing", "validate": "indexing",
}
TERMINAL = ("completed", "failed", "cancelled")


def _set(df: DataFrame, guard: Column, **values) -> DataFrame:
    """df with new values where guard holds (null counts as false), computed from the old row."""
    ok = F.coalesce(guard, F.lit(False))
    return df.withColumns({name: F.when(ok, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(name)) for name, value in values.items()})


def seconds_after(now: Column, seconds) -> Column:
    return F.timestamp_add("SECOND", seconds if isinstance(seconds, Column) else F.lit(seconds), now)


def claimable(now: Column) -> Column:
    """Due rows that wait, and running ones whose lease is over."""
    s = F.col("status")
    waiting = s.isin("pending", "queued", "retry_wait") & (F.col("due_at").isNull() | (F.col("due_at") <= now))
    expired = (s == "running") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now))
    return waiting | expired


def claim(rows: DataFrame, live_documents: DataFrame, now: Column, worker: str, lease_seconds: int = 300) -> DataFrame:
    """Take what can be claimed, unless its document is gone."""
    live = live_documents.select(F.col("id").alias("document_id"), F.lit(True).alias("__live")).distinct()
    joined = rows.join(live, "document_id", "left")
    taken = _set(joined, claimable(now) & F.col("__live"), status="running", attempts=F.coalesce("attempts", F.lit(0)) + 1, worker_id=worker, lease_expires_at=seconds_after(now, lease_seconds))
    return taken.drop("__live").select(*rows.columns)


def release(rows: DataFrame, worker: str, now: Column) -> DataFrame:
    """Give rows back without counting the attempt."""
    owned = (F.col("status") == "running") & (F.col("worker_id") == worker)
    return _set(rows, owned, status="pending", due_at=now, attempts=F.greatest(F.lit(0), F.coalesce("attempts", F.lit(1)) - 1), worker_id=F.lit(None).cast("string"), lease_expires_at=F.lit(None).cast("timestamp"))


def heartbeat(rows: DataFrame, beats: DataFrame, now: Column, lease_seconds: int = 300) -> DataFrame:
    """Progress never falls and stays in 0..100; the stage moves only with progress. beats: id, worker_id, stage, progress."""
    b = beats.select("id", F.col("worker_id").alias("__w"), F.col("stage").alias("__s"), F.col("progress").alias("__p"))
    joined = rows.join(b, "id", "left")
    held = (F.col("status") == "running") & (F.col("worker_id") == F.col("__w"))
    old = F.coalesce("progress", F.lit(0))
    ahead = F.col("__p").isNull() | (F.col("__p") >= old)
    moved = _set(joined, held, stage=F.when(ahead, F.coalesce("__s", "stage")).otherwise(F.col("stage")), progress=F.greatest(old, F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("__p", old)))), lease_expires_at=seconds_after(now, lease_seconds))
    return moved.select(*rows.columns)


def document_status_of_stage(stage: Column, old: Column) -> Column:
    """What a stage shows as its document's state; unknown stages change nothing."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in STAGE_STATUS.items() for x in pair])[stage], old)


def retry_delay(attempts: Column) -> Column:
    """Delay before the next attempt, the last delay for all later ones."""
    delays = F.array(*map(F.lit, RETRY_DELAYS))
    return F.element_at(delays, F.greatest(F.lit(1), F.least(attempts, F.lit(len(RETRY_DELAYS)))).cast("int"))


def fail(rows: DataFrame, worker: str, now: Column, code: str, retryable: bool = True, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Wait for a retry while attempts are left, else fail."""
    owned = (F.col("status") == "running") & (F.col("worker_id") == worker)
    again = F.lit(retryable) & (F.coalesce("attempts", F.lit(0)) < max_attempts)
    due = F.when(again, seconds_after(now, retry_delay(F.col("attempts")))).otherwise(now)
    return _set(rows, owned, status=F.when(again, "retry_wait").otherwise("failed"), due_at=due, error_code=code[:128], lease_expires_at=F.lit(None).cast("timestamp"))


def finish(rows: DataFrame, worker: str, ids: DataFrame, status: str = "completed") -> DataFrame:
    """Complete or cancel running rows that the worker owns."""
    named = rows.join(ids.select("id", F.lit(True).alias("__n")).distinct(), "id", "left")
    owned = F.col("__n") & (F.col("status") == "running") & (F.col("worker_id") == worker)
    values = {"status": status, "lease_expires_at": F.lit(None).cast("timestamp")} | ({"progress": 100, "stage": "validate"} if status == "completed" else {})
    return _set(named, owned, **values).select(*rows.columns)


def prepared(warnings: Column) -> Column:
    """Warnings that aren't null, even none, mark a complete staging checkpoint."""
    return warnings.isNotNull()


def expired(rows: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Running rows whose lease is over, oldest lease first, ties by id."""
    return rows.where((F.col("status") == "running") & (F.col("lease_expires_at") <= now)).orderBy("lease_expires_at", "id").limit(limit)


def recover(rows: DataFrame, now: Column, limit: int = 100, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Rows of expired() wait for a retry or fail."""
    again = F.coalesce("attempts", F.lit(0)) < max_attempts
    return expired(rows, now, limit).select("id", F.when(again, "retry_wait").otherwise("failed").alias("status"), F.when(~again, "WORKER_LEASE_EXPIRED").alias("error_code"))


def dispatch(rows: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Due rows that wait, oldest first, become queued."""
    due = rows.where(F.col("status").isin("pending", "retry_wait") & (F.col("due_at") <= now))
    return due.orderBy("due_at", "id").limit(limit).select("id", F.lit("queued").alias("status"))


def cancel_outcome(status: Column) -> Column:
    """What a cancel request answers."""
    return F.when(status.isNull(), "not_found").when(status.isin(*TERMINAL, "partial_success"), "terminal").otherwise("requested")


def retry_outcome(status: Column, retryable_rows: Column) -> Column:
    """What a retry request answers."""
    return F.when(status.isNull(), "not_found").when(status.isin("running", "queued"), "active").when(retryable_rows == 0, "nothing_to_retry").otherwise("retried")


def retry(rows: DataFrame, job_ids: DataFrame) -> DataFrame:
    """Failed and waiting rows of the named jobs start anew."""
    named = rows.join(job_ids.select("job_id", F.lit(True).alias("__n")).distinct(), "job_id", "left")
    return _set(named, F.col("__n") & F.col("status").isin("failed", "retry_wait"), status="pending").select(*rows.columns)


def cancelled_rows(rows: DataFrame, jobs: DataFrame, datasets: DataFrame, docs: DataFrame) -> DataFrame:
    """Id, cancelled: a missing or deleted job, dataset or document cancels too."""
    j = jobs.select(F.col("id").alias("job_id"), "dataset_id", (F.col("status") == "cancelled").alias("stop"))
    d = datasets.select(F.col("id").alias("dataset_id"), F.col("deleted").alias("dataset_gone"))
    k = docs.select(F.col("id").alias("document_id"), F.col("deleted").alias("document_gone"))
    joined = rows.join(j, "job_id", "left").join(d, "dataset_id", "left").join(k, "document_id", "left")
    gone = lambda c: F.coalesce(F.col(c), F.lit(True))
    return joined.select("id", (gone("stop") | gone("dataset_gone") | gone("document_gone")).alias("cancelled"))


def touched_deleted(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Deleted documents that a finished run has touched, to be cleaned again."""
    gone = docs.where("deleted").select(F.col("id").alias("document_id"))
    return rows.where(F.col("status").isin(*TERMINAL)).select("document_id").distinct().join(gone, "document_id", "left_semi")
