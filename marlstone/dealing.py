"""Deals the rows of large tables to so many tasks that what a task sorts or hashes does not grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task takes, some 50 to 80 MB in each hash table or sort of narrow rows.
TASK_ROWS = 250_000


def tasks_for(rows: DataFrame) -> int:
    """Tasks for the rows of a table; Parquet files are counted by their footers."""
    return -(-rows.count() // TASK_ROWS)


def dealt(rows: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """rows by hash of keys over tasks (counted if not given), so that groups and joins by the keys follow without a second shuffle; a table for one task stays as it is."""
    tasks = tasks_for(rows) if tasks is None else tasks
    return rows.repartition(tasks, *keys) if tasks > 1 else rows
