"""Makes this package importable on executors, so Python operators need no installation there, and bounds what their workers hold."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package's sources to the application's Python files, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="marlstone-"), "marlstone.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("marlstone", os.path.relpath(path, root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


#: Rows and bytes of an Arrow batch at most, where whole texts or blocks pass through Python.
ARROW_ROWS, ARROW_BYTES = 1_000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches, so that a worker's memory does not grow with the input; smaller settings of the user stand."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        set_to = spark.conf.get(name, str(2**30)).rstrip("b")
        if not (set_to.isdigit() and 0 < int(set_to) <= most):
            spark.conf.set(name, str(most))
