"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_shipped: set[str] = set()

BYTES, ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows a batch up to which their number alone bounds batches of short rows.
FEW = 100_000


def ship_package(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once per application.

    Functions that run in workers name their modules; on a cluster those needn't
    be installed.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # else it runs from an archive that was shipped already
        path = os.path.join(tempfile.mkdtemp(), "panelspark_modules.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(path)
    _shipped.add(context.applicationId)


@contextmanager
def batches_by_rows(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends batches of rows to Python that their number alone limits.

    For short rows of fixed width: Spark adds up a batch's bytes at each row, which takes
    longer than to send it. The setting is as before afterwards.
    """
    before = spark.conf.get(BYTES, None)
    few = 0 < int(spark.conf.get(ROWS) or 0) <= FEW
    if few:
        spark.conf.set(BYTES, str(2**31 - 1))
    try:
        yield
    finally:
        if few and before is None:
            spark.conf.unset(BYTES)
        elif few:
            spark.conf.set(BYTES, before)
