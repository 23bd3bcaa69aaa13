"""Making the library importable where Spark's Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

BATCH_BYTES = 8 << 20  # of an Arrow batch; 10,000 long texts would be 30 MB and more, several times over in each of a task's workers
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of :data:`BATCH_BYTES` at most in this session, unless it has a setting of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of ``spark`` once, as a zip file; workers then find it wherever they start."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "quire.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quire", os.path.relpath(full, here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
