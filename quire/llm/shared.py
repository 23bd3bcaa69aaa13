"""What the operators of this subpackage share: the shared folder, written tables, Arrow text access.

Every table that cuts lineage is written below ``spark.checkpoint.dir``, which all executors and the
driver can reach, so a lost executor costs a re-read and nothing else. Only where that setting is
absent *and* Spark runs in one process (tests) is a folder made on this machine.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of this process's own if unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _files_cleaned(spark: SparkSession):
    """Shuffle files of the job inside are removed as it ends: its result is then a written table."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _files_cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`write_table` that nothing will read again."""
    spark = df.sparkSession
    base = shared_dir(spark)
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm = spark._jvm
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        if jvm.org.apache.hadoop.fs.Path(base).toUri().getPath() in path.toUri().getPath():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(col: str | Column = "text") -> Column:
    """A text column as its UTF-8 bytes, null as no bytes: Python then gets them without decoding."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("binary"), F.lit(b""))


def slices(array: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a binary array's rows that hold ``most`` bytes at most, or one row."""
    off = offsets(array)
    i, n = 0, len(array)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def offsets(array: pa.Array) -> np.ndarray:
    """Byte offsets of the rows of a binary array, relative to its own data buffer."""
    kind = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1]


def data(array: pa.Array) -> np.ndarray:
    buf = array.buffers()[2]
    return np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finishing mix of a 64-bit hash (the published SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
