"""Cutting lineage: a result is written to the folder that all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

SHORT = 10_000  # rows of a table that counts as short


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a folder of this machine's own only in local mode without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder, read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_rows(df: DataFrame, most: int = SHORT) -> list[Row] | None:
    """The rows of a table of at most ``most`` rows; null for a longer one."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def checked(df: DataFrame, most: int = SHORT) -> DataFrame:
    """A table of rules for a join: broadcast once it is known to be short, else as it is, for a join by shuffles."""
    rows = short_rows(df, most)
    return df if rows is None else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
