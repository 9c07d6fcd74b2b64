"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a dimension that is broadcast.
BROADCAST_ROWS = 500_000


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir; a temporary folder only for a local master that has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tochi-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, so what reads it twice does not compute it twice."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dimension(df: DataFrame, label: str) -> DataFrame:
    """A materialized table, marked for broadcast if it is counted and small."""
    out = materialized(df, label)
    return F.broadcast(out) if out.count() <= BROADCAST_ROWS else out
