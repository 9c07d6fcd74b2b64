"""Helpers shared by the text operators: tables, shared-folder tables, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch, and bytes after which it is closed (one row may be larger).
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
#: Rows of a table of facts that is broadcast whole.
BROADCAST_FACTS = 500_000
#: Code points (or bytes) that one numpy pass works on at once.
PASS_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only for a local master that has none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tochi-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage without tying it to any executor: a lost executor
    costs a reread, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing still to be run reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the job that made them has ended.

    Spark keeps them until the driver collects its garbage; what ``saved`` has written does
    not need them. The session's setting is as before afterwards.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def with_facts(rows: DataFrame, facts: DataFrame, key: str | list[str], weight: str, most: int = BROADCAST_FACTS) -> DataFrame:
    """``rows`` left-joined with saved ``facts``, one row a key; no key meets in one task.

    ``weight`` is the column of facts with the number of rows a key has, or a number in
    proportion. Few facts are broadcast whole. Of many, the at most ``most`` heaviest
    are broadcast and the light ones shuffled; rows without a key are not joined at all.
    """
    n, total = facts.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    if n <= most:
        return rows.join(F.broadcast(facts), key, "left")
    keys = [key] if isinstance(key, str) else key
    heavy = F.col(weight) > total // most
    found = [c for c in facts.columns if c not in keys]
    known = F.col(keys[0]).isNotNull()
    marked = rows.join(F.broadcast(facts.filter(heavy).withColumn("_hot", F.lit(True))), key, "left")
    light = marked.filter(F.col("_hot").isNull() & known).drop("_hot", *found).join(facts.filter(~heavy), key, "left")
    return light.unionByName(marked.filter(F.col("_hot").isNotNull() | ~known).drop("_hot"))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def grouped(texts: list[str], size: int = PASS_CHARS) -> Iterator[list[int]]:
    """Indices of consecutive texts whose lengths sum to about ``size``."""
    group: list[int] = []
    total = 0
    for i, text in enumerate(texts):
        if group and total + len(text) > size:
            yield group
            group, total = [], 0
        group.append(i)
        total += len(text)
    if group:
        yield group


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def with_columns(batch: pa.RecordBatch, columns: Iterable[tuple[str, pa.Array]]) -> pa.RecordBatch:
    """``batch`` and further columns behind its own."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, array in columns:
        names.append(name)
        arrays.append(array)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64, the same on every machine."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def spare_name(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column in ``taken`` has it."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = "_" + name
    return name
