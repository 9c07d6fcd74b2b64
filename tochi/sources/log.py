"""An append-only table with optimistic commits, for writers that know nothing of each other.

A commit is a numbered file that only one writer can create; it names the folder of
Parquet files that it adds. A writer reads the table as of the last commit, decides on
its rows by that state, writes them, and creates the next number. If another writer was
first, it decides again by the new state. So nothing is lost, and what was decided at a
commit was true of everything before it.

Rows have a key. A row whose key is in the table is not added again, so an append may be
repeated after a failure. Of rows with equal keys in one append any one is kept. Null
keys are refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tochi.sources import stores

Decision = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Other writers were first at every attempt."""


class Log:
    """A table at ``path`` with the columns of ``schema`` and, behind them, ``commit``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T._parse_datatype_string(schema)
        self.stored = T.StructType([*self.schema.fields, T.StructField("commit", T.LongType())])

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        found = [*stores.names(self.spark, f"{self.path}/commits"), *stores.names(self.spark, f"{self.path}/summaries")]
        return max((int(n.removesuffix(".json")) for n in found), default=0)

    def _folders(self, upto: int) -> list[tuple[str, int]]:
        """(folder, commit) that make up the table: the last summary and the commits behind it."""
        summaries = [k for n in stores.names(self.spark, f"{self.path}/summaries") if (k := int(n.removesuffix(".json"))) <= upto]
        first = max(summaries, default=0)
        own = [(f"summaries/{first:012d}.json", first)] if first else []
        own += [(f"commits/{k:012d}.json", k) for k in range(first + 1, upto + 1)]
        return [(folder, k) for name, k in own if (folder := json.loads(stores.read_text(self.spark, f"{self.path}/{name}"))["data"])]

    def rows(self, upto: int | None = None) -> DataFrame:
        """The table as of a commit, the last one if none is named."""
        folders = self._folders(self.version() if upto is None else upto)
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        numbers = F.broadcast(self.spark.createDataFrame(folders, "_folder string, _commit long"))
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        found = self.spark.read.schema(self.stored).parquet(*[f"{self.path}/data/{f}" for f, _ in folders]).select("*", folder.alias("_folder"))
        return found.join(numbers, "_folder").select(*self.schema.names, F.coalesce("commit", "_commit").alias("commit"))

    def append(self, rows: DataFrame, decide: Decision | None = None, attempts: int = 50) -> int:
        """Add ``rows`` and return the number of the commit.

        ``decide`` gets the table as it is and those of the rows that it lacks, and returns
        what to add. The rows are computed once, however often the commit is tried.
        """
        incoming = f"{self.path}/incoming/{uuid.uuid4().hex}"
        have = set(rows.columns)
        rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]).write.parquet(incoming)
        staged = self.spark.read.schema(self.schema).parquet(incoming)
        try:
            if not staged.filter(F.col(self.key).isNull()).isEmpty():
                raise ValueError(f"rows without {self.key}")
            for _ in range(attempts):
                last = self.version()
                table = self.rows(last)
                new = staged.dropDuplicates([self.key]).join(table.select(self.key), self.key, "left_anti")
                if self._commit(decide(table, new) if decide else new, last + 1):
                    return last + 1
            raise Conflict(f"{self.path}: {attempts} attempts")
        finally:
            stores.remove(self.spark, incoming)

    def _commit(self, rows: DataFrame, number: int) -> bool:
        folder = uuid.uuid4().hex
        rows.select(*self.schema.names, F.lit(None).cast("long").alias("commit")).write.parquet(f"{self.path}/data/{folder}")
        done = stores.put_if_absent(self.spark, f"{self.path}/commits/{number:012d}.json", json.dumps({"data": folder}))
        if not done:
            stores.remove(self.spark, f"{self.path}/data/{folder}")
        return done

    def summarize(self) -> int:
        """Write the table of all commits so far as one folder, which later reads start from."""
        last, folder = self.version(), uuid.uuid4().hex
        if last:
            self.rows(last).write.parquet(f"{self.path}/data/{folder}")
            if not stores.put_if_absent(self.spark, f"{self.path}/summaries/{last:012d}.json", json.dumps({"data": folder})):
                stores.remove(self.spark, f"{self.path}/data/{folder}")
        return last
