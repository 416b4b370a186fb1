"""Tables that are written in batches which can be broken off and gone on with.

A row's content is known by its hash.  A run looks up which rows the committed batches hold as they are now, and writes only
the others: new ones, and those whose content has changed.  It deals them to batches by a hash of the key and commits each
when it is whole, so that a run that is killed loses its open batch only, and the next one goes on behind the last commit.
Readers see committed batches, and of each key the newest row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.storage import commit, committed, stored


class IncrementalTable:
    """``key`` names the column of keys, which are not null and different in what is written."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key

    def _batches(self) -> DataFrame | None:
        paths = [f"{self.path}/rows/batch={b}" for b in committed(self.spark, self.path)]
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*paths) if paths else None

    def _newest(self) -> DataFrame | None:
        """(key, content_hash, batch) of the newest row of each key; rows themselves are not read."""
        rows = self._batches()
        return None if rows is None else rows.groupBy(self.key).agg(F.max("batch").alias("batch"), F.max_by("content_hash", "batch").alias("content_hash"))

    def rows(self) -> DataFrame | None:
        """The newest row of each key; None before the first commit."""
        rows = self._batches()
        return None if rows is None else rows.join(self._newest().drop("content_hash"), [self.key, "batch"]).drop("batch", "content_hash")

    def pending(self, source: DataFrame) -> DataFrame:
        """Rows of ``source`` that are not there as they are now, with ``content_hash``."""
        content = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(source.columns)]), {"ignoreNullFields": "false"}), 256)
        rows, newest = source.withColumn("content_hash", content), self._newest()
        return rows if newest is None else rows.join(newest.drop("batch"), [self.key, "content_hash"], "left_anti").select(*rows.columns)

    def write(self, source: DataFrame, made: Callable[[DataFrame], DataFrame] = lambda rows: rows, batch_rows: int = 1_000_000) -> int:
        """Batches written: ``made`` turns the pending rows of each into those of the table and keeps key and ``content_hash``."""
        rows = stored(self.pending(source), "pending")
        n = -(-rows.count() // batch_rows)
        numbers = committed(self.spark, self.path)
        first = numbers[-1] + 1 if numbers else 0
        for i in range(n):
            part = rows.where(F.pmod(F.xxhash64(self.key), F.lit(n)) == i)
            made(part).write.mode("overwrite").parquet(f"{self.path}/rows/batch={first + i}")
            commit(self.spark, self.path, first + i)
        return n
