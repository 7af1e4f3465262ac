"""Keyed tables in hash buckets, of which a batch rewrites only those that its keys fall into.

Version ``n`` of a table is a folder ``v<n>`` with the buckets that were rewritten, and a commit
``_commits/v<n>`` that names for every bucket the version holding it. A commit counts once its success
marker is there, a single file written last, so a reader sees a version whole or not at all. A batch reads and writes
what its own buckets hold and one commit of at most ``buckets`` rows, however many versions came before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, asked through Spark's reader."""
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder has come to its end."""
    return exists(spark, f"{path}/_SUCCESS")


@dataclass(frozen=True)
class BucketedTable:
    """Rows of ``schema`` under ``path``, dealt into ``buckets`` by a hash of ``key``.

    One writer commits versions 0, 1, 2 and so on. Choose ``buckets`` once, so that a bucket is a task's work.
    """

    path: str
    key: str
    schema: str
    buckets: int = 256

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def committed(self, spark: SparkSession, version: int) -> bool:
        return finished(spark, f"{self.path}/_commits/v{version}")

    def latest(self, spark: SparkSession) -> int:
        """The newest version, -1 if there is none. Versions have no gaps, so it is found by doubling and halving."""
        high = 0
        while self.committed(spark, high):
            high = 2 * high + 1
        low = (high - 1) // 2 if high else -1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.committed(spark, middle) else (low, middle)
        return low

    def _holders(self, spark: SparkSession, version: int) -> dict[int, int]:
        rows = spark.read.schema("bucket int, version long").parquet(f"{self.path}/_commits/v{version}")
        return {r.bucket: r.version for r in rows.collect()}  # at most one row for each bucket

    def _touched(self, changes: DataFrame, key: Column) -> set[int]:
        return {r[0] for r in changes.select(self.bucket(key)).distinct().collect()}  # at most all buckets

    def _rows(self, spark: SparkSession, holders: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/v{v}/{BUCKET}={b}" for b, v in sorted(holders.items())]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The table as of a version, or as it is now."""
        if version is None:
            version = self.latest(spark)
        return self._rows(spark, self._holders(spark, version) if version >= 0 else {})

    def beside(self, changes: DataFrame, key: Column, version: int) -> DataFrame:
        """The rows as of ``version`` of all buckets that keys of ``changes`` fall into."""
        spark = changes.sparkSession
        holders, touched = self._holders(spark, version) if version >= 0 else {}, self._touched(changes, key)
        return self._rows(spark, {b: v for b, v in holders.items() if b in touched})

    def merge(
        self, version: int, changes: DataFrame, key: Column,
        fold: Callable[[DataFrame, DataFrame], DataFrame], base: DataFrame | None = None,
    ) -> None:
        """Commits ``version``: in the buckets of ``changes``, ``fold(rows before, changes)`` takes the place of the rows.

        ``fold`` must give every row back that stays. Version 0 folds the whole of ``base``, by default nothing. A version that is
        committed is left alone; what a run that died has left of one is replaced.
        """
        spark = changes.sparkSession
        if self.committed(spark, version):
            return
        # Changes are read twice, and are written so that both see the same.
        kept = f"{self.path}/_changes/v{version}"
        changes.write.mode("overwrite").parquet(kept)
        changes = spark.read.schema(changes.schema).parquet(kept)
        touched = self._touched(changes, key)
        holders = self._holders(spark, version - 1) if version else {}
        if version:
            base = self._rows(spark, {b: v for b, v in holders.items() if b in touched})
        elif base is None:
            base = self._rows(spark, {})
        after = fold(base, changes).withColumn(BUCKET, self.bucket(F.col(self.key)))
        out = f"{self.path}/v{version}"
        after.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(out)
        filled = spark.read.schema(f"{BUCKET} int").parquet(out).distinct().collect()  # at most all buckets
        holders = {b: v for b, v in holders.items() if b not in touched} | {r[0]: version for r in filled}
        commit = spark.createDataFrame(sorted(holders.items()), "bucket int, version long").coalesce(1)
        commit.write.mode("overwrite").parquet(f"{self.path}/_commits/v{version}")
