"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import shared_dir

#: White space and words, as every operator here takes them.
SPACES = "\t\n\x0b\x0c\r "
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting that drops the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def parked(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again.

    That cuts lineage as a checkpoint does, in a columnar and compressed form, and gives
    Spark the true size of the table: it then broadcasts it only if it is small. ``codec`` compresses
    tables of texts closer than the session's setting. Shuffle files of the write go when it ends; nothing reads
    them again, and else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/parked/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row in a column ``row`` beside computed ones, so that no name can clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def trimmed(column: Column) -> Column:
    return F.btrim(column, F.lit(SPACES))
