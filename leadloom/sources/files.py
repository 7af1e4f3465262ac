"""Reading and writing files with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Parquet, JSON lines or CSV. Text formats need a schema."""
    if fmt == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    if schema is None:
        raise ValueError(f"{fmt} input needs a schema")
    if fmt == "json":
        return spark.read.schema(schema).json(path)
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    raise ValueError(fmt)


def write_snapshot(
    df: DataFrame, path: str, partition_by: list[str] | None = None, unfinished: bool = False
) -> None:
    """A new parquet snapshot; an existing one is never overwritten while it is read.

    With ``unfinished``, what a failed write left at ``path`` is replaced.
    """
    writer = df.write.mode("overwrite" if unfinished else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
