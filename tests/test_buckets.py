import os
import random

from pyspark.sql import functions as F

from leadloom.sources.buckets import BUCKET, BucketedTable, exists

SCHEMA = "k string, v long"


def add(before, changes):
    """Sums by key."""
    return before.unionByName(changes).groupBy("k").agg(F.sum("v").alias("v"))


def rows(df):
    return sorted((r.k or "", r.v) for r in df.collect())


def test_batches_rewrite_their_own_buckets(spark, tmp_path):
    table = BucketedTable(str(tmp_path), "k", SCHEMA, 16)
    draw, want = random.Random(1), {}
    assert table.latest(spark) == -1 and rows(table.read(spark)) == []
    base = [(f"k{i}", i) for i in range(100)] + [(None, 5)]
    for n in range(6):
        batch = [(f"k{draw.randint(0, 130)}", draw.randint(1, 9)) for _ in range(0 if n == 3 else 3)]
        for k, v in (base if n == 0 else []) + batch:
            want[k or ""] = want.get(k or "", 0) + v
        changes = spark.createDataFrame(batch, SCHEMA)
        table.merge(n, changes, F.col("k"), add, spark.createDataFrame(base, SCHEMA))
        table.merge(n, changes, F.col("k"), add)  # the same batch again
        assert table.latest(spark) == n and rows(table.read(spark)) == sorted(want.items())
        held = [d for d in os.listdir(tmp_path / f"v{n}") if d.startswith(BUCKET)]
        assert len(held) == 16 if n == 0 else len(held) <= 3
    assert sum(v for _, v in rows(table.read(spark, 0))) < sum(want.values())  # older versions stay


def test_a_batch_that_died_is_done_again(spark, tmp_path):
    table = BucketedTable(str(tmp_path), "k", SCHEMA, 4)
    table.merge(0, spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA), F.col("k"), add)
    # All was written but the commit.
    spark.createDataFrame([("a", 99)], SCHEMA).withColumn(BUCKET, F.lit(0)).write.partitionBy(BUCKET).parquet(f"{tmp_path}/v1")
    assert table.latest(spark) == 0 and rows(table.read(spark)) == [("a", 1), ("b", 2)]
    table.merge(1, spark.createDataFrame([("a", 1)], SCHEMA), F.col("k"), add)
    assert rows(table.read(spark)) == [("a", 2), ("b", 2)]


def test_rows_that_a_fold_drops_are_gone(spark, tmp_path):
    table = BucketedTable(str(tmp_path), "k", SCHEMA, 4)
    table.merge(0, spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA), F.col("k"), add)
    drop = lambda before, changes: before.join(changes.select("k"), "k", "left_anti")
    table.merge(1, spark.createDataFrame([("a", 0)], SCHEMA), F.col("k"), drop)
    assert rows(table.read(spark)) == [("b", 2)]
    assert exists(spark, str(tmp_path)) and not exists(spark, f"{tmp_path}/v7")
