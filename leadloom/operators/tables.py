"""Table upkeep: latest rows, upserts, retention, freshness, unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.operators.signals import as_moment


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key, reduced on the map side."""
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
        .select(*key, "row.*")
    )


def upsert_latest(
    old: DataFrame, new: DataFrame, key: Sequence[str], version: str, keep_first: bool = False
) -> DataFrame:
    """A new snapshot of ``old`` with ``new`` written over it, or only filled in."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in key]
    order = F.struct("_new", version, *[c for c in rest if c != version])
    pick = F.min_by if keep_first else F.max_by
    return (
        both.groupBy(*key).agg(pick(F.struct(*rest), order).alias("row")).select(*key, "row.*")
    )


def retention(df: DataFrame, as_of: str, hours: int = 24, keep: Column | None = None) -> DataFrame:
    """Rows young enough, and those that must stay whatever their age."""
    young = F.col("ts") >= as_moment(as_of) - F.expr(f"INTERVAL '{hours}' HOUR")
    return df.where(young if keep is None else young | keep)


def expires_at(fetched: str, hours: Column) -> Column:
    """Null when caching is off, that is for a lifetime of zero or less."""
    return F.when(hours > 0, F.timestamp_add("HOUR", hours, F.col(fetched)))


def scrape_lifetime(hours: int = 168) -> Column:
    """Results without a mail address and of low confidence are kept a day at most."""
    poor = F.col("email").isNull() & (F.col("confidence") == "low")
    return F.when(poor, F.lit(min(hours, 24))).otherwise(F.lit(hours))


# fixed values: hours a registry payload stays fresh
PROFILE_HOURS = 168
RESOURCE_HOURS = 24


def refresh_due(
    keys: DataFrame, cache: DataFrame, key: str, as_of: str, inclusive: bool = True
) -> DataFrame:
    """Keys without a fresh cache entry."""
    now, expiry = as_moment(as_of), F.col("expires_at")
    fresh = cache.where(expiry >= now if inclusive else expiry > now)
    return keys.join(fresh.select(key), key, "left_anti")


def source_union(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
