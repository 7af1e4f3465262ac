"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import parked

#: More rounds than any graph that fits on disk needs; reached only by a fault.
MAX_ROUNDS = 60


def _with_least(pairs: DataFrame, *, own: bool) -> DataFrame:
    """Each ``(u, v)`` beside the least neighbour of ``u`` (or ``u`` itself).

    The least ones are written first: the join then has plain shuffles on both sides, which
    Spark splits where a hub holds many links.
    """
    least = F.least(F.min("v"), F.first("u")) if own else F.min("v")
    mins = parked(pairs.groupBy("u").agg(least.alias("m")), "least")
    return pairs.join(mins, "u")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``; the root is the least node reachable.

    Large star: neighbours greater than a node link to its least neighbour. Small star: the
    other ones do. Both keep what is connected (Kiveris, Lattanzi, Mirrokni, Rastogi,
    Vassilvitskii 2014). Links to oneself and repeated links are fine, null ends are not links.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = parked(now, "links"), None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, own=True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = parked(large.distinct(), "large-star")
        small = _with_least(large, own=False)
        lower = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = parked(lower.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        # Sums of hashes in parts that cannot overflow.
        h = F.xxhash64("u", "v")
        seen = now.agg(F.count(F.lit(1)), F.sum(h % 1_000_003), F.sum(F.shiftright(h, 32))).head()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError("the links did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
