"""Allow and block rules for URLs by a sort-merge range join.

A host's labels in reverse order make a key under which a host and all its subdomains are
one interval. Rules and URLs are dealt out by ranges of that key, each rule to every range
its interval meets, and each range is swept once in order: a stack holds the rules whose
intervals are open, one inside the other, and a URL is judged by those on it.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import partitions

#: Keys sampled for each range; they only decide where ranges end.
SAMPLE = 20
DEFAULT = "allow"


def _lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The part after the first ``://`` up to ``/ ? #``, A-Z in lower case, and what follows up to ``? #``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return _lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)), path


def canonical(host: Column) -> Column:
    """``a.example.net`` as ``net/example/a/``: no host holds a slash, so a prefix ends at a label."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def _placed(bounds: list[str], place: Column) -> Column:
    """The range of a place: how many bounds are not beyond it."""

    @F.pandas_udf("int")
    def run(places: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, p) for p in places], dtype="int32")

    return run(place)


class Sweep:
    """The open rules while keys go by in order."""

    def __init__(self):
        self.stack: list[tuple[str, dict[str, str], list[int]]] = []

    def move(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, verdict: str) -> None:
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, sizes = self.stack[-1]
        if paths.get(path) != "block":
            paths[path] = verdict
        if len(path) not in sizes:
            bisect.insort(sizes, len(path))

    def judge(self, path: str) -> tuple[str, str, str] | None:
        """``key, path, verdict`` of the longest rule that fits, host and path taken together."""
        best = None
        for key, paths, sizes in reversed(self.stack):
            for size in reversed(sizes):
                if size <= len(path) and path[:size] in paths:
                    if best is None or len(key) + size > len(best[0]) + len(best[1]):
                        best = key, path[:size], paths[path[:size]]
                    break
        return best


def _named(rule: tuple[str, str, str] | None) -> str | None:
    return None if rule is None else ".".join(reversed(rule[0][:-1].split("/"))) + rule[1]


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, last = Sweep(), None
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            rows, rules, verdicts = [], [], []
            places = zip(c["place"].to_pylist(), c["key"].to_pylist(), c["is_url"].to_pylist(), c["path"].to_pylist(), c["verdict"].to_pylist())
            for i, (place, key, is_url, path, verdict) in enumerate(places):
                if place != last:
                    sweep, last = Sweep(), place
                sweep.move(key)
                if not is_url:
                    sweep.open(key, path, verdict)
                    continue
                rule = sweep.judge(path)
                rows.append(i)
                rules.append(_named(rule))
                verdicts.append(rule[2] if rule else default)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [c["id"].take(at), c["host"].take(at), c["path"].take(at), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    return run


def judge_urls(
    pages: DataFrame, key: str, url: str, rules: DataFrame, default: str = DEFAULT, ranges: int | None = None
) -> DataFrame:
    """``key, host, path, rule, verdict`` of every row of ``pages``.

    ``rules`` has ``host, path, verdict`` (``allow`` or ``block``). A rule fits its host and all
    subdomains if the URL's path starts with the rule's. The longest that fits wins, host and
    path taken together, the longer host on a tie; of a rule given twice, ``block`` wins. Where
    none fits, ``rule`` is null and the verdict is ``default``.

    Ranges of keys are cut by host, path and ``key``, so a host may own any share of the URLs.
    A URL that is null or holds no ``://`` has an empty host and path. Null and repeated keys
    and repeated rows stay. Rules with a null field or an empty host are left out. Other columns
    are not looked at. Empty tables are fine.
    """
    spark = pages.sparkSession
    ranges = ranges or partitions(spark)
    host, path = host_and_path(F.col(url).cast("string"))
    urls = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", canonical(F.col("host")))
    place = F.concat_ws("\x00", "key", "path", F.coalesce(F.lpad(F.col("id").cast("string"), 20, "0"), F.lit("")))
    urls = urls.withColumn("at", place)
    sample = urls.select("at").orderBy(F.xxhash64("at"), "at").limit(SAMPLE * ranges).collect()
    sample = sorted(r["at"] for r in sample)
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    urls = urls.select(
        _placed(bounds, F.col("at")).alias("place"), "key", F.lit(True).alias("is_url"), "path", "id", "host", F.lit(None).cast("string").alias("verdict")
    )
    known = rules.where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL").select(
        canonical(_lower(F.col("host"))).alias("key"), "path", "verdict"
    )
    first, last = _placed(bounds, F.col("key")), _placed(bounds, F.concat("key", F.lit("\U0010ffff")))
    known = known.select(
        F.explode(F.sequence(first, last)).alias("place"), "key", F.lit(False).alias("is_url"), "path",
        F.lit(None).cast(urls.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("host"), "verdict",
    )
    dealt = urls.unionByName(known).repartitionById(ranges, F.col("place")).sortWithinPartitions("place", "key", "is_url", "path")
    kind = pages.schema[key].dataType.simpleString()
    out = dealt.mapInArrow(_sweep(default), f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", key)
