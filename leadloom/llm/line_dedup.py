"""Boilerplate lines by their frequency within a site.

A line that stands on more than a given share of a site's pages is boilerplate there and
is dropped from them. What is boilerplate on one site may be text on another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import boxed, parked, trimmed

MAX_RATIO = 0.02
MIN_PAGES = 5


def _keys(text: Column) -> Column:
    """One 64-bit key for each line, null for blank lines."""
    return F.transform(
        F.split(text, "\n"),
        lambda line: F.when(trimmed(line) != "", F.xxhash64(trimmed(line))),
    )


def site_lines(pages: DataFrame, site: str, text: str, copies: bool = True) -> DataFrame:
    """``site, line, pages``: how many pages of a site hold a line; the row whose line is
    null has the number of all pages of the site.

    A page counts a line once. The counts are summed before the shuffle, so a site may
    own any share of the pages, and a line may stand on all of them. Without ``copies``, pages
    of a site with the same text are one page.
    """
    rows = boxed(
        pages, site=F.col(site), line=F.array_distinct(F.array_compact(_keys(F.col(text)))),
        content=F.xxhash64(F.col(text)), size=F.length(F.col(text)),
    )
    if not copies:
        rows = rows.select("site", "line", "content", "size").dropDuplicates(["site", "content", "size"])
    none = F.array(F.lit(None).cast("bigint"))
    return (
        rows.where(F.col("site").isNotNull())
        .select("site", F.explode(F.concat(none, F.coalesce("line", F.array().cast("array<bigint>")))).alias("line"))
        .groupBy("site", "line")
        .agg(F.count(F.lit(1)).alias("pages"))
    )


def boilerplate(counts: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``site, drops``: the keys of each site's boilerplate lines.

    A list has fewer entries than the mean number of lines of a page over ``max_ratio``,
    because each of its lines uses up that share of the site's pages.
    """
    totals = counts.where("line is null").select("site", F.col("pages").alias("total"))
    often = counts.where((F.col("pages") >= min_pages) & F.col("line").isNotNull())
    return (
        often.join(totals, "site")
        .where(F.col("pages") > F.lit(float(max_ratio)) * F.col("total"))
        .groupBy("site")
        .agg(F.sort_array(F.collect_list("line")).alias("drops"))
    )


def drop_site_lines(
    pages: DataFrame, site: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: bool = True
) -> DataFrame:
    """The pages with boilerplate lines taken out of ``text``, and two more columns.

    ``n_lines`` counts the lines that are not blank, ``n_dropped`` those taken out (columns
    of these names in the input are replaced). A line is compared without the white space
    around it. It goes if at least ``min_pages`` pages and more than ``max_ratio`` of the pages
    of its site hold it. Lines are told apart by a 64-bit hash within their site.

    Blank lines stay. A null text stays null and counts 0 lines. Pages of an unknown (null)
    site have nothing to be compared with and stay as they are. Repeated rows count as pages
    of their own, or as one page without ``copies``, and are all returned. An empty table gives an empty table.
    """
    counts = parked(site_lines(pages, site, text, copies), "site-lines")
    drops = parked(boilerplate(counts, max_ratio, min_pages), "boilerplate").withColumnRenamed("site", "its_site")
    rows = boxed(pages, site=F.col(site), body=F.col(text)).join(drops, F.col("site") == F.col("its_site"), "left")
    # The list is cut down to what this page holds first: a hash lookup instead of a scan for each line.
    rows = rows.withColumn("keys", _keys(F.col("body")))
    rows = rows.withColumn("mine", F.when(F.col("drops").isNotNull(), F.array_intersect("keys", "drops")))
    hit = F.coalesce(F.size("mine"), F.lit(0)) > 0
    gone = F.coalesce(F.size(F.filter("keys", lambda k: F.array_contains("mine", k))), F.lit(0))
    left = F.filter(
        F.arrays_zip(F.split("body", "\n").alias("line"), F.col("keys").alias("key")),
        lambda x: ~F.coalesce(F.array_contains("mine", x["key"]), F.lit(False)),
    )
    out = rows.select(
        "row",
        F.when(hit, F.array_join(F.transform(left, lambda x: x["line"]), "\n")).otherwise(F.col("body")).alias("body"),
        F.coalesce(F.size(F.array_compact("keys")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(hit, gone).otherwise(0).cast("long").alias("n_dropped"),
    )
    own = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return out.select(
        *(F.col("body").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in own), "n_lines", "n_dropped"
    )
