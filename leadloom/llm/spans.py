"""Places of regular expression matches, in Spark's own functions.

Spark has no function that gives the places of all matches. A text split by a pattern gives
what lies between the matches, and their extraction gives the matches; running sums of
both lengths are the places, counted in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``start, end, text, part`` of the matches of a pattern, from left to right.

    ``part`` is the text of ``group``. No match may be empty.
    """
    gaps = F.split(text, pattern)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("text"), part.alias("part"))
    empty = F.array().cast("array<struct<start:int,end:int,text:string,part:string>>")

    def step(seen: Column, x: Column) -> Column:
        start = seen["at"] + F.length(x["gap"])
        end = start + F.length(x["text"])
        found = F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"), x["part"].alias("part"))
        more = F.concat(seen["out"], F.array(found))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["text"].isNull(), seen["out"]).otherwise(more).alias("out"))

    folded = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(pattern), folded).otherwise(empty)


def in_context(text: Column, pattern: str, reach: int) -> Column:
    """``start, end, text, before, after`` of the matches: with up to ``reach`` characters on each
    side, as far as the neighbouring matches."""
    gaps = F.split(text, pattern)
    empty = F.array().cast("array<struct<start:int,end:int,text:string,before:string,after:string>>")

    def shown(pair: Column) -> Column:
        gap, found = pair["gap"], pair["found"]
        return F.transform(
            found,
            lambda m, i: F.struct(
                m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"),
                F.right(gap[i], F.lit(reach)).alias("before"), F.left(gap[i + 1], F.lit(reach)).alias("after"),
            ),
        )

    pair = F.struct(gaps.alias("gap"), matches(text, pattern).alias("found"))
    return F.when(text.rlike(pattern), F.transform(F.array(pair), shown)[0]).otherwise(empty)


def spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """Places of the matches that ``keep`` (of ``start, end, text, part``) accepts."""
    found = matches(text, pattern, group)
    if keep:
        found = F.filter(found, keep)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def ordered(kinds: list[str], columns: list[Column]) -> Column:
    """All spans of several kinds by start, then in the order of the kinds, as ``start, rank, kind, end``."""
    def tag(rank: int, kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))

    tagged = [F.transform(c, tag(n, k)) for n, (k, c) in enumerate(zip(kinds, columns))]
    return F.array_sort(F.concat(*tagged))


def joined(all_spans: Column) -> Column:
    """``kind:start:end`` of each span, joined with commas."""
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
