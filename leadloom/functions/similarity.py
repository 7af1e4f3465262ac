"""Trigram similarity of two texts, exact and with integer counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.keys import col


def trigrams(c: Column | str) -> Column:
    """Distinct 3-grams of each word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(col(c)), "[^\\p{Alnum}À-ɏ]+"), lambda w: w != "")
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def shared_and_all(a: Column, b: Column) -> tuple[Column, Column]:
    shared = F.size(F.array_intersect(a, b))
    return shared, F.size(a) + F.size(b) - shared


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    shared, total = shared_and_all(trigrams(a), trigrams(b))
    return F.when(total > 0, shared / total).otherwise(F.lit(0.0))
