"""Personal data: fixed forms, and identifiers found by the contexts those forms stand in.

What the fixed forms find are the seeds. The words around them are patterns, and every word
with a digit or an at sign is an instance of the patterns it stands in. Scores go from
seeds to patterns and from patterns to instances, a few times over the whole graph (Riloff,
Jones 1999). Instances without a known form that stand in patterns of high score are
reported too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import boxed, parked
from leadloom.llm.spans import SPAN, in_context, joined, ordered, spans

ROUNDS = 3
#: A pattern is trusted from this score on, with so many different instances.
TRUST, SUPPORT = 0.6, 5
#: Characters on each side in which the context words are looked for.
REACH = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m["text"], "[^0-9]", "")


def _address(m: Column) -> Column:
    """No part of a dotted address is over 255."""

    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(m["text"], r"\."), small)


def _luhn(m: Column) -> Column:
    """14 to 19 digits whose check digit is right."""
    back = F.reverse(_digits(m))

    def value(i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(back) - 1), value), F.lit(0), lambda a, b: a + b)
    return F.when(F.length(back).between(14, 19), total % 10 == 0).otherwise(False)


@dataclass(frozen=True)
class Form:
    """A fixed form: a pattern, a text that any match holds, and a test of the match."""

    kind: str
    pattern: str
    mark: str | None = None
    test: Callable[[Column], Column] | None = None

    def find(self, text: Column) -> Column:
        found = spans(text, self.pattern, self.test)
        none = F.array().cast(f"array<{SPAN}>")
        return F.when(F.contains(text, F.lit(self.mark)), found).otherwise(none) if self.mark else found


#: The base forms, in the order in which their findings are listed. A match
#: begins where the one before ended or at the start of a run, and takes whole runs, so
#: that long runs are read once; neither changes what is found.
FORMS = (
    Form("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Form("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", _address),
    Form("card", r"[0-9](?:[\x20-]?+[0-9])++", None, _luhn),
    Form("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: F.length(_digits(m)).between(10, 15)),
)
#: Words with a digit or an at sign.
IDENTIFIER = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: The most pieces of a dotted or spaced number are short; these ends are not part of a word.
_EDGES = "\"'.,;:!?()[]<>"


def _patterns(mention: Column) -> Column:
    """The two words before; the word before and the one after. In lower case."""
    before = F.split(F.btrim(F.lower(mention["before"])), r"[\x20\x09-\x0D]+")
    after = F.split(F.btrim(F.lower(mention["after"])), r"[\x20\x09-\x0D]+")
    last, last_but_one, first = F.get(before, F.size(before) - 1), F.get(before, F.size(before) - 2), F.get(after, F.lit(0))
    left = F.when(last_but_one != "", F.concat(F.lit("left "), last_but_one, F.lit(" "), last))
    around = F.when((last != "") & (first != ""), F.concat(F.lit("around "), last, F.lit(" "), first))
    return F.array_compact(F.array(left, around))


def _score(edges: DataFrame, seeds: DataFrame, kinds: list[str], rounds: int) -> DataFrame:
    """``pattern, instances`` and a score for each kind, after so many rounds.

    A pattern's score is the mean of its instances', with one more of score nought; an
    instance's is that of its best pattern, and a seed's is 1 for its own kind and 0 for others.
    """
    best = parked(seeds, "seed-scores")
    for n in range(rounds):
        joined_up = edges.join(best, "instance", "left")
        means = [(F.sum(F.coalesce(k, F.lit(0.0))) / (F.count(F.lit(1)) + 1)).alias(k) for k in kinds]
        patterns = parked(joined_up.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"), *means), "pattern-scores")
        if n + 1 < rounds:
            found = edges.join(patterns, "pattern").groupBy("instance").agg(*(F.max(k).alias(k) for k in kinds))
            own = seeds.select("instance", F.lit(True).alias("seed"), *(F.col(k).alias(f"own_{k}") for k in kinds))
            best = found.join(own, "instance", "left").select(
                "instance", *(F.when(F.col("seed"), F.col(f"own_{k}")).otherwise(F.col(k)).alias(k) for k in kinds)
            )
            best = parked(best, "instance-scores")
    return patterns


def find(
    docs: DataFrame, text: str, forms: tuple[Form, ...] = FORMS,
    rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT,
) -> DataFrame:
    """Every row of ``docs`` without its text, and its spans.

    ``spans_<kind>`` are the places of a fixed form, and ``spans_<kind>_like`` those of words found by
    their context; columns of these names are replaced. Places are code points, the end
    exclusive. Words that touch a fixed form are not reported again.

    A trusted pattern has at least ``support`` different instances and a score of ``trust`` for a
    kind. Copies of a text count once for the scores. Texts are read once; what is written is
    what was found in them. Null and empty texts hold nothing, keys may be null, repeated rows
    are all returned, and an empty table gives an empty table.
    """
    kinds = [f.kind for f in forms]
    rows = boxed(docs, text=F.coalesce(F.col(text).cast("string"), F.lit("")))
    base = [f.find(F.col("text")).alias(f"spans_{f.kind}") for f in forms]
    added = [f"spans_{k}_like" for k in kinds]
    carried = [c for c in docs.columns if c != text and c not in (*(f"spans_{k}" for k in kinds), *added)]
    kept = F.struct(*(F.col(f"row.`{c}`").alias(c) for c in carried)) if carried else F.lit(None)
    found = parked(
        rows.select(
            kept.alias("row"), F.xxhash64("text").alias("c1"), F.xxhash64(F.lit("second"), "text").alias("c2"),
            *base, in_context(F.col("text"), IDENTIFIER, REACH).alias("mentions"),
        ),
        "found",
    )
    # One row for each word that may be an identifier, in one copy of each text.
    texts = found.where(F.size("mentions") > 0).dropDuplicates(["c1", "c2"])
    touching = [
        F.exists(f"spans_{k}", lambda s: (s["start"] < F.col("m.end")) & (s["end"] > F.col("m.start"))).cast("double").alias(k)
        for k in kinds
    ]
    mentions = texts.select("c1", "c2", *(f"spans_{k}" for k in kinds), F.explode("mentions").alias("m"))
    mentions = mentions.select(
        "c1", "c2", F.col("m.start").alias("start"), F.col("m.end").alias("end"),
        F.btrim(F.lower("m.text"), F.lit(_EDGES)).alias("instance"), _patterns(F.col("m")).alias("patterns"), *touching,
    )
    mentions = parked(mentions, "mentions")
    edges = parked(mentions.select("instance", F.explode("patterns").alias("pattern")).distinct(), "pattern-graph")
    seeds = mentions.groupBy("instance").agg(*(F.max(k).alias(k) for k in kinds)).where(" + ".join(kinds) + " > 0")
    scores = _score(edges, seeds, kinds, rounds)
    best = F.greatest(*kinds)
    trusted = scores.where((F.col("instances") >= support) & (best >= trust)).select(
        F.col("pattern").alias("by"), F.coalesce(*(F.when(F.col(k) == best, F.lit(k)) for k in kinds)).alias("kind")
    )
    trusted = parked(trusted, "trusted")
    fresh = mentions.where(" + ".join(kinds) + " = 0").select("c1", "c2", "start", "end", F.explode("patterns").alias("pattern"))
    fresh = fresh.join(trusted, F.col("pattern") == F.col("by")).groupBy("c1", "c2", "start", "end").agg(F.min("kind").alias("kind"))
    place = F.struct("start", "end")
    new = fresh.groupBy(F.col("c1").alias("k1"), F.col("c2").alias("k2")).agg(
        *(F.sort_array(F.collect_list(F.when(F.col("kind") == k, place))).alias(f"spans_{k}_like") for k in kinds)
    )
    new = parked(new, "context-findings")
    none = F.array().cast(f"array<{SPAN}>")
    out = found.join(new, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")), "left")
    return out.select(
        *(F.col(f"row.`{c}`").alias(c) for c in carried), *(f"spans_{k}" for k in kinds),
        *(F.coalesce(c, none).alias(c) for c in added),
    )


def listed(forms: tuple[Form, ...] = FORMS, context: bool = True) -> Column:
    """The spans of a row of ``find`` as ``kind:start:end``, joined with commas."""
    kinds = [f.kind for f in forms]
    names = kinds + [f"{k}_like" for k in kinds] * context
    return joined(ordered(names, [F.col(f"spans_{k}") for k in names]))
