"""Quality rules as weak labels.

Each rule votes that a document is good, that it is bad, or abstains. Expectation maximisation
estimates how each rule votes on good and on bad documents, and so how accurate it is, from
how the rules agree (Dawid, Skene 1979; Ratner and others 2016), and a document stays if it is
probably good. Everything runs on Spark's own functions: votes are counted by pattern, of
which there are at most three to the number of rules, and each round of the estimate is one
aggregate over that table, of which some sums reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import SPACE, boxed, parked, trimmed

ROUNDS = 15
#: The first guess, worth ten documents: how often a rule votes bad, abstains and votes good, on good and on bad documents.
ON_GOOD, ON_BAD = (0.01, 0.49, 0.5), (0.3, 0.4, 0.3)
GUESS = 10.0
MIN_WORDS = 50
MAX_REPEAT_SHARE = 50


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that stand twice or more in the text."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def places(s: Column) -> Column:
        def again(j: Column) -> Column:
            own = s[j]["h"]
            return F.when((F.get(s, j - 1)["h"] == own) | (F.get(s, j + 1)["h"] == own), s[j]["i"])

        return F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(0), F.size(s) - 1), again)))

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        fold = F.aggregate(
            _let(ranked, places), start,
            lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n")),
        )
        # Most texts repeat nothing: telling that takes a hash set and no sorting.
        return F.when(F.size(F.array_distinct(h)) < F.size(h), fold["n"]).otherwise(0)

    return F.when(F.size(words) >= 4, _let(words, lambda w: _let(windows(w), covered))).otherwise(0)


def measures(docs: DataFrame, text: str) -> DataFrame:
    """The rows of ``docs`` as ``row``, and what the rules look at, all of the whole text."""
    rows = boxed(docs, text=F.coalesce(F.col(text).cast("string"), F.lit("")))
    bare = trimmed(F.col("text"))
    rows = rows.withColumn("words", F.when(bare != "", F.split(bare, SPACE)).otherwise(F.array().cast("array<string>")))
    lines = F.filter(F.split("text", "\n"), lambda line: trimmed(line) != "")

    def count(pattern: str) -> Column:
        return F.regexp_count("text", F.lit(pattern)).cast("long")

    return rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.coalesce(F.length(F.array_join(F.regexp_extract_all("text", F.lit(r"\p{Lu}{2,}"), F.lit(0)), "")), F.lit(0)).cast("long").alias("n_capitals"),
        count("[.!?](?=[\\x20\\x09-\\x0D]|$)").alias("n_stops"),
        count("!+").alias("n_cries"),
        count("[#*$%&|<>]{2,}").alias("n_symbol_runs"),
        count("(?<![^\\x20\\x09-\\x0D])[#*$%&|<>]+(?![^\\x20\\x09-\\x0D])").alias("n_symbol_words"),
    )


@dataclass(frozen=True)
class Vote:
    """A rule: a condition for good, one for bad; it abstains where neither holds."""

    name: str
    good: str
    bad: str

    def column(self) -> Column:
        votes = F.when(F.expr(self.bad), F.lit(-1)).when(F.expr(self.good), F.lit(1)).otherwise(F.lit(0))
        return F.coalesce(votes, F.lit(0)).cast("tinyint").alias(f"vote_{self.name}")


#: Most documents are free of what the last ones look for, so its absence says nothing.
RULES = (
    Vote("length", "n_words >= 100", "n_words < 20"),
    Vote("word_length", "word_chars BETWEEN 3 * n_words AND 9 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Vote("stops", "n_stops BETWEEN n_words / 40 AND n_words / 3", "n_stops < n_words / 200"),
    Vote("repeats", "100 * n_repeat_words < 10 * n_words", "100 * n_repeat_words > 30 * n_words"),
    Vote("dup_lines", "false", "10 * n_dup_lines > 3 * n_lines"),
    Vote("symbols", "false", "10 * n_symbols > n_words"),
    Vote("symbol_words", "false", "20 * n_symbol_words > n_words"),
    Vote("symbol_runs", "false", "20 * n_symbol_runs > n_words"),
    Vote("capitals", "false", "100 * n_capitals > 30 * word_chars"),
    Vote("cries", "false", "10 * n_cries > n_words"),
)


@dataclass(frozen=True)
class Estimate:
    """The share of good documents, and each rule's votes (bad, none, good) on good and on bad ones."""

    good: float
    votes: dict[str, tuple[tuple[float, ...], tuple[float, ...]]]

    def posterior(self) -> Column:
        """The probability that a row with its votes is good."""
        logit = F.lit(math.log(self.good / (1 - self.good)))
        for name, (on_good, on_bad) in self.votes.items():
            bad, none, good = (math.log(g / b) for g, b in zip(on_good, on_bad))
            vote = F.col(f"vote_{name}")
            logit = logit + F.when(vote == 1, good).when(vote == -1, bad).otherwise(none)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def accuracy(self, name: str) -> tuple[float, float]:
        """How often a rule is right where it votes, on good and on bad documents."""
        (gb, _, gg), (bb, _, bg) = self.votes[name]
        return gg / (gg + gb), bb / (bb + bg)


def estimate(voted: DataFrame, rules: tuple[Vote, ...] = RULES, rounds: int = ROUNDS) -> Estimate:
    """Expectation maximisation over the patterns of votes. Without rows, the first guess stays."""
    names = [f"vote_{r.name}" for r in rules]
    patterns = parked(voted.groupBy(*names).count(), "vote-patterns")
    now = Estimate(0.7, {r.name: (ON_GOOD, ON_BAD) for r in rules})
    for _ in range(rounds):
        good, bad = F.col("count") * F.col("p"), F.col("count") * (1 - F.col("p"))
        sums = [F.sum(good).alias("good"), F.sum(bad).alias("bad")]
        for v in names:
            for vote in (-1, 0, 1):
                on = F.col(v) == vote
                sums.append(F.array(*(F.sum(F.when(on, w).otherwise(0.0)) for w in (good, bad))).alias(f"{v}{vote}"))
        s = patterns.withColumn("p", now.posterior()).agg(*sums).head()
        if s["good"] is None:
            break

        def share(name: str, kind: int, guess: tuple[float, ...]) -> tuple[float, ...]:
            found = [s[f"vote_{name}{vote}"][kind] + GUESS * g for vote, g in zip((-1, 0, 1), guess)]
            # Rounded, so that the order of the sums cannot show.
            return tuple(round(max(1e-6, f / sum(found)), 9) for f in found)

        votes = {r.name: (share(r.name, 0, ON_GOOD), share(r.name, 1, ON_BAD)) for r in rules}
        now = Estimate(round(min(0.999, max(0.001, s["good"] / (s["good"] + s["bad"]))), 9), votes)
    return now


def judge(docs: DataFrame, text: str, rules: tuple[Vote, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Every row with its measures, votes, ``base_failed``, ``good_probability`` and ``kept``.

    A row fails the base rule with fewer than 50 words, or if more than half of its words stand
    in three-word windows that repeat. Other rows are kept if their probability of being good
    reaches ``threshold``. Texts are read once; measures are written and votes counted there.

    A null text counts as empty: no words, so it fails. Repeated rows are judged alike and
    all returned, and keys may be null. New columns replace those of the same names. An empty
    table gives an empty table.
    """
    measured = measures(docs, text)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    carried = [c for c in docs.columns if c != text]
    rows = measured.select(
        F.struct(*(F.col(f"row.`{c}`").alias(c) for c in carried)).alias("row") if carried else F.lit(None).alias("row"),
        *(c for c in measured.columns if c != "row"), *(r.column() for r in rules), failed.alias("base_failed"),
    )
    rows = parked(rows, "measures")
    chance = estimate(rows, rules).posterior()
    new = [c for c in rows.columns if c != "row"]
    out = rows.select(*rows.columns, chance.alias("good_probability"))
    kept = ~F.col("base_failed") & (F.col("good_probability") >= threshold)
    return out.select(
        *(F.col(f"row.`{c}`").alias(c) for c in carried if c not in (*new, "good_probability", "kept")),
        *new, "good_probability", kept.alias("kept"),
    )
