"""Filed accounts: figures of the current and the prior year from tagged documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.functions.keys import first_group, strip

# fixed values: document markup
FACT = r"(?is)<ix:nonFraction\b([^>]*)>(.*?)</ix:nonFraction>"
FACT_HEAD = r"(?is)^<ix:nonFraction\b([^>]*)>"
CONTEXT = r"""(?is)<xbrli:context\b[^>]*\bid="([^"]+)"[^>]*>(.*?)</xbrli:context>"""
END = r"(?i)<xbrli:endDate>([^<]+)</xbrli:endDate>"
INSTANT = r"(?i)<xbrli:instant>([^<]+)</xbrli:instant>"
NEAR_DAYS, PRIOR_DAYS, YEAR_DAYS = 90, 180, 365


def _attribute(attributes: Column, name: str) -> Column:
    return first_group(attributes, rf'(?<![\w:]){name}\s*=\s*"([^"]*)"')


def _number(text: Column) -> Column:
    """Figures as accounts print them: brackets are negative, signs and units go."""
    digits = F.regexp_extract(
        F.regexp_replace(text, r"[(),£$\s]", ""), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0
    ).try_cast("double")
    return F.when(text.rlike(r"^\(.+\)$"), -digits).otherwise(digits)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _facts(html: Column) -> Column:
    """Array of (pos, name, context, value) in document order; a value only where one of our metrics is named.

    The document is scanned once. What is read of a fact comes from its own short text.
    """
    named = [t for tags in rules.ACCOUNTS_TAGS.values() for t in tags]
    # A fact's text is its opening tag, what it holds, and its closing tag.
    opened, closed = len("<ix:nonFraction") + 1, len("</ix:nonFraction>")
    tags = F.transform(
        F.regexp_extract_all(html, F.lit(FACT), F.lit(0)),
        lambda m, i: F.struct(i.alias("pos"), m.alias("m"), F.regexp_extract(m, FACT_HEAD, 1).alias("a")),
    )
    names = F.transform(tags, lambda f: F.struct(
        f["pos"].alias("pos"), f["m"].alias("m"), f["a"].alias("a"),
        F.element_at(F.split(_attribute(f["a"], "name"), ":"), -1).alias("name"),
    ))

    def fact(f: Column) -> Column:
        inner = F.substring(f["m"], F.length(f["a"]) + opened + 1, F.length(f["m"]) - F.length(f["a"]) - opened - closed)
        value = _number(strip(F.regexp_replace(inner, "<[^>]+>", "")))
        scale = first_group(_attribute(f["a"], "scale"), r"^\s*([+-]?\d+)").try_cast("int")
        sign = F.when(_attribute(f["a"], "sign") == "-", -1).otherwise(1)
        figure = sign * value * F.pow(F.lit(10.0), F.coalesce(scale, F.lit(0)))
        ours = f["name"].isin(named)
        return F.struct(
            f["pos"].alias("pos"), f["name"].alias("name"),
            F.when(ours, _attribute(f["a"], "contextRef")).alias("context"), F.when(ours, figure).alias("value"),
        )

    return F.transform(F.filter(names, lambda f: f["name"] != ""), fact)


def _contexts(html: Column) -> Column:
    """Array of (id, ends) of the dated contexts; the last of one id counts. They are sorted, not searched."""
    found = F.transform(
        F.regexp_extract_all(html, F.lit(CONTEXT), F.lit(0)),
        lambda m, i: F.struct(F.regexp_extract(m, CONTEXT, 1).alias("id"), i.alias("pos"), F.regexp_extract(m, CONTEXT, 2).alias("inner")),
    )
    dated = F.transform(found, lambda c: F.struct(
        c["id"].alias("id"), c["pos"].alias("pos"),
        strip(F.coalesce(first_group(c["inner"], END), first_group(c["inner"], INSTANT))).try_cast("date").alias("ends"),
    ))

    def last(every: Column) -> Column:
        return F.filter(every, lambda c, i: ~F.coalesce(F.get(every, i + 1)["id"] == c["id"], F.lit(False)) & c["ends"].isNotNull())

    return F.transform(_let(F.array_sort(dated), last), lambda c: F.struct(c["id"].alias("id"), c["ends"].alias("ends")))


def _figures(facts: Column, contexts: Column, made_up_to: Column) -> Column:
    """The first figure of each metric in the current and in the prior year, in one pass.

    Contexts and facts are sorted together by context id, so each context's year is known when its facts come. A
    fact without a context fits any year; without dated contexts all facts are current.
    """
    target = F.date_sub(made_up_to, YEAR_DAYS)
    near = lambda c: F.abs(F.datediff(c["ends"], made_up_to)) <= NEAR_DAYS
    prior = lambda c: F.abs(F.datediff(c["ends"], target)) <= PRIOR_DAYS
    metrics = list(rules.ACCOUNTS_TAGS)
    none = F.lit(None)

    def metric(name: Column) -> Column:
        which = F.when(F.lit(False), 0)
        for i, m in enumerate(metrics):
            which = which.when(name.isin(rules.ACCOUNTS_TAGS[m]), i)
        return which

    def entry(key, pos, which, value, year) -> Column:
        return F.struct(
            key.alias("key"), pos.cast("int").alias("pos"), which.cast("int").alias("metric"),
            value.cast("double").alias("value"), year.cast("int").alias("year"),
        )

    # Year 0 is current, 1 prior, 2 none, 3 any.
    years = F.transform(contexts, lambda c: entry(
        c["id"], F.lit(-1), none, none, F.when(near(c), 0).when(prior(c), 1).otherwise(2)
    ))
    asked = F.transform(
        F.filter(facts, lambda f: f["value"].isNotNull()),
        lambda f: entry(f["context"], f["pos"], metric(f["name"]), f["value"], F.when(made_up_to.isNull(), 0).when(f["context"].isNull(), 3)),
    )
    counted = F.filter(asked, lambda f: (f["metric"] != metrics.index("employees")) | (F.floor(f["value"] + 0.5) >= 0))
    slots = [f"{y}_{m}" for y in (0, 1) for m in range(len(metrics))]
    empty = F.lit(None).cast("struct<pos:int,value:double>")
    start = F.struct(none.cast("string").alias("key"), none.cast("int").alias("year"), *(empty.alias(x) for x in slots))

    def step(seen: Column, x: Column) -> Column:
        opens = x["metric"].isNull()
        known = F.when(seen["key"] == x["key"], seen["year"])
        year = F.coalesce(x["year"], known, F.lit(2))

        def slot(name: str) -> Column:
            y, m = map(int, name.split("_"))
            better = ~opens & (x["metric"] == m) & year.isin(y, 3) & (seen[name].isNull() | (x["pos"] < seen[name]["pos"]))
            return F.when(better, F.struct(x["pos"].alias("pos"), x["value"].alias("value"))).otherwise(seen[name]).alias(name)

        return F.struct(
            F.when(opens, x["key"]).otherwise(seen["key"]).alias("key"), F.when(opens, x["year"]).otherwise(seen["year"]).alias("year"),
            *(slot(x_) for x_ in slots),
        )

    def rounded(seen: Column) -> Column:
        def figure(y: int, m: int) -> Column:
            return F.floor(seen[f"{y}_{m}"]["value"] + 0.5).cast("int" if metrics[m] == "employees" else "bigint")

        return F.struct(*(figure(y, m).alias(p + name) for m, name in enumerate(metrics) for y, p in ((0, ""), (1, "prior_"))))

    return F.aggregate(F.array_sort(F.concat(years, counted)), start, step, rounded)


def parse_accounts(docs: DataFrame) -> DataFrame:
    """Figures per document. Everything is local to the row, so nothing is shuffled, and the work of a document
    is its length and a sort of its contexts and figures.

    Without contexts the first figures count as current. Without a prior-year context
    the prior figures are unknown.
    """
    d = docs.withColumns({"_facts": _facts(F.col("html")), "_ctx": _contexts(F.col("html"))})
    d = d.withColumn("made_up_to", F.array_max(F.transform("_ctx", lambda c: c.ends)))
    d = d.withColumn("_figures", _figures(F.col("_facts"), F.col("_ctx"), F.col("made_up_to")))
    target = F.date_sub("made_up_to", YEAR_DAYS)
    has_prior = F.exists(
        "_ctx",
        lambda c: (F.abs(F.datediff(c.ends, target)) <= PRIOR_DAYS) & (F.abs(F.datediff(c.ends, F.col("made_up_to"))) > NEAR_DAYS),
    )
    readable = F.length("html") >= rules.ACCOUNTS_MIN_CHARS
    undated = F.col("made_up_to").isNull()
    figures = {}
    for metric in rules.ACCOUNTS_TAGS:
        figures[metric] = F.when(readable, F.col(f"_figures.{metric}"))
        figures[f"prior_{metric}"] = F.when(readable & has_prior, F.col(f"_figures.prior_{metric}"))
    d = d.withColumns(figures)
    nothing = (F.coalesce("turnover", F.lit(0)) == 0) & (F.coalesce("employees", F.lit(0)) == 0)
    given = [c for c in docs.columns if c != "html"]
    return d.select(
        *given,
        F.when(readable, F.col("made_up_to")).alias("made_up_to"),
        *figures,
        (F.col("turnover").isNotNull() | F.col("employees").isNotNull()).alias("has_financials"),
        F.when(~readable | F.col("html").isNull(), "empty-document")
        .when(F.size("_facts") == 0, "no-ixbrl-tags")
        .when(undated & nothing, "no-matching-tags")
        .alias("reason"),
    )


def accounts_facts(docs: DataFrame) -> DataFrame:
    """The figures as rows of (document, metric, period, value)."""
    parsed = parse_accounts(docs)
    cells = [
        F.struct(
            F.lit(m).alias("metric"), F.lit(period).alias("period"),
            F.col(prefix + m).cast("bigint").alias("value"),
        )
        for m in rules.ACCOUNTS_TAGS
        for period, prefix in (("current", ""), ("prior", "prior_"))
    ]
    return (
        parsed.select("company_number", "document_id", F.explode(F.array(*cells)).alias("c"))
        .select("company_number", "document_id", "c.*")
        .where(F.col("value").isNotNull())
    )


def accounts_to_read(filings: DataFrame, docs: DataFrame, newest: int = 2) -> DataFrame:
    """Documents of the newest accounts filings of each company, scans left out."""
    w = Window.partitionBy("company_number").orderBy(F.desc_nulls_last("filing_date"), F.desc("filing_id"))
    chosen = (
        filings.where((F.col("category") == "accounts") & F.col("document_link").isNotNull())
        .withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= newest)
        .select("place", first_group("document_link", r"/document/([^/?#]+)").alias("document_id"))
    )
    return docs.where(~F.col("content_type").contains("pdf")).join(chosen, "document_id")


def latest_accounts(filings: DataFrame, docs: DataFrame) -> DataFrame:
    """Per company, the figures of the newest readable filing that holds some."""
    parsed = parse_accounts(accounts_to_read(filings, docs)).drop("content_type")
    row = F.struct(*[c for c in parsed.columns if c not in ("company_number", "place")])
    # A filter on the figures would be moved below their parsing and do it twice, so
    # documents without figures get no place instead.
    ranked = F.when(F.col("has_financials"), F.col("place"))
    return (
        parsed.groupBy("company_number")
        .agg(F.min_by(row, ranked).alias("r"))
        .where(F.col("r").isNotNull())
        .select("company_number", "r.*")
    )
