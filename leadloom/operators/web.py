"""Contact extraction over a table of pages, and its merge by site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import markup, rules
from leadloom.functions.keys import phone_e164_site, url_host, with_scheme
from leadloom.functions.text import html_to_text, text_floor, visible_text
from leadloom.session import cut_lineage

# fixed values: kinds of hits
KINDS = [
    "email", "phone", "phone_e164", *rules.SOCIAL_PATTERNS, "og", "description", "canonical",
    "title", "address", "person",
]
LD_KINDS = {"email", "phone", "phone_e164", "instagram", "linkedin", "facebook", "address", "person"}
HIT = "struct<kind:string,value:string,pos:int,extra:string,source:string>"


def _hits(kind: str, values: Column, source: str, extra: Column | None = None) -> Column:
    """An array of texts as an array of hits, numbered by position."""
    offset = 1_000_000 if source == "json-ld" else 0  # structured data ranks after page text
    none = F.lit(None).cast("string")
    return F.transform(
        values,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), x.alias("value"), (i + offset).alias("pos"),
            (none if extra is None else extra).alias("extra"), F.lit(source).alias("source"),
        ),
    )


def _pair_hits(kind: str, pairs: Column, value: str, extra: str, source: str) -> Column:
    offset = 1_000_000 if source == "json-ld" else 0
    return F.transform(
        pairs,
        lambda p, i: F.struct(
            F.lit(kind).alias("kind"), p[value].alias("value"), (i + offset).alias("pos"),
            p[extra].alias("extra"), F.lit(source).alias("source"),
        ),
    )


def _one(c: Column) -> Column:
    return F.array_compact(F.array(c))


def _text_hits(kinds: set[str]) -> list[Column]:
    html, site = F.col("html"), F.col("url")
    raw = markup.phones(html)
    out = {
        "email": lambda: _hits("email", markup.emails(html), "page"),
        "phone": lambda: _hits("phone", raw, "page"),
        "phone_e164": lambda: _hits("phone_e164", markup.phones_e164(raw, site), "page"),
        "og": lambda: _pair_hits("og", markup.open_graph(html), "value", "key", "page"),
        "description": lambda: _hits("description", _one(markup.description(html)), "page"),
        "canonical": lambda: _hits("canonical", _one(markup.canonical(html)), "page"),
        "title": lambda: _hits("title", _one(markup.title(html)), "page"),
        "address": lambda: _hits("address", markup.postcodes(html), "page"),
        "person": lambda: _pair_hits(
            "person", markup.people(F.col("_visible")), "name", "role", "heuristic"
        ),
    }
    for network in rules.SOCIAL_PATTERNS:
        out[network] = lambda n=network: _hits(n, markup.socials(html, n), "page")
    return [out[k]() for k in KINDS if k in kinds]


#: Levels of objects and lists in structured data that column expressions follow.
LD_LEVELS = 6


def with_nodes(pages: DataFrame, levels: int = LD_LEVELS) -> DataFrame:
    """``pages`` with ``_nodes``: JSON texts of the typed structured-data objects, in the order of the page.

    The objects and lists of each level are read from those above it, and paths bring all levels back into
    order. Only blocks that go deeper than ``levels``, or name a key of an object twice, go to Python.
    """
    kept = pages.columns
    df = pages.withColumn("_blocks", markup.ld_blocks(F.col("html"))).withColumn("_in0", markup.ld_roots(F.col("_blocks")))
    for k in range(levels):
        df = df.withColumn(f"_read{k}", markup.ld_entries(f"_in{k}")).withColumn(f"_in{k + 1}", markup.ld_inner(f"_read{k}"))
    reads = [f"_read{k}" for k in range(levels)]
    beyond = F.size(f"_in{levels}") > 0
    for read in reads:
        beyond = beyond | markup.ld_unread(read)
    typed = F.array_sort(F.concat(*(markup.ld_typed(read) for read in reads)))
    df = df.select(
        *kept, F.when(beyond, F.col("_blocks")).alias("_deep"), F.transform(typed, lambda t: t["text"]).alias("_near"),
    ).withColumn("_any", markup.ld_nodes_of_any_depth(F.col("_deep")))
    return df.select(*kept, F.when(F.col("_deep").isNull(), F.col("_near")).otherwise(F.col("_any")).alias("_nodes"))


def _ld_hits(kinds: set[str]) -> list[Column]:
    """Hits from what the structured-data objects say, ``_facts``."""
    facts = F.col("_facts")

    def values(field: str) -> Column:
        return F.array_compact(F.transform(facts, lambda f: f[field]))

    same_as = F.flatten(F.transform(facts, lambda f: f["same_as"]))

    def links(host: str) -> Column:
        return F.filter(same_as, lambda u: u.rlike(rf"(?i){host}\.com/"))

    instagram = F.transform(links("instagram"), lambda u: F.lower(F.regexp_extract(u, r"(?i)instagram\.com/([^/?#]+)", 1)))
    e164 = F.array_compact(F.transform(values("phone"), lambda p: phone_e164_site(p, F.lit(""))))
    people = F.flatten(F.transform(facts, lambda f: f["people"]))
    out = {
        "email": lambda: _hits("email", F.transform(values("email"), F.lower), "json-ld"),
        "phone": lambda: _hits("phone", values("phone"), "json-ld"),
        "phone_e164": lambda: _hits("phone_e164", e164, "json-ld"),
        "instagram": lambda: _hits("instagram", F.filter(instagram, lambda h: h != ""), "json-ld"),
        "linkedin": lambda: _hits("linkedin", links("linkedin"), "json-ld"),
        "facebook": lambda: _hits("facebook", links("facebook"), "json-ld"),
        "address": lambda: _hits("address", values("address"), "json-ld"),
        "person": lambda: _pair_hits("person", people, "name", "role", "json-ld"),
    }
    return [out[k]() for k in KINDS if k in kinds and k in out]


def page_hits(
    pages: DataFrame, kinds: Sequence[str] = tuple(KINDS), sources: Sequence[str] = ("text", "json-ld")
) -> DataFrame:
    """hits(page_id, domain, page_ord, kind, value, pos, extra, source).

    All kinds come from one read of the page, in one row-local step without a shuffle.
    Text in structured data counts as page text too, as any reader of the markup sees it.
    """
    wanted = set(kinds)
    df = pages.select("page_id", "domain", "page_ord", "url", "html")
    arrays: list[Column] = []
    if "text" in sources:
        if "person" in wanted:
            df = df.withColumn("_visible", visible_text("html"))
        arrays += _text_hits(wanted)
    if "json-ld" in sources and wanted & LD_KINDS:
        if sources == ["json-ld"]:
            df = df.where(F.col("html").rlike(rules.LD_BLOCK_PATTERN))
        df = with_nodes(df).withColumn("_facts", markup.ld_facts(F.col("_nodes")))
        arrays += _ld_hits(wanted)
    typed = [a.cast(f"array<{HIT}>") for a in arrays]
    return df.select("page_id", "domain", "page_ord", F.explode(F.concat(*typed)).alias("h")).select(
        "page_id", "domain", "page_ord", "h.*"
    )


def subpages(
    pages: DataFrame, sitemaps: DataFrame | None = None, few: int = 3, limit: int | None = None
) -> DataFrame:
    """Pages of a site worth reading next, from the links of its home page.

    Where the links give fewer than ``few``, the site map adds its own, ranked after them.
    ``limit`` keeps the best of each site; all by default.
    """
    home = (
        pages.where(F.col("page_ord") == 0)
        .select("domain", with_scheme("url").alias("base"), "html")
        .select(
            "domain", F.lower(markup.url_origin(F.col("base"))).alias("origin"),
            markup.url_path(F.col("base")).alias("home_path"),
            markup.all_groups(F.col("html"), r"""(?i)href=["']([^"']+)["']""").alias("hrefs"),
        )
    )

    def link(url: Column, i: Column) -> Column:
        return F.struct(
            i.alias("pos"), F.lower(markup.url_origin(url)).alias("to"), markup.url_path(url).alias("path")
        )

    wanted = F.filter("hrefs", lambda h: ~h.rlike("^(#|mailto:|tel:|javascript:)"))
    urls = F.transform(wanted, lambda h: markup.absolute_url(h, F.col("origin"), F.col("home_path")))
    links = (
        home.select("domain", "origin", "home_path", F.explode(F.transform(urls, link)).alias("l"))
        .select("domain", "origin", "home_path", "l.*")
        .withColumn("weight", markup.subpage_weight(F.col("path")))
        .where(F.col("weight").isNotNull() & (url_host("to") == url_host("origin")))
        .where(~F.col("path").rlike(rules.ASSET_PATTERN))
        .withColumn("clean", F.regexp_replace("path", "/$", ""))
        .where(
            (F.col("to") != F.col("origin"))
            | (F.col("clean") != F.regexp_replace("home_path", "/$", ""))
        )
        .withColumn("clean", F.concat("to", "clean"))
    )
    ranked = links.groupBy("domain", F.col("clean").alias("url")).agg(
        F.max("weight").alias("weight"), F.min("pos").alias("pos")
    )
    if sitemaps is not None:
        enough = ranked.groupBy("domain").agg(F.count("*").alias("n")).where(F.col("n") >= few)
        listed = sitemaps.select(
            "domain", F.posexplode(markup.sitemap_urls(F.col("xml"))).alias("pos", "url")
        ).join(enough.select("domain"), "domain", "left_anti")
        ranked = (
            ranked.unionByName(listed.select("domain", "url", F.lit(0).alias("weight"), "pos"))
            .groupBy("domain", "url")
            .agg(F.max("weight").alias("weight"), F.min("pos").alias("pos"))
        )
    w = Window.partitionBy("domain").orderBy(F.desc("weight"), "pos", "url")
    ranked = ranked.withColumn("place", F.row_number().over(w))
    return ranked if limit is None else ranked.where(F.col("place") <= limit)


# fixed values: kinds of which the first page with a value wins
FIRST_WINS = ["description", "canonical", "title"]


def site_merge(hits: DataFrame) -> DataFrame:
    """Distinct hits of each site, each with the place it was first seen at.

    Sites are never collected: order is carried by (page_ord, pos), and every reduction
    is a partial aggregate, so one site may hold any share of the pages.
    """
    at = F.struct("page_ord", "pos")
    row = F.struct("value", "extra", "source", "page_ord", "pos")
    kind = F.col("kind")
    identity = (
        F.when(kind.isin(FIRST_WINS), F.lit(""))
        .when(kind == "og", F.col("extra"))
        .when(kind == "person", F.trim(F.regexp_replace(F.lower("value"), r"\s+", " ")))
        .otherwise(F.col("value"))
    )
    keyed = hits.withColumn("identity", identity)
    return (
        keyed.groupBy("domain", "kind", "identity")
        .agg(F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"))
        .withColumn("r", F.when(kind == "og", F.col("last")).otherwise(F.col("first")))
        .select("domain", "kind", "r.*")
    )


def site_contacts(merged: DataFrame, fill: DataFrame, ld_sites: DataFrame) -> DataFrame:
    """Owner, checked address and confidence of each site.

    ``fill`` holds what an outside reader of the site suggested. A suggested address
    counts only if it was really found; ``ld_sites`` names sites with structured data.
    """
    at = F.struct("page_ord", "pos")
    person, is_email = F.col("kind") == "person", F.col("kind") == "email"
    role = F.coalesce("extra", F.lit(""))
    led = person & (F.col("source") == "json-ld") & role.rlike("(?i)founder|owner|ceo|director")
    owns = person & role.rlike("(?i)founder|owner")
    found = merged.groupBy("domain").agg(
        F.min_by(F.when(led, F.col("value")), F.when(led, at)).alias("ld_owner"),
        F.min_by(F.when(owns, F.col("value")), F.when(owns, at)).alias("text_owner"),
        F.count_if(person).alias("n_people"),
        F.count_if(is_email).alias("n_emails"),
    )
    chosen = fill.withColumn("email", F.lower("email")).join(
        merged.where(is_email).select("domain", F.col("value").alias("email"), F.lit(True).alias("real")),
        ["domain", "email"],
        "left",
    )
    # The best four others: at most five per site survive the ranking.
    w = Window.partitionBy("domain").orderBy("page_ord", "pos")
    top = merged.where(is_email).withColumn("place", F.row_number().over(w)).where(F.col("place") <= 5)
    listed = top.groupBy("domain").agg(
        F.array_sort(F.collect_list(F.struct("place", "value"))).alias("top")
    )
    picked = F.when(F.col("real"), F.col("email"))
    others = F.filter(
        F.transform("top", lambda t: t.value), lambda e: ~e.eqNullSafe(F.col("picked"))
    )
    points = (
        (F.col("owner_name").isNotNull() | (F.col("n_people") > 0)).cast("int")
        + (F.col("n_emails") > 0).cast("int")
        + F.col("description").isNotNull().cast("int")
        + F.col("has_ld").cast("int")
    )
    return (
        chosen.withColumn("picked", picked)
        .join(found, "domain", "left")
        .join(listed, "domain", "left")
        .join(ld_sites.select("domain").distinct().withColumn("ld", F.lit(True)), "domain", "left")
        .withColumns(
            {
                "n_people": F.coalesce("n_people", F.lit(0)),
                "n_emails": F.coalesce("n_emails", F.lit(0)),
                "has_ld": F.coalesce("ld", F.lit(False)),
            }
        )
        .select(
            "domain",
            F.coalesce("owner_name", "ld_owner", "text_owner").alias("owner_name"),
            F.col("picked").alias("email"),
            F.slice(F.coalesce(others, F.array().cast("array<string>")), 1, 4).alias("alternates"),
            F.when(points >= 3, "high").when(points >= 2, "medium").otherwise("low").alias("confidence"),
        )
    )


def ld_sites(pages: DataFrame) -> DataFrame:
    """Sites with a structured-data block that is an object or a list of something, with or without a type."""
    roots = markup.ld_roots(markup.ld_blocks(F.col("html")))
    said = F.exists(roots, lambda r: ~r["text"].rlike(r"^\[\s*\]$"))
    return pages.where(said).select("domain")


def _before(*by: str) -> Column:
    """The sum of sizes before a row; all of ``by`` but the last name its group."""
    w = Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("size").over(w), F.lit(0))


def _stretches(sizes: DataFrame) -> DataFrame:
    """Sums of a thousand pages each, and of what is before them, so that a huge site needs no huge sort."""
    return (
        sizes.groupBy("domain", "stretch")
        .agg(F.sum("size").alias("size"))
        .withColumn("offset", _before("domain", "stretch"))
    )


def _page_head() -> Column:
    return F.when(
        F.col("page_ord") == 0, F.format_string("--- HOMEPAGE: %s ---\n", F.col("url"))
    ).otherwise(F.format_string("--- PAGE: %s ---\n", F.col("url")))


def pages_within(pages: DataFrame, max_chars: int) -> DataFrame:
    """The pages of each site without those that surely begin beyond a number of characters of its text.

    Floors of text lengths are summed in page order, before any text is extracted. Only sites whose floors reach
    the limit have a last page, so the table that is joined holds one row for each of these.
    """
    size = F.when(F.col("html").isNull(), 0).otherwise(F.length(_page_head()) + text_floor("html") + 2)
    sizes = pages.select(
        "domain", "page_ord", F.coalesce(size, F.lit(0)).alias("size"), F.floor(F.col("page_ord") / 1000).alias("stretch")
    )
    reached = (
        _stretches(sizes)
        .where((F.col("offset") < max_chars) & (F.col("offset") + F.col("size") >= max_chars))
        .select("domain", "stretch", "offset")
    )
    last = (
        sizes.join(reached, ["domain", "stretch"])
        .withColumn("start", F.col("offset") + _before("domain", "stretch", "page_ord"))
        .where(F.col("start") + F.col("size") >= max_chars)
        .groupBy("domain")
        .agg(F.min("page_ord").alias("last"))
    )
    return (
        pages.join(last, "domain", "left")
        .where(F.col("last").isNull() | (F.col("page_ord") <= F.col("last")))
        .select(*pages.columns)
    )


def page_assembly(pages: DataFrame, max_chars: int = 40_000) -> DataFrame:
    """The readable text of each site, pages in order, up to the size a reader accepts.

    Pages that surely begin beyond the limit are left out before any markup is parsed. Of the others
    only lengths are ordered, and those that begin beyond the limit are dropped before any
    text is gathered, so what is gathered per site is bounded by the limit and one page.
    """
    read = pages_within(pages.select("domain", "page_ord", "url", "html"), max_chars)
    texts = read.select("domain", "page_ord", F.concat(_page_head(), html_to_text("html")).alias("text"))
    # Written once: the lengths and the texts are read from it, the markup only here.
    texts = cut_lineage(texts.withColumn("size", F.length("text") + 2))
    sizes = texts.select("domain", "page_ord", "size").withColumn("stretch", F.floor(F.col("page_ord") / 1000))
    stretches = _stretches(sizes).where(F.col("offset") < max_chars).drop("size")
    kept = (
        sizes.join(stretches, ["domain", "stretch"])
        .withColumn("start", F.col("offset") + _before("domain", "stretch", "page_ord"))
        .where(F.col("start") < max_chars)
        .select("domain", "page_ord")
    )
    return (
        texts.join(kept, ["domain", "page_ord"])
        .groupBy("domain")
        .agg(F.array_sort(F.collect_list(F.struct("page_ord", "text"))).alias("t"))
        .select(
            "domain",
            F.left(
                F.array_join(F.transform("t", lambda x: x.text), "\n\n"), F.lit(max_chars)
            ).alias("text"),
        )
    )
