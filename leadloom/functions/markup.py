"""What one page says: each function takes its markup and returns an array or a value."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.functions.keys import (
    blank_to_null, first_group, norm_vrn, phone_e164_site, strip, url_host, with_scheme,
)
from leadloom.functions.text import decode_entities


def all_groups(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def email_rank(address: Column) -> Column:
    """Personal mailboxes rank above shared ones."""
    local = F.split_part(address, F.lit("@"), F.lit(1))
    return (  # fixed values: rank points
        F.when(local.isin(rules.GENERIC_MAILBOXES), 0)
        .when(local.rlike(r"^[a-z]+\.[a-z]+$"), 100)
        .when(local.rlike(r"^[a-z]{1,12}$"), 70)
        .otherwise(40)
    )


def emails(html: Column) -> Column:
    """Distinct addresses, best first."""
    found = F.array_distinct(F.transform(all_groups(html, rules.EMAIL_PATTERN), F.lower))
    kept = F.filter(
        found, lambda a: ~a.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in rules.IMAGE_SUFFIXES) + ")$")
    )
    ranked = F.array_sort(
        F.transform(kept, lambda a, i: F.struct((-email_rank(a)).alias("r"), i.alias("i"), a.alias("a")))
    )
    return F.transform(ranked, lambda s: s.a)


def phones(html: Column) -> Column:
    return F.array_distinct(F.transform(all_groups(html, rules.TEL_PATTERN), strip))


def phones_e164(raw: Column, site: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(raw, lambda p: phone_e164_site(p, site))))


def socials(html: Column, network: str) -> Column:
    pattern, group, stops = rules.SOCIAL_PATTERNS[network]
    whole = all_groups(html, pattern, 0)
    handle = all_groups(html, pattern, 1)
    pairs = F.zip_with(whole, handle, lambda w, h: F.struct(w.alias("w"), F.lower(h).alias("h")))
    if stops:
        pairs = F.filter(pairs, lambda p: ~p.h.isin(rules.SOCIAL_STOPWORDS))
    if network == "instagram":
        pairs = F.filter(pairs, lambda p: p.h != "p")
    if group == 1:
        return F.array_distinct(F.transform(pairs, lambda p: p.h))
    return F.array_distinct(F.transform(pairs, lambda p: F.regexp_replace(p.w, r"""["'?#].*$""", "")))


def open_graph(html: Column) -> Column:
    """Array of (key, value). A later tag wins; reversed attribute order only fills gaps."""
    forward = r"""(?i)<meta\s+[^>]*property=["']og:([^"']+)["'][^>]*content=["']([^"']+)["'][^>]*>"""
    backward = r"""(?i)<meta\s+[^>]*content=["']([^"']+)["'][^>]*property=["']og:([^"']+)["'][^>]*>"""

    def pairs(pattern: str, key: int, value: int) -> Column:
        return F.zip_with(
            all_groups(html, pattern, key),
            all_groups(html, pattern, value),
            lambda k, v: F.struct(F.lower(k).alias("key"), v.alias("value")),
        )

    ahead, behind = pairs(forward, 1, 2), pairs(backward, 2, 1)
    by_priority = F.concat(F.reverse(behind), ahead)
    keys = F.array_distinct(F.transform(F.concat(ahead, behind), lambda p: p.key))
    return F.transform(
        keys,
        lambda k: F.struct(
            k.alias("key"),
            F.element_at(F.filter(by_priority, lambda p: p.key == k), -1).value.alias("value"),
        ),
    )


def description(html: Column) -> Column:
    return decode_entities(
        first_group(html, r"""(?i)<meta\s+[^>]*name=["']description["'][^>]*content=["']([^"']+)["']""")
    )


def canonical(html: Column) -> Column:
    return first_group(html, r"""(?i)<link\s+[^>]*rel=["']canonical["'][^>]*href=["']([^"']+)["']""")


def title(html: Column) -> Column:
    return decode_entities(blank_to_null(strip(first_group(html, r"(?is)<title[^>]*>(.*?)</title>"))))


def _first(values: Column, limit: int | None) -> Column:
    return values if limit is None else F.slice(values, 1, limit)


def postcodes(html: Column, limit: int | None = None) -> Column:
    return _first(F.array_distinct(all_groups(html, rules.PAGE_POSTCODE_PATTERN, 0)), limit)


def people(visible: Column, limit: int | None = None) -> Column:
    """Array of (name, role) found beside job titles in text without tags.

    Every title is looked for on its own, because one name may answer two titles. A
    text that does not hold the title skips both patterns.
    """
    name = r"([A-Z][a-zA-Z'\-]+(?:\s+[A-Z][a-zA-Z'\-]+){1,2})"
    none = F.array().cast("array<string>")

    def titled(role: str):
        return lambda n: F.struct(n.alias("name"), F.lit(role).alias("role"))

    found = []
    for role in rules.PEOPLE_ROLES:
        before = all_groups(visible, rf"{name}\s*[,\-–—|:]+\s*{role}")
        after = all_groups(visible, rf"{role}[,\s:\-–—|]+{name}")
        names = F.when(visible.contains(role), F.concat(before, after)).otherwise(none)
        found.append(F.transform(names, titled(role)))
    listed = F.concat(*found)
    keys = F.transform(listed, lambda p: F.lower(p["name"]))
    first = F.filter(listed, lambda p, i: F.array_position(keys, F.lower(p["name"])) == i + 1)
    return _first(first, limit)


def vat_number(html: Column) -> Column:
    """The first valid labelled VAT number, else a bare one."""

    def first_valid(pattern: str) -> Column:
        return F.get(F.array_compact(F.transform(all_groups(html, pattern), norm_vrn)), F.lit(0))

    return F.coalesce(first_valid(rules.VAT_LABELLED_PATTERN), first_valid(rules.VAT_BARE_PATTERN))


# ---- structured data blocks ---------------------------------------------------


#: JSON as a browser reads it.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def ld_roots(blocks: Column) -> Column:
    """Array of (path, text): the JSON objects and lists that are whole blocks; the path is the block's place."""

    def root(block: Column, i: Column) -> Column:
        # Parsed inside a list, a block with anything behind its value is no JSON, or gives more than two entries.
        listed = F.from_json(F.concat(F.lit("["), block, F.lit(",0]")), "array<string>", _STRICT)
        whole = block.rlike(r"^\s*[{\[]") & (F.size(listed) == 2)
        return F.when(whole, F.struct(F.array(i).alias("path"), listed[0].alias("text")))

    return F.array_compact(F.transform(blocks, root))


_OPTIONS = ", ".join(f"'{k}', '{v}'" for k, v in _STRICT.items())


def ld_entries(containers: str) -> Column:
    """What each of the objects and lists directly holds, in the order of the text.

    Array of (path, text, entries, nests): entries are (key, value), with objects and lists as JSON text, and
    ``nests`` tells for each whether it is one. Text that cannot be followed gives null entries.
    """
    return F.expr(f"""transform({containers}, c -> named_struct('path', c.path, 'text', c.text, 'entries',
      if(startswith(c.text, '{{'), map_entries(from_json(c.text, 'map<string,string>', map({_OPTIONS}))),
        transform(from_json(c.text, 'array<string>', map({_OPTIONS})), v -> named_struct('key', '', 'value', v))),
      'nests', transform(if(startswith(c.text, '{{'), map_values(from_json(c.text, 'map<string,variant>', map({_OPTIONS}))),
        from_json(c.text, 'array<variant>', map({_OPTIONS}))), v -> schema_of_variant(v) rlike '^(OBJECT|ARRAY)<')))""")


def ld_inner(read: str) -> Column:
    """The objects and lists directly inside those of ``ld_entries``, as (path, text)."""
    return F.expr(f"""flatten(transform({read}, e -> coalesce(array_compact(transform(e.entries, (x, i) -> if(get(e.nests, i),
      named_struct('path', concat(e.path, array(i)), 'text', x.value), null))),
      cast(array() AS array<struct<path:array<int>,text:string>>))))""")


def ld_typed(read: str) -> Column:
    """The objects of ``ld_entries`` that name their type, as (path, text)."""
    return F.expr(f"""transform(filter({read}, e -> startswith(e.text, '{{')
      AND exists(e.entries, x -> x.key = '@type' AND x.value NOT IN ('', '[]', '{{}}'))),
      e -> named_struct('path', e.path, 'text', e.text))""")


def ld_unread(read: str) -> Column:
    """Whether one of ``ld_entries`` could not be followed, or names a key twice."""
    return F.expr(f"""exists({read}, e -> e.entries IS NULL OR e.nests IS NULL OR (startswith(e.text, '{{')
      AND size(array_distinct(transform(e.entries, x -> x.key))) < size(e.entries)))""")


def ld_nodes_of_any_depth(blocks: Column) -> Column:
    """JSON texts of the typed objects in the blocks of each page, parents first; nothing for null blocks.

    Follows objects of open depth, which column expressions cannot.
    """

    def walk(node):
        if isinstance(node, dict):
            if node.get("@type"):
                yield node
            node = list(node.values())
        if isinstance(node, list):
            for child in node:
                yield from walk(child)

    def refuse(name):
        raise ValueError(name)

    def nodes(texts) -> list[str]:
        out = []
        for text in () if texts is None else texts:
            try:
                out.extend([json.dumps(n) for n in walk(json.loads(text.strip(), parse_constant=refuse))])
            except (ValueError, RecursionError):
                continue
        return out

    def of_pages(blocks: pd.Series) -> pd.Series:
        return blocks.map(nodes)

    return F.pandas_udf(of_pages, "array<string>")(blocks)


def ld_blocks(html: Column) -> Column:
    return all_groups(html, rules.LD_BLOCK_PATTERN)


def _json(node: Column, path: str) -> Column:
    return F.get_json_object(node, f"$.{path}")


def _many(text: Column) -> Column:
    """A JSON value as an array of texts, whether it is one value or a list."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(
        text.isNotNull(), F.array(text)
    )


def ld_is_organisation(node: Column) -> Column:
    return _json(node, "@type").rlike("(?i)" + "|".join(rules.LD_ORG_TYPES))


def ld_is_person(node: Column) -> Column:
    return _json(node, "@type").rlike('(?i)(^|")person("|$)')


def ld_text(node: Column, field: str) -> Column:
    """The value of a field, null unless it is a JSON string."""
    return _parsed_text(F.try_parse_json(node), field)


def _parsed_text(parsed: Column, field: str) -> Column:
    value = F.try_variant_get(parsed, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def ld_address(node: Column) -> Column:
    """The address if it is a text, else its parts, of which a street must be there."""
    return _parsed_address(F.try_parse_json(node))


def _parsed_address(parsed: Column) -> Column:
    parts = ["streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry"]
    joined = F.array_join(
        F.filter(
            F.array(*(_parsed_text(parsed, f"address.{p}") for p in parts)), lambda p: p.isNotNull() & (p != "")
        ),
        ", ",
    )
    street = F.coalesce(_parsed_text(parsed, "address.streetAddress"), F.lit("")) != ""
    return F.coalesce(_parsed_text(parsed, "address"), F.when(street, joined))


def ld_people(node: Column, organisation: Column) -> Column:
    """Array of (name, role) of founders, employees and persons."""

    def entries(path: str, default: str, plain: bool) -> Column:
        def entry(e: Column) -> Column:
            is_object = e.startswith("{")
            name = F.when(is_object, _json(e, "name"))
            if plain:
                name = name.when(~is_object, e)
            role = F.lit(default) if plain else F.coalesce(_json(e, "jobTitle"), F.lit(default))
            return F.struct(name.alias("name"), role.alias("role"))

        many = F.coalesce(F.transform(_many(_json(node, path)), entry), empty)
        return F.when(organisation, many).otherwise(empty)

    empty = F.array().cast("array<struct<name:string,role:string>>")
    person = F.array(F.struct(_json(node, "name").alias("name"), _json(node, "jobTitle").alias("role")))
    listed = F.concat(
        entries("founder", "Founder", True),
        entries("employee", "Employee", False),
        F.when(ld_is_person(node), person).otherwise(empty),
    )
    return F.filter(listed, lambda p: p["name"].isNotNull() & (p["name"] != ""))


def ld_same_as(node: Column, organisation: Column) -> Column:
    return F.coalesce(
        F.when(organisation, F.from_json(_json(node, "sameAs"), "array<string>")),
        F.array().cast("array<string>"),
    )


def ld_facts(nodes: Column) -> Column:
    """What each object says: (email, phone, address, same_as, people).

    Each object is parsed once. Only organisations have the first four and founders or employees.
    """
    parsed = F.transform(
        nodes,
        lambda n: F.struct(
            n.alias("node"), F.coalesce(ld_is_organisation(n), F.lit(False)).alias("organisation"),
            F.try_parse_json(n).alias("parsed"),
        ),
    )

    def facts(p: Column) -> Column:
        node, organisation = p["node"], p["organisation"]
        body = F.when(organisation, p["parsed"])
        return F.struct(
            _parsed_text(body, "email").alias("email"), _parsed_text(body, "telephone").alias("phone"),
            _parsed_address(body).alias("address"), ld_same_as(node, organisation).alias("same_as"),
            ld_people(node, organisation).alias("people"),
        )

    return F.transform(parsed, facts)


# ---- links ---------------------------------------------------------------------


def url_origin(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^(https?://[^/?#]+)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)


def absolute_url(href: Column, origin: Column, path: Column) -> Column:
    """``href`` as a reader of the page at ``origin`` and ``path`` would follow it."""
    folder = F.regexp_replace(path, "[^/]*$", "")
    url = (
        F.when(href.rlike("(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(F.split_part(origin, F.lit("//"), F.lit(1)), href))
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), href))
    )
    return F.when(url.rlike(r"/\.{1,2}(?=[/?#]|$)"), _without_dots(url)).otherwise(url)


def _without_dots(url: Column) -> Column:
    """``.`` and ``..`` steps of the path carried out, at any depth."""
    origin, path = url_origin(url), url_path(url)
    steps = F.filter(F.split(path, "/"), lambda s: s != ".")
    none = F.array().cast("array<string>")

    def step(kept: Column, s: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.lit(1), F.size(kept) - 1))
        return F.when(s == "..", up).otherwise(F.concat(kept, F.array(s)))

    folder = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    clean = F.concat(F.array_join(F.aggregate(steps, none, step), "/"), folder)
    return F.concat(origin, clean, F.substring(url, F.length(origin) + F.length(path) + 1, F.length(url)))


def subpage_weight(path: Column) -> Column:
    """The highest weight of the patterns a path matches, null if it matches none."""
    return F.greatest(*(F.when(path.rlike("(?i)" + p), w) for p, w in rules.SUBPAGE_WEIGHTS))


def sitemap_urls(xml: Column, limit: int | None = None) -> Column:
    words = "|".join(rules.SITEMAP_WORDS)
    urls = all_groups(xml, r"(?i)<loc>\s*([^<\s]+)\s*</loc>")
    return _first(F.filter(urls, lambda u: u.rlike(rf"(?i)\b({words})\b")), limit)


# ---- whole-page checks ---------------------------------------------------------


def is_blocker_page(html: Column) -> Column:
    low = F.lower(html)
    small = F.length(html) < 3000
    return (
        html.isNull()
        | (F.length(html) < 500)
        | low.contains("cf-error-details")
        | (low.contains("cloudflare") & low.contains("challenge"))
        | ((low.contains("access denied") | low.contains("just a moment")) & small)
    )


def bare_host(url: Column) -> Column:
    return F.regexp_replace(url_host(url), r"^www\.", "")


def website_problem(
    url: Column, final_url: Column, status: Column, html: Column, head_chars: int | None = None
) -> Column:
    """Why a fetched site is no business website, null if it looks like one.

    The whole page is searched for parking phrases; ``head_chars`` limits that to its top.
    """
    asked, final = bare_host(with_scheme(url)), bare_host(final_url)
    body = F.lower(html if head_chars is None else F.left(html, F.lit(head_chars)))
    parked = F.lit(False)
    for p in rules.PARKED_DOMAINS:
        parked = parked | final.contains(p)
    problem = (
        F.when(asked.isNull(), F.concat(F.lit("Invalid URL format: "), url))
        .when(
            asked.isin(rules.SOCIAL_HOSTS),
            F.format_string("Social media profile (%s), not a business website", asked),
        )
        .when(parked, F.concat(F.lit("Redirected to parked domain: "), final))
        .when(final.isin(rules.SOCIAL_HOSTS), F.concat(F.lit("Redirected to social media: "), final))
        .when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string")))
    )
    for phrase in rules.PARKED_PHRASES:
        problem = problem.when(body.contains(phrase), f'Parked domain indicator: "{phrase}"')
    return problem


def robots_allow(body: Column) -> Column:
    """False where the rules for all agents forbid the whole site."""
    start = F.struct(F.lit(False).alias("star"), F.lit(False).alias("denied"))

    def read(seen: Column, raw: Column) -> Column:
        line = strip(raw)
        parts = F.split(line, ":")
        value = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
        key = F.when((value != "") & ~line.startswith("#"), F.lower(strip(parts[0])))
        value = strip(value)
        agent = F.coalesce(key == "user-agent", F.lit(False))
        deny = F.coalesce(key == "disallow", F.lit(False)) & value.isin("/", "/*")
        return F.struct(
            F.when(agent, value == "*").otherwise(seen["star"]).alias("star"),
            (seen["denied"] | (seen["star"] & deny)).alias("denied"),
        )

    return ~F.aggregate(F.split(F.coalesce(body, F.lit("")), "\r?\n"), start, read)["denied"]

