"""Page extraction, site merge and website check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import markup, rules
from leadloom.operators import web
from leadloom.plans.key_queries import chain_sql, html_text_sql
from leadloom.plans.register_queries import quoted
from leadloom.plans.registry import register

PAGES = "@site_pages_v@"


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def found_sql(pattern: str, group: int = 1, source: str = PAGES, c: str = "html", flags: str = "i", keep: str = "page_id, domain, page_ord") -> str:
    """Every match of a pattern: value and position."""
    return f"""SELECT {keep}, unnest(m) AS value, generate_subscripts(m, 1) AS p FROM (
      SELECT {keep}, regexp_extract_all({c}, {q(pattern)}, {group}, '{flags}') AS m FROM {source})"""


def first_seen_sql(inner: str) -> str:
    """Distinct values per page in the order of their first match."""
    return f"""SELECT page_id, domain, page_ord, value, (row_number() OVER (PARTITION BY page_id ORDER BY min(p)) - 1)::int AS pos
      FROM ({inner}) GROUP BY page_id, domain, page_ord, value"""


RANK_SQL = f"""CASE WHEN split_part(value, '@', 1) IN ({quoted(rules.GENERIC_MAILBOXES)}) THEN 0
  WHEN regexp_full_match(split_part(value, '@', 1), '[a-z]+\\.[a-z]+') THEN 100
  WHEN regexp_full_match(split_part(value, '@', 1), '[a-z]{{1,12}}') THEN 70 ELSE 40 END"""
EMAIL_SQL = f"""SELECT page_id, domain, page_ord, value, (row_number() OVER (PARTITION BY page_id ORDER BY {RANK_SQL} DESC, min(p)) - 1)::int AS pos FROM (
    SELECT * REPLACE (lower(value) AS value) FROM ({found_sql('(?:mailto:)?([a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,})')}))
  WHERE NOT regexp_matches(value, '[.](png|jpg|webp|gif|svg)$') GROUP BY page_id, domain, page_ord, value"""
PHONE_SQL = first_seen_sql(
    f"SELECT * REPLACE (trim(value) AS value) FROM ({found_sql('tel:([+0-9][0-9 ().-]{6,})')})"
)


def hits(v, *kinds, source="text"):
    return web.page_hits(v.site_pages_v, kinds, [source])


register(
    "emails",
    lambda v: hits(v, "email").select("page_id", "value", "pos"),
    f"SELECT page_id, value, pos FROM ({EMAIL_SQL})",
)
register(
    "email_rank",
    lambda v: hits(v, "email").select("value", markup.email_rank(F.col("value")).alias("rank")).distinct(),
    f"SELECT DISTINCT value, {RANK_SQL} AS rank FROM ({EMAIL_SQL})",
)
register(
    "phones",
    lambda v: hits(v, "phone", "phone_e164").select("page_id", "kind", "value", "pos"),
    f"""SELECT page_id, 'phone' AS kind, value, pos FROM ({PHONE_SQL}) UNION ALL
    SELECT page_id, 'phone_e164', e, (row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1)::int FROM (
      SELECT page_id, pos, CASE WHEN d LIKE '+%' THEN d WHEN regexp_full_match(d, '[0-9]{{10}}') THEN '+1' || d END AS e
      FROM (SELECT *, regexp_replace(value, '[^0-9+]', '', 'g') AS d FROM ({PHONE_SQL}))) WHERE e IS NOT NULL GROUP BY page_id, e""",
)
STOPS = quoted(rules.SOCIAL_STOPWORDS)
SOCIAL_SQL = " UNION ALL ".join(
    f"SELECT page_id, '{kind}' AS kind, value, pos FROM ({first_seen_sql(inner)})"
    for kind, inner in [
        (k, f"""SELECT page_id, domain, page_ord, p, {'lower(regexp_extract(value, ' + q(p) + ", 1, 'i'))" if g == 1 else "regexp_replace(value, '[?#\"''].*$', '')"} AS value
          FROM ({found_sql(p, 0)}) WHERE {'lower(regexp_extract(value, ' + q(p) + ", 1, 'i')) NOT IN (" + STOPS + ", 'p')" if stop else 'true'}""")
        for k, (p, g, stop) in (
            (k, (p.removeprefix("(?i)"), g, s)) for k, (p, g, s) in rules.SOCIAL_PATTERNS.items()
        )
    ]
)
register(
    "socials",
    lambda v: hits(v, *rules.SOCIAL_PATTERNS).select("page_id", "kind", "value", "pos"),
    SOCIAL_SQL,
)
BLOCKS_SQL = f"""SELECT * FROM ({found_sql("<script[^>]*type=[\"']application/ld[+]json[\"'][^>]*>(.*?)</script>", flags="is")}) WHERE json_valid(value)"""
NODES_SQL = f"""SELECT page_id, domain, page_ord, b.p AS block, t.id AS nr, t.value AS node, t.value ->> '$."@type"' AS types FROM ({BLOCKS_SQL}) b,
    json_tree(b.value) t WHERE t.type = 'OBJECT' AND t.value ->> '$."@type"' IS NOT NULL"""
ORG = "regexp_matches(types, 'Organization|LocalBusiness|Store', 'i')"
LD_PEOPLE_SQL = f"""SELECT page_id, domain, page_ord, block, nr, 0 AS part, node ->> '$.founder.name' AS value, 'Founder' AS extra FROM nodes WHERE {ORG}
    UNION ALL SELECT page_id, domain, page_ord, block, nr, 1, unnest(node -> '$.employee[*]') ->> '$.name', coalesce(unnest(node -> '$.employee[*]') ->> '$.jobTitle', 'Employee') FROM nodes WHERE {ORG}
    UNION ALL SELECT page_id, domain, page_ord, block, nr, 2, node ->> '$.name', node ->> '$.jobTitle' FROM nodes WHERE types = 'Person'"""
LD_SQL = f"""WITH nodes AS ({NODES_SQL})
    SELECT page_id, 'email' AS kind, lower(node ->> '$.email') AS value, NULL AS extra FROM nodes WHERE {ORG} AND node ->> '$.email' IS NOT NULL
    UNION ALL SELECT page_id, 'phone', node ->> '$.telephone', NULL FROM nodes WHERE {ORG} AND node ->> '$.telephone' IS NOT NULL
    UNION ALL SELECT page_id, 'phone_e164', node ->> '$.telephone', NULL FROM nodes WHERE {ORG} AND node ->> '$.telephone' LIKE '+%'
    UNION ALL SELECT page_id, 'instagram', lower(regexp_extract(u, 'instagram[.]com/([^/?#]+)', 1)), NULL FROM
      (SELECT page_id, unnest(node ->> '$.sameAs[*]') AS u FROM nodes WHERE {ORG}) WHERE u LIKE '%instagram.com/%'
    UNION ALL SELECT page_id, 'linkedin', u, NULL FROM (SELECT page_id, unnest(node ->> '$.sameAs[*]') AS u FROM nodes WHERE {ORG}) WHERE u LIKE '%linkedin.com/%'
    UNION ALL SELECT page_id, 'address', a, NULL FROM (SELECT page_id, CASE WHEN json_type(node, '$.address') = 'VARCHAR' THEN node ->> '$.address'
      ELSE concat_ws(', ', node ->> '$.address.streetAddress', node ->> '$.address.addressLocality', node ->> '$.address.postalCode') END AS a
      FROM nodes WHERE {ORG}) WHERE a <> ''
    UNION ALL SELECT page_id, 'person', value, extra FROM ({LD_PEOPLE_SQL}) WHERE value IS NOT NULL"""
register(
    "json_ld",
    lambda v: hits(v, *web.LD_KINDS, source="json-ld").select("page_id", "kind", "value", "extra"),
    LD_SQL,
)


def entities_sql(x: str) -> str:
    for a, b in [("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&#163;", "'£'")]:
        x = f"replace({x}, '{a}', {b})"
    return x


OG_F = """<meta\\s+[^>]*property=["']og:([^"']+)["'][^>]*content=["']([^"']+)["'][^>]*>"""
OG_B = """<meta\\s+[^>]*content=["']([^"']+)["'][^>]*property=["']og:([^"']+)["'][^>]*>"""


def og_sql() -> str:
    def part(pattern, key, value, rank, sign):
        return f"""SELECT page_id, domain, page_ord, {rank} AS rank, {sign}p AS p, lower(regexp_extract(value, {q(pattern)}, {key}, 'i')) AS extra,
          regexp_extract(value, {q(pattern)}, {value}, 'i') AS value FROM ({found_sql(pattern, 0)})"""

    return f"""SELECT page_id, domain, page_ord, 'og' AS kind, value, extra FROM (SELECT *, row_number() OVER (PARTITION BY page_id, extra ORDER BY rank, p) AS n
      FROM ({part(OG_F, 1, 2, 0, '-')} UNION ALL {part(OG_B, 2, 1, 1, '')})) WHERE n = 1"""


def one_sql(kind: str, value: str) -> str:
    return f"SELECT page_id, domain, page_ord, '{kind}' AS kind, {value} AS value, NULL AS extra FROM {PAGES} WHERE {value} IS NOT NULL"


DESCRIPTION = entities_sql("""nullif(regexp_extract(html, '<meta\\s+[^>]*name=["'']description["''][^>]*content=["'']([^"'']+)["'']', 1, 'i'), '')""")
CANONICAL = """nullif(regexp_extract(html, '<link\\s+[^>]*rel=["'']canonical["''][^>]*href=["'']([^"'']+)["'']', 1, 'i'), '')"""
TITLE = entities_sql("nullif(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')), '')")
META_SQL = f"""{og_sql()} UNION ALL {one_sql('description', DESCRIPTION)} UNION ALL {one_sql('canonical', CANONICAL)}
  UNION ALL {one_sql('title', TITLE)}"""
register(
    "meta_tags",
    lambda v: hits(v, "og", "description", "canonical", "title").select("page_id", "kind", "value", "extra"),
    f"SELECT page_id, kind, value, extra FROM ({META_SQL})",
)
register(
    "postcodes",
    lambda v: hits(v, "address").select("page_id", "value", "pos"),
    f"SELECT page_id, value, pos FROM ({first_seen_sql(found_sql(rules.PAGE_POSTCODE_PATTERN, 0, flags='c'))}) WHERE pos < 5",
)
NAME = "([A-Z][a-zA-Z'\\-]+(?:\\s+[A-Z][a-zA-Z'\\-]+){1,2})"
VISIBLE_SQL = f"""SELECT page_id, domain, page_ord, {chain_sql('html', [('<[^>]+>', "' '", 'g'), ('[' + chr(92) + 's' + chr(92) + 'x{00A0}' + chr(92) + 'x{FEFF}]+', "' '", 'g')])} AS t FROM {PAGES}"""
PEOPLE_SQL = f"""SELECT page_id, domain, page_ord, value, extra, (row_number() OVER (PARTITION BY page_id ORDER BY o) - 1)::int AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, lower(value) ORDER BY o) AS n FROM (""" + " UNION ALL ".join(
    f"SELECT page_id, domain, page_ord, value, '{role}' AS extra, {i * 2 + j} * 1000000 + p AS o FROM ({found_sql(pattern, 1, 'visible', 't', 'c')})"
    for i, role in enumerate(rules.PEOPLE_ROLES)
    for j, pattern in enumerate([f"{NAME}\\s*[,\\-–—|:]+\\s*{role}", f"{role}[,\\s:\\-–—|]+{NAME}"])
) + ")) WHERE n = 1 QUALIFY pos < 8"
register(
    "people",
    lambda v: hits(v, "person").select("page_id", "value", F.col("extra").alias("role"), "pos"),
    f"WITH visible AS MATERIALIZED ({VISIBLE_SQL}) SELECT page_id, value, extra AS role, pos FROM ({PEOPLE_SQL})",
)
WEIGHTS = ", ".join(
    f"CASE WHEN regexp_matches(path, '{p}', 'i') THEN {w} END" for p, w in rules.SUBPAGE_WEIGHTS
)
LINKS_SQL = f"""SELECT domain, clean AS url, max(weight) AS weight, min(p) - 1 AS pos FROM (
    SELECT domain, p, origin || regexp_replace(path, '/$', '') AS clean, origin || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/$', '') AS home,
      greatest({WEIGHTS}) AS weight, path FROM (
    SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
      regexp_extract(CASE WHEN value LIKE '/%' THEN value ELSE regexp_extract(value, '^https?://[^/]+(.*)$', 1) END, '^([^?#]*)', 1) AS path
    FROM ({found_sql("href=[\"']([^\"']+)[\"']", keep="domain, page_ord, url")})
    WHERE page_ord = 0 AND (value LIKE '/%' OR regexp_extract(value, '^https?://([^/:?#]+)', 1) = domain)))
  WHERE NOT regexp_matches(path, '[.](pdf|jpg|jpeg|png|webp|gif|svg|mp4|mp3|zip|css|js)$', 'i') AND weight IS NOT NULL AND clean <> home GROUP BY domain, clean"""
register(
    "subpages",
    lambda v: web.subpages(v.site_pages_v, v.sitemaps_v).select("domain", "url", "weight", "place"),
    f"""WITH l AS ({LINKS_SQL}), m AS (SELECT domain, value AS url, 0 AS weight, row_number() OVER (PARTITION BY domain ORDER BY p) - 1 AS pos FROM
      ({found_sql('<loc>' + chr(92) + 's*([^<' + chr(92) + 's]+)' + chr(92) + 's*</loc>', source="@sitemaps_v@", c="xml", keep="domain")})
      WHERE regexp_matches(value, '\\b({"|".join(rules.SITEMAP_WORDS)})\\b', 'i')),
    a AS (SELECT * FROM l UNION ALL SELECT * FROM m WHERE domain NOT IN (SELECT domain FROM l GROUP BY domain HAVING count(*) >= 3))
    SELECT domain, url, weight, place FROM (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY weight DESC, pos, url))::int AS place FROM (
      SELECT domain, url, max(weight)::int AS weight, min(pos) AS pos FROM a GROUP BY domain, url))""",
)
register(
    "vrn_extract",
    lambda v: v.site_pages_v.select("page_id", markup.vat_number(F.col("html")).alias("vrn")),
    f"""SELECT page_id, coalesce(list_filter(list_transform(regexp_extract_all(html, '\\bVAT[^A-Za-z0-9]{{0,40}}((?:GB)?\\s*\\d[\\d\\s]{{7,14}}\\d)', 1, 'i'),
      lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda d: length(d) IN (9, 12))[1],
      regexp_extract_all(html, '\\bGB\\s*(\\d{{9}})\\b', 1)[1]) AS vrn FROM {PAGES}""",
)
# ---- by site -----------------------------------------------------------------

MERGE_KINDS = ["email", "phone", "og", "description", "canonical", "title"]
FIRST_SQL = f"""SELECT domain, kind, value, extra, page_ord::int AS page_ord FROM (SELECT *, row_number() OVER (PARTITION BY domain, kind,
    CASE WHEN kind IN ('description', 'canonical', 'title') THEN '' WHEN kind = 'og' THEN extra ELSE value END
    ORDER BY CASE WHEN kind = 'og' THEN -page_ord ELSE page_ord END, pos) AS n FROM hits) WHERE n = 1"""
register(
    "site_merge",
    lambda v: web.site_merge(hits(v, *MERGE_KINDS)).select("domain", "kind", "value", "extra", "page_ord"),
    f"""WITH hits AS (SELECT domain, 'email' AS kind, value, NULL AS extra, page_ord, pos FROM ({EMAIL_SQL})
      UNION ALL SELECT domain, 'phone', value, NULL, page_ord, pos FROM ({PHONE_SQL})
      UNION ALL SELECT domain, kind, value, extra, page_ord, 0 FROM ({META_SQL})) {FIRST_SQL}""",
)


def contacts(v):
    pages = v.site_pages_v
    merged = web.site_merge(web.page_hits(pages, ["email", "person"]))
    return web.site_contacts(merged, v.site_fill_v, web.ld_sites(v.site_pages_v))


CONTACTS_SQL = f"""WITH visible AS MATERIALIZED ({VISIBLE_SQL}), nodes AS MATERIALIZED ({NODES_SQL}),
  ld AS (SELECT domain FROM ({BLOCKS_SQL}) WHERE CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' OR json_array_length(value) > 0 END),
  em AS (SELECT domain, value, min((page_ord, pos)) AS o FROM (SELECT domain, page_ord, value, pos FROM ({EMAIL_SQL})
    UNION ALL SELECT domain, page_ord, lower(node ->> '$.email'), 1000000 + block * 1000 + nr FROM nodes WHERE {ORG} AND node ->> '$.email' IS NOT NULL) GROUP BY domain, value),
  pe AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, lower(value) ORDER BY page_ord, pos) AS n FROM (
    SELECT domain, page_ord, value, extra, pos, false AS ld FROM ({PEOPLE_SQL})
    UNION ALL SELECT domain, page_ord, value, extra, 1000000 + row_number() OVER (PARTITION BY page_id ORDER BY block, nr, part), true FROM ({LD_PEOPLE_SQL}) WHERE value IS NOT NULL)) WHERE n = 1),
  s AS (SELECT f.domain, f.owner_name, lower(f.email) AS pick, f.description,
    (SELECT arg_min(value, (page_ord, pos)) FROM pe WHERE pe.domain = f.domain AND ld AND regexp_matches(extra, 'founder|owner|ceo|director', 'i')) AS ld_owner,
    (SELECT arg_min(value, (page_ord, pos)) FROM pe WHERE pe.domain = f.domain AND regexp_matches(extra, 'founder|owner', 'i')) AS text_owner,
    EXISTS (SELECT 1 FROM em WHERE em.domain = f.domain AND em.value = lower(f.email)) AS real,
    EXISTS (SELECT 1 FROM em WHERE em.domain = f.domain) AS has_email, EXISTS (SELECT 1 FROM pe WHERE pe.domain = f.domain) AS has_people,
    EXISTS (SELECT 1 FROM ld WHERE ld.domain = f.domain) AS has_ld FROM @site_fill_v@ f)"""
register(
    "owner_pick",
    lambda v: contacts(v).select("domain", "owner_name"),
    CONTACTS_SQL + " SELECT domain, coalesce(owner_name, ld_owner, text_owner) AS owner_name FROM s",
)
register(
    "email_validate",
    lambda v: contacts(v).select("domain", "email", F.array_join("alternates", "|").alias("alternates")),
    CONTACTS_SQL
    + """ SELECT s.domain, CASE WHEN real THEN pick END AS email, coalesce((SELECT string_agg(value, '|' ORDER BY o) FROM (
      SELECT value, o FROM em WHERE em.domain = s.domain AND NOT (real AND value = pick) ORDER BY o LIMIT 4)), '') AS alternates FROM s""",
)
register(
    "contact_confidence",
    lambda v: contacts(v).select("domain", "confidence"),
    CONTACTS_SQL
    + """ SELECT domain, CASE WHEN n >= 3 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM (
      SELECT domain, (owner_name IS NOT NULL OR has_people)::int + has_email::int + (description IS NOT NULL)::int + has_ld::int AS n FROM s)""",
)
register(
    "page_assembly",
    lambda v: web.page_assembly(v.site_pages_v),
    f"""WITH t AS ({html_text_sql("@site_pages_v@", "domain, page_ord, url", "html")})
    SELECT domain, left(string_agg(CASE WHEN page_ord = 0 THEN '--- HOMEPAGE: ' ELSE '--- PAGE: ' END || url || ' ---' || chr(10) || text,
      chr(10) || chr(10) ORDER BY page_ord), 40000) AS text FROM t GROUP BY domain""",
)
# ---- checks --------------------------------------------------------------------

FINAL = "regexp_replace(regexp_extract(lower(final_url), '^https?://([^/:?#]+)', 1), '^www[.]', '')"
ASKED = "regexp_replace(regexp_extract(lower(url), '^https?://([^/:?#]+)', 1), '^www[.]', '')"
register(
    "website_valid",
    lambda v: v.site_pages_v.select(
        "page_id",
        markup.website_problem(F.col("url"), F.col("final_url"), F.col("status"), F.col("html")).alias("problem"),
    ),
    f"""SELECT page_id, CASE WHEN {ASKED} = '' THEN 'Invalid URL format: ' || url
    WHEN {ASKED} IN ({quoted(rules.SOCIAL_HOSTS)}) THEN 'Social media profile (' || {ASKED} || '), not a business website'
    WHEN len(list_filter([{quoted(rules.PARKED_DOMAINS)}], lambda p: contains({FINAL}, p))) > 0 THEN 'Redirected to parked domain: ' || {FINAL}
    WHEN {FINAL} IN ({quoted(rules.SOCIAL_HOSTS)}) THEN 'Redirected to social media: ' || {FINAL}
    WHEN status >= 400 THEN 'HTTP ' || status
    ELSE 'Parked domain indicator: "' || list_filter([{quoted(rules.PARKED_PHRASES)}], lambda p: contains(lower(html), p))[1] || '"' END AS problem FROM {PAGES}""",
)
register(
    "blocker_page",
    lambda v: v.site_pages_v.select("page_id", markup.is_blocker_page(F.col("html")).alias("blocked")),
    f"""SELECT page_id, length(html) < 500 OR lower(html) LIKE '%cf-error-details%' OR (html ILIKE '%cloudflare%' AND html ILIKE '%challenge%')
    OR (length(html) < 3000 AND (html ILIKE '%access denied%' OR html ILIKE '%just a moment%')) AS blocked FROM {PAGES}""",
)
register(
    "robots_allow",
    lambda v: v.robots_v.select("origin_id", markup.robots_allow(F.col("body")).alias("allowed")),
    """WITH l AS (SELECT origin_id, trim(unnest(ls), ' ' || chr(13)) AS line, generate_subscripts(ls, 1) AS p FROM
      (SELECT origin_id, string_split(body, chr(10)) AS ls FROM @robots_v@)),
    k AS (SELECT *, lower(trim(split_part(line, ':', 1))) AS k, trim(split_part(line, ':', 2)) AS val FROM l
      WHERE line NOT LIKE '#%' AND split_part(line, ':', 2) <> ''),
    a AS (SELECT *, last_value(CASE WHEN k = 'user-agent' THEN val END IGNORE NULLS) OVER (PARTITION BY origin_id ORDER BY p) AS agent FROM k)
    SELECT r.origin_id, NOT EXISTS (SELECT 1 FROM a WHERE a.origin_id = r.origin_id AND agent = '*' AND k = 'disallow' AND val IN ('/', '/*')) AS allowed
    FROM @robots_v@ r""",
)
