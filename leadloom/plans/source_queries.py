"""Source queries: register search, payloads, places, accounts, caches, scan plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.operators import accounts, tables
from leadloom.plans.register_queries import quoted
from leadloom.plans.registry import ORACLES, register
from leadloom.sources import ingest, schemas
from leadloom.sources.views import EVENTS_AS_OF

register(
    "register_search",
    lambda v: ingest.register_search(
        v.companies_v, ["62012", "70229"], incorporated_to="1995-01-01", company_type="ltd"
    ).select("company_number", "company_name", "locality"),
    """SELECT company_number, company_name, locality FROM @companies_v@ WHERE company_status = 'active' AND company_type = 'ltd'
    AND date_of_creation <= DATE '1995-01-01' AND list_has_any(string_split(sic_csv, ','), ['62012', '70229'])""",
)


def detail(v):
    p = v.payloads_v
    parts = [
        ("officers", "name", "appointed_on", F.col("date_of_birth.year").cast("string")),
        ("filing-history", "category", "date", F.col("links.document_metadata")),
        ("charges", "status", "created_on", F.lit(None).cast("string")),
        ("persons-with-significant-control", "name", "ceased_on", F.col("kind")),
    ]
    return tables.source_union(
        *(
            ingest.register_detail(p, r).select(
                F.lit(r).alias("resource"), "company_number", F.col(label).alias("label"),
                F.col(day).cast("string").alias("day"), more.alias("more"),
            )
            for r, label, day, more in parts
        )
    )


register(
    "register_detail",
    detail,
    """SELECT 'officers' AS resource, company_number, name AS label, appointed_on::varchar AS day, dob_year::varchar AS more FROM @officers_v@
    UNION ALL SELECT 'filing-history', company_number, category, filing_date::varchar, document_link FROM @filings_v@
    UNION ALL SELECT 'charges', company_number, status, created_on::varchar, NULL FROM @charges_v@
    UNION ALL SELECT 'persons-with-significant-control', company_number, name, ceased_on::varchar, kind FROM @psc_v@""",
)
register(
    "register_profiles",
    lambda v: ingest.profile_rows(v.profiles_v),
    f"SELECT {', '.join(field.split()[0] for field in schemas.COMPANIES.split(','))} FROM @companies_v@",
)
PLACES_SQL = f"""WITH p AS (SELECT scan_id, payload_ord, generate_subscripts(ps, 1) AS pos, unnest(ps) AS p FROM
    (SELECT *, payload -> '$.places[*]' AS ps FROM @places_v@)),
  r AS (SELECT scan_id, payload_ord, pos, p ->> '$.id' AS place_id,
    CASE WHEN json_type(p, '$.displayName') = 'OBJECT' THEN p ->> '$.displayName.text' ELSE p ->> '$.displayName' END AS business_name,
    list_filter(json_extract(p, '$.addressComponents[*]'), lambda c: contains(json_extract(c, '$.types')::varchar, '"locality"'))[1] ->> '$.longText' AS city,
    list_filter(json_extract(p, '$.addressComponents[*]'), lambda c: contains(json_extract(c, '$.types')::varchar, '"country"'))[1] ->> '$.longText' AS country,
    upper(split_part(list_filter(json_extract(p, '$.addressComponents[*]'), lambda c: contains(json_extract(c, '$.types')::varchar, '"postal_code"'))[1] ->> '$.shortText', ' ', 1)) AS outward_postcode,
    p ->> '$.formattedAddress' AS address, p ->> '$.websiteUri' AS website_url,
    coalesce(p ->> '$.internationalPhoneNumber', p ->> '$.nationalPhoneNumber') AS phone, (p ->> '$.rating')::double AS rating
    FROM p WHERE coalesce(p ->> '$.businessStatus', 'OPERATIONAL') = 'OPERATIONAL'
      AND coalesce(p ->> '$.primaryType', '') NOT IN ({quoted(rules.BLOCKED_PLACE_TYPES)}))
  SELECT scan_id, place_id, business_name, city, country, address, outward_postcode, website_url, phone, rating FROM (
    SELECT *, row_number() OVER (PARTITION BY scan_id, place_id ORDER BY payload_ord, pos) AS n FROM r
    WHERE place_id IS NOT NULL AND trim(business_name) <> '') WHERE n = 1"""
register("places_flatten", lambda v: ingest.places_rows(v.places_v), PLACES_SQL)

# ---- accounts -------------------------------------------------------------------

DOCS_SQL = """SELECT d.*, place FROM @accounts_docs_v@ d JOIN (SELECT *, row_number() OVER (PARTITION BY company_number
    ORDER BY filing_date DESC NULLS LAST, filing_id DESC) AS place FROM @filings_v@ WHERE category = 'accounts' AND document_link IS NOT NULL) f
    ON d.document_id = regexp_extract(document_link, '/document/([^/?#]+)', 1) WHERE place <= 2 AND content_type NOT LIKE '%pdf%'"""
register(
    "accounts_docs",
    lambda v: accounts.accounts_to_read(v.filings_v, v.accounts_docs_v).select("document_id", "company_number", "place"),
    f"SELECT document_id, company_number, place::int AS place FROM ({DOCS_SQL})",
)
NAMES = {m: quoted(t) for m, t in rules.ACCOUNTS_TAGS.items()}
PARSED_SQL = f"""d AS MATERIALIZED (SELECT company_number, filing_date, document_id, html FROM @accounts_docs_v@),
  f AS MATERIALIZED (SELECT document_id, p, split_part(regexp_extract(a, 'name="([^"]*)"', 1), ':', -1) AS name,
      nullif(regexp_extract(a, 'contextRef="([^"]*)"', 1), '') AS ctx,
      CASE WHEN a LIKE '%sign="-"%' THEN -1 ELSE 1 END * CASE WHEN t LIKE '(%)' THEN -1 ELSE 1 END
      * try_cast(regexp_replace(t, '[(),£$\\s]', '', 'g') AS double) * pow(10, coalesce(try_cast(regexp_extract(a, 'scale="([^"]*)"', 1) AS int), 0)) AS v
    FROM (SELECT document_id, p, regexp_extract(m, '<ix:nonFraction([^>]*)>', 1) AS a, trim(regexp_replace(m, '<[^>]+>', '', 'g')) AS t FROM (
      SELECT document_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS p FROM (SELECT document_id,
        regexp_extract_all(html, '<ix:nonFraction.*?</ix:nonFraction>', 0, 's') AS ms FROM d WHERE length(html) >= 1000)))),
  c AS MATERIALIZED (SELECT document_id, regexp_extract(m, 'id="([^"]+)"', 1) AS id,
      regexp_extract(m, '<xbrli:(?:endDate|instant)>([^<]+)<', 1)::date AS ends FROM (
      SELECT document_id, unnest(regexp_extract_all(html, '<xbrli:context.*?</xbrli:context>', 0, 's')) AS m FROM d WHERE length(html) >= 1000)),
  e AS MATERIALIZED (SELECT document_id, max(ends) AS made_up_to FROM c GROUP BY document_id),
  b AS MATERIALIZED (SELECT document_id, id, CASE WHEN made_up_to - ends <= 90 THEN 'current' WHEN abs(made_up_to - 365 - ends) <= 180 THEN 'prior' END AS period
    FROM c JOIN e USING (document_id)),
  g AS MATERIALIZED (SELECT document_id, period, metric, arg_min(floor(v + 0.5)::bigint, p) AS value FROM (
      SELECT f.*, pd.period, CASE {' '.join(f"WHEN name IN ({t}) THEN '{m}'" for m, t in NAMES.items())} END AS metric
      FROM f JOIN (SELECT DISTINCT document_id, period FROM b WHERE period IS NOT NULL
        UNION SELECT document_id, 'current' FROM d WHERE document_id NOT IN (SELECT document_id FROM c)) pd USING (document_id)
      WHERE v IS NOT NULL AND (ctx IS NULL OR document_id NOT IN (SELECT document_id FROM c)
        OR EXISTS (SELECT 1 FROM b WHERE b.document_id = f.document_id AND b.id = f.ctx AND b.period = pd.period)))
    WHERE metric IS NOT NULL AND (metric <> 'employees' OR floor(v + 0.5) >= 0) GROUP BY 1, 2, 3),
  w AS MATERIALIZED (SELECT document_id, """ + ", ".join(
    f"max(value) FILTER (metric = '{m}' AND period = '{p}') AS {x}{m}"
    for m in rules.ACCOUNTS_TAGS for p, x in [("current", ""), ("prior", "prior_")]
) + """ FROM g GROUP BY document_id),
  r AS MATERIALIZED (SELECT company_number, filing_date, document_id, made_up_to, turnover, prior_turnover, employees::int AS employees,
    prior_employees::int AS prior_employees, profit, prior_profit, turnover IS NOT NULL OR employees IS NOT NULL AS has_financials,
    CASE WHEN length(html) < 1000 THEN 'empty-document' WHEN document_id NOT IN (SELECT document_id FROM f) THEN 'no-ixbrl-tags'
      WHEN made_up_to IS NULL AND coalesce(turnover, 0) = 0 AND coalesce(employees, 0) = 0 THEN 'no-matching-tags' END AS reason
    FROM d LEFT JOIN e USING (document_id) LEFT JOIN w USING (document_id))"""
FIGURES = ["turnover", "prior_turnover", "employees", "prior_employees", "profit", "prior_profit"]


def day(c: str):
    return F.col(c).cast("string").alias(c)


register(
    "accounts_parse",
    lambda v: accounts.parse_accounts(v.accounts_docs_v).select(
        "document_id", day("made_up_to"), *FIGURES, "has_financials", "reason"
    ),
    f"WITH {PARSED_SQL} SELECT document_id, made_up_to::varchar AS made_up_to, {', '.join(FIGURES)}, has_financials, reason FROM r",
)
register(
    "accounts_facts",
    lambda v: accounts.accounts_facts(v.accounts_docs_v).drop("company_number"),
    f"WITH {PARSED_SQL} SELECT document_id, metric, period, value FROM g",
)
register(
    "accounts_latest",
    lambda v: accounts.latest_accounts(v.filings_v, v.accounts_docs_v).select(
        "company_number", "document_id", *FIGURES
    ),
    f"""WITH {PARSED_SQL}, n AS (SELECT document_id, place FROM ({DOCS_SQL}))
    SELECT company_number, document_id, {', '.join(FIGURES)} FROM (SELECT r.*, row_number() OVER (PARTITION BY company_number ORDER BY place) AS k
      FROM r JOIN n USING (document_id) WHERE has_financials) WHERE k = 1""",
)

# ---- leads, responses, caches, plans ----------------------------------------------


def ingest_report(v):
    created, skipped = ingest.manual_leads(v.leads_v)
    return created.select(
        "id", F.lit("created").alias("reason"), F.lit(None).cast("string").alias("matched_id")
    ).unionByName(skipped)


register("manual_ingest", ingest_report)
ORACLES["manual_ingest"] = (
    "SELECT id, CASE WHEN kept THEN 'created' ELSE 'duplicate_' || match_type END AS reason, matched_id FROM ("
    + ORACLES["dedup_resolve"]
    + ")"
)
register(
    "salvage_json_rows",
    lambda v: ingest.salvage_json_rows(v.responses_v).select(
        "response_id", "whole", "place", "business_name", "city", "website", "ownerName", "source"
    ),
    """WITH r AS (SELECT response_id, regexp_replace(regexp_replace(raw, '^```(json)?\\n?', ''), '\\n?```$', '') AS t, raw FROM @responses_v@),
    w AS (SELECT response_id, t LIKE '[%' AND json_valid(t) AS whole, substr(t, strpos(t, '[')) AS a FROM r),
    -- every response has three objects; the last of a broken one is cut off
    o AS (SELECT response_id, whole, unnest([1, 2, 3]) AS pos, CASE WHEN whole OR a LIKE '%"}]' THEN a ELSE regexp_extract(a, '^(.*),[{]', 1) || ']' END AS a FROM w),
    i AS (SELECT response_id, whole, pos, a -> ('$[' || (pos - 1) || ']') AS o FROM o)
    SELECT response_id, whole, (row_number() OVER (PARTITION BY response_id ORDER BY pos))::int AS place, o ->> '$.businessName' AS business_name,
      CASE WHEN json_type(o, '$.city') = 'VARCHAR' THEN o ->> '$.city' END AS city, o ->> '$.website' AS website, o ->> '$.ownerName' AS "ownerName",
      coalesce(o ->> '$.source', 'Google Search') AS source FROM i WHERE json_type(o, '$.businessName') = 'VARCHAR'""",
)
register(
    "refresh_due",
    lambda v: tables.refresh_due(
        v.site_pages_v.select("domain").distinct(),
        v.scrape_cache_v.withColumn(
            "expires_at", tables.expires_at("fetched_at", tables.scrape_lifetime(168))
        ),
        "domain",
        EVENTS_AS_OF,
    ),
    f"""SELECT DISTINCT domain FROM @site_pages_v@ WHERE domain NOT IN (SELECT domain FROM @scrape_cache_v@
    WHERE fetched_at + CASE WHEN email IS NULL AND confidence = 'low' THEN INTERVAL 24 HOUR ELSE INTERVAL 168 HOUR END >= TIMESTAMP '{EVENTS_AS_OF}')""",
)
register(
    "scan_plan",
    lambda v: ingest.scan_plan(v.regions_v, ["cafe", "law firm"], seed=7),
    """SELECT region, lat, lng, radius_m, printf('%.2f°%s, %.2f°%s (%.0fkm)', abs(lat), CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END,
      abs(lng), CASE WHEN lng >= 0 THEN 'E' ELSE 'W' END, radius_m / 1000.0) AS label, query FROM (
    SELECT region, try_cast(split_part(region, ',', 1) AS double) AS lat, try_cast(split_part(region, ',', 2) AS double) AS lng,
      try_cast(split_part(region, ',', 3) AS int) AS radius_m FROM @regions_v@ WHERE split_part(region, ',', 4) = ''),
    (SELECT unnest(['cafe', 'law firm']) AS query) WHERE lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND radius_m BETWEEN 100 AND 50000""",
)
register(
    "source_union",
    lambda v: tables.source_union(
        v.companies_v.select(
            F.lit("companies_house").alias("source"), "company_number", F.col("company_name").alias("business_name"),
            F.col("locality").alias("city"),
        ),
        ingest.places_rows(v.places_v).select(
            F.lit("google_places").alias("source"), "place_id", "business_name", "city", "website_url"
        ),
        v.leads_v.select(F.lit("manual").alias("source"), "business_name", "city", "website_url"),
    ),
    f"""SELECT 'companies_house' AS source, company_number, company_name AS business_name, locality AS city, NULL::varchar AS place_id, NULL::varchar AS website_url FROM @companies_v@
    UNION ALL SELECT 'google_places', NULL, business_name, city, place_id, website_url FROM ({PLACES_SQL})
    UNION ALL SELECT 'manual', NULL, business_name, city, NULL, website_url FROM @leads_v@""",
)
