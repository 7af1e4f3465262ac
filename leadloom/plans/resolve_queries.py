"""Entity resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import resolve
from leadloom.plans.key_queries import company_no_sql, domain_sql, email_sql, name_sql, phone_sql
from leadloom.plans.registry import register

KEYED_SQL = f"""SELECT id, created_at, place_id AS place_key, {company_no_sql('company_number')} AS company_key,
  {email_sql('email')} AS email_key, {domain_sql('website_url')} AS domain_key, {phone_sql('phone')} AS phone_key,
  nullif({name_sql('business_name')}, '') AS name_key, outward_postcode AS postcode, city FROM @leads_v@"""


def layer_sql(column: str) -> str:
    return f"""WITH k AS ({KEYED_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY {column} ORDER BY created_at, id) AS n
      FROM k WHERE {column} IS NOT NULL)
    SELECT a.id, b.id AS matched_id FROM r a JOIN r b ON a.{column} = b.{column}
      AND b.n = CASE WHEN a.n = 1 THEN 2 ELSE 1 END"""


for op, layer, column in [
    ("dup_place_id", "place_id", "place_key"),
    ("dup_company_no", "companies_house_number", "company_key"),
    ("dup_email", "email", "email_key"),
    ("dup_domain", "domain", "domain_key"),
    ("dup_phone", "phone", "phone_key"),
    ("dup_exact_name", "exact_name", "name_key"),
]:
    register(op, lambda v, layer=layer: resolve.dup_layer(v.leads_v, layer), layer_sql(column))

# every pair of distinct names, compared in full
NAMES_SQL = f"""k AS MATERIALIZED ({KEYED_SQL}),
  g AS MATERIALIZED (SELECT name_key, list_distinct(flatten(list_transform(list_filter(string_split_regex(name_key, '[^a-z0-9]+'), lambda w: w <> ''),
    lambda w: list_transform(range(1, length(w) + 2), lambda i: ('  ' || w || ' ')[i:i+2])))) AS grams
    FROM (SELECT DISTINCT name_key FROM k WHERE name_key IS NOT NULL)),
  s AS MATERIALIZED (SELECT a.name_key AS a, b.name_key AS b, len(list_intersect(a.grams, b.grams)) AS shared,
    len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams)) AS total
    FROM g a JOIN g b ON 10 * len(a.grams) >= 7 * len(b.grams) AND 10 * len(b.grams) >= 7 * len(a.grams)
    WHERE 10 * len(list_intersect(a.grams, b.grams)) >= 7 * (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))))"""
POSTCODE_SCOPE = "x.postcode = y.postcode AND length(x.name_key) >= 3"
CITY_SCOPE = "(x.city IS NULL OR x.city = y.city) AND length(x.name_key) >= 4"


def best_sql(scope: str) -> str:
    return f"""WITH {NAMES_SQL}, m AS (SELECT x.id, y.id AS matched_id, shared::double / total AS similarity, y.created_at
      FROM k x JOIN s ON s.a = x.name_key JOIN k y ON y.name_key = s.b AND y.id <> x.id AND {scope})
    SELECT id, matched_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id
      ORDER BY similarity DESC, created_at, matched_id) AS n FROM m) WHERE n = 1"""


for op, layer, scope in [
    ("dup_name_postcode", "name_postcode", POSTCODE_SCOPE),
    ("dup_fuzzy", "fuzzy_trigram", CITY_SCOPE),
]:
    register(
        op,
        lambda v, layer=layer: resolve.dup_names(v.leads_v, layer).withColumn(
            "similarity", F.round("similarity", 6)
        ),
        best_sql(scope),
    )

EXACT = ["place", "company", "email", "domain", "phone", "name"]


def edges_sql(condition: str) -> str:
    parts = [
        f"SELECT x.id, y.id AS other, y.created_at, {i} AS layer, 1.0::double AS similarity FROM k x JOIN k y "
        f"ON x.{c}_key = y.{c}_key AND y.id <> x.id {condition}"
        + (" WHERE length(x.name_key) >= 2" if c == "name" else "")
        for i, c in enumerate(EXACT)
    ]
    parts += [
        f"SELECT x.id, y.id, y.created_at, {i}, shared::double / total FROM k x JOIN s ON s.a = x.name_key "
        f"JOIN k y ON y.name_key = s.b AND y.id <> x.id {condition} AND {scope}"
        for i, scope in [(6, POSTCODE_SCOPE), (7, CITY_SCOPE)]
    ]
    return " UNION ALL ".join(parts)


LAYER_CASE = "CASE layer " + " ".join(
    f"WHEN {i} THEN '{n}'" for i, n in enumerate(resolve.LAYER_NAMES)
) + " END"
register(
    "dedup_check",
    lambda v: resolve.dedup_check(v.leads_v).withColumn("similarity", F.round("similarity", 6)),
    f"""WITH {NAMES_SQL}, e AS ({edges_sql('')})
    SELECT id, other AS matched_id, {LAYER_CASE} AS match_type, round(similarity, 6) AS similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY layer, similarity DESC, created_at, other) AS n FROM e) WHERE n = 1""",
)
# inserted one lead at a time, in the order of creation
register(
    "dedup_resolve",
    lambda v: resolve.dedup_resolve(v.leads_v).withColumn("similarity", F.round("similarity", 6)),
    f"""WITH RECURSIVE {NAMES_SQL},
    e AS MATERIALIZED ({edges_sql('AND (y.created_at, y.id) < (x.created_at, x.id)')}),
    o AS MATERIALIZED (SELECT k.id, row_number() OVER (ORDER BY created_at, k.id) AS n, coalesce(before, []) AS before
      FROM k LEFT JOIN (SELECT id, list(DISTINCT other) AS before FROM e GROUP BY id) b ON b.id = k.id),
    walk AS (SELECT 0::bigint AS n, []::varchar[] AS kept UNION ALL
      SELECT o.n, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, o.id) END
      FROM walk JOIN o ON o.n = walk.n + 1),
    final AS (SELECT unnest(kept) AS id FROM walk WHERE n = (SELECT max(n) FROM walk))
    SELECT k.id, f.id IS NOT NULL AS kept, m.other AS matched_id, m.match_type, round(m.similarity, 6) AS similarity FROM k
    LEFT JOIN final f ON f.id = k.id LEFT JOIN (SELECT e.id, other, {LAYER_CASE} AS match_type, similarity,
      row_number() OVER (PARTITION BY e.id ORDER BY layer, similarity DESC, created_at, other) AS n
      FROM e JOIN final ON final.id = e.other) m ON m.id = k.id AND m.n = 1 AND f.id IS NULL""",
)
register(
    "new_vs_known",
    lambda v: resolve.new_vs_known(
        v.leads_v.where("status = 'new_lead'"), v.leads_v.where("status <> 'new_lead'")
    ).select("id"),
    f"""WITH {NAMES_SQL}, st AS (SELECT id, status FROM @leads_v@), e AS ({edges_sql('')})
    SELECT id FROM st WHERE status = 'new_lead' AND id NOT IN (SELECT e.id FROM e JOIN st ON st.id = e.other
      WHERE st.status <> 'new_lead')""",
)
