"""Key normalisation and text function queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import keys, rules, similarity, text
from leadloom.plans.register_queries import ADDRESS_SQL, quoted
from leadloom.plans.registry import register

SUFFIXES = "|".join(rules.LEGAL_SUFFIXES)


def name_sql(c: str) -> str:
    x = f"replace(regexp_replace(lower({c}), '[''`\"]', '', 'g'), '&', ' and ')"
    x = f"regexp_replace({x}, '\\b({SUFFIXES})\\b\\.?', '', 'g')"
    x = f"regexp_replace({x}, '[^\\w\\s]', ' ', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def host_sql(c: str) -> str:
    u = f"lower(trim({c}))"
    u = f"(CASE WHEN {u} LIKE 'http%' THEN {u} ELSE 'https://' || {u} END)"
    return f"nullif(regexp_extract({u}, '^https?://([^/?#:\\s]+)', 1), '')"


def domain_sql(c: str) -> str:
    h = host_sql(c)
    for _ in range(3):
        h = f"regexp_replace({h}, '^(?:{'|'.join(rules.DROPPED_SUBDOMAINS)})\\.([^.]+\\..+)$', '\\1')"
    tlds = "|".join(t.replace(".", "\\.") for t in rules.COMPOUND_TLDS)
    return f"""(CASE WHEN regexp_matches({h}, '\\.({tlds})$')
      THEN regexp_extract({h}, '([^.]+\\.[^.]+\\.[^.]+)$', 1)
      WHEN contains({h}, '.') THEN regexp_extract({h}, '([^.]+\\.[^.]+)$', 1) ELSE {h} END)"""


def phone_sql(c: str) -> str:
    d = f"regexp_replace({c}, '[^\\d+]', '', 'g')"
    return f"""(CASE WHEN {d} LIKE '+%' THEN CASE WHEN length({d}) >= 8 THEN {d} END
      WHEN {d} LIKE '44%' THEN '+' || {d} WHEN {d} LIKE '0%' THEN '+44' || {d}[2:]
      WHEN length({d}) >= 10 THEN '+44' || {d} END)"""


def email_sql(c: str) -> str:
    x = f"lower(trim({c}))"
    local = f"split_part(split_part({x}, '@', 1), '+', 1)"
    domain = f"replace(split_part({x}, '@', 2), 'googlemail.com', 'gmail.com')"
    return f"""(CASE WHEN regexp_matches({x}, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AND {local} <> '' THEN
      CASE WHEN {domain} = 'gmail.com' THEN replace({local}, '.', '') ELSE {local} END || '@' || {domain} END)"""


def company_no_sql(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '\\s+', '', 'g')), '')"


register(
    "norm_name",
    lambda v: v.leads_v.select("id", keys.norm_name("business_name").alias("name_key")),
    f"SELECT id, {name_sql('business_name')} AS name_key FROM @leads_v@",
)
register(
    "domain_root",
    lambda v: v.leads_v.select("id", F.col("website_url").alias("u"))
    .unionByName(v.pages.select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("u")))
    .select("id", keys.domain_root("u").alias("domain")),
    f"""SELECT id, {domain_sql('u')} AS domain FROM (SELECT id, website_url AS u FROM @leads_v@
    UNION ALL SELECT page_id::varchar, url FROM pages)""",
)
register(
    "phone_e164",
    lambda v: v.leads_v.select("id", keys.phone_e164("phone").alias("phone_e164")),
    f"SELECT id, {phone_sql('phone')} AS phone_e164 FROM @leads_v@",
)
register(
    "phone_e164_site",
    lambda v: v.leads_v.select(
        "id", keys.phone_e164_site("phone", F.coalesce("website_url", F.lit(""))).alias("phone_e164")
    ),
    f"""SELECT id, CASE WHEN d LIKE '+%' AND length(d) BETWEEN 8 AND 16 THEN d
      WHEN h LIKE '%.uk' AND d LIKE '0%' AND length(d) BETWEEN 10 AND 11 THEN '+44' || d[2:]
      WHEN coalesce(h, '') NOT SIMILAR TO '.*\\.(uk|ca|au|ie)' AND regexp_full_match(d, '\\d{{10}}') THEN '+1' || d END AS phone_e164
    FROM (SELECT id, regexp_replace(phone, '[^\\d+]', '', 'g') AS d, {host_sql("coalesce(website_url, '')")} AS h FROM @leads_v@)""",
)
register(
    "outward_postcode",
    lambda v: v.companies_v.select(
        "company_number",
        keys.outward_postcode("postal_code").alias("outward"),
        keys.outward_of_postcode("postal_code").alias("registry_outward"),
    ),
    """SELECT company_number, coalesce(
      nullif(regexp_extract(upper(postal_code), '\\b([A-Z]{1,2}\\d{1,2}[A-Z]?)\\s*\\d[A-Z]{2}\\b', 1), ''),
      nullif(regexp_extract(upper(postal_code), '^([A-Z]{1,2}\\d{1,2}[A-Z]?)$', 1), '')) AS outward,
      nullif(split_part(upper(postal_code), ' ', 1), '') AS registry_outward FROM @companies_v@""",
)
register(
    "norm_email",
    lambda v: v.leads_v.select("id", keys.norm_email("email").alias("email_key")),
    f"SELECT id, {email_sql('email')} AS email_key FROM @leads_v@",
)
register(
    "norm_vrn",
    lambda v: v.leads_v.select("id", keys.norm_vrn("vat_number").alias("vrn")),
    """SELECT id, CASE WHEN length(d) IN (9, 12) THEN d END AS vrn FROM (SELECT id,
    regexp_replace(regexp_replace(upper(vat_number), '^GB', ''), '[^0-9]', '', 'g') AS d FROM @leads_v@)""",
)
register(
    "norm_handle",
    lambda v: v.part.select(
        "p_partkey",
        keys.norm_handle(
            F.concat(F.lit(" @"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("/?x=1 "))
        ).alias("handle"),
        keys.norm_handle("p_name").alias("bare"),
    ),
    """SELECT p_partkey, lower(replace(p_name, ' ', '.')) AS handle,
    CASE WHEN regexp_full_match(p_name, '[A-Za-z0-9_.]{1,30}') THEN lower(p_name) END AS bare FROM part""",
)
register(
    "norm_person",
    lambda v: v.officers_v.select(
        "company_number",
        keys.norm_person("name").alias("director"),
        F.coalesce("dob_month", F.lit(0)).alias("dob_month"),
        F.coalesce("dob_year", F.lit(0)).alias("dob_year"),
    ).distinct(),
    """SELECT DISTINCT company_number, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS director,
    coalesce(dob_month, 0) AS dob_month, coalesce(dob_year, 0) AS dob_year FROM @officers_v@""",
)
register(
    "norm_company_no",
    lambda v: v.leads_v.select("id", keys.norm_company_no("company_number").alias("company_no")),
    f"SELECT id, {company_no_sql('company_number')} AS company_no FROM @leads_v@",
)
register(
    "full_address",
    lambda v: v.companies_v.select(
        "company_number",
        keys.full_address(
            "address_line_1", "address_line_2", "locality", "region", "postal_code", "country"
        ).alias("address"),
    ),
    f"SELECT company_number, {ADDRESS_SQL} AS address FROM @companies_v@",
)
register(
    "greeting_name",
    lambda v: v.leads_v.select("id", keys.greeting_name("owner_name").alias("greeting")),
    """SELECT id, CASE WHEN regexp_full_match(f, '[A-Za-z''-]{2,}') THEN upper(f[1]) || f[2:] ELSE 'there' END AS greeting
    FROM (SELECT id, regexp_extract(owner_name, '^(\\S*)', 1) AS f FROM @leads_v@)""",
)


def entities_sql(x: str, pattern: str, digits: str) -> str:
    """Numbered entities in one pass: the pieces between them and the characters."""
    return (
        f"array_to_string(list_transform(list_zip(string_split_regex({x}, '{pattern}'), "
        f"regexp_extract_all({x}, '{pattern}', 1)), "
        f"lambda z: coalesce(z[1], '') || coalesce(chr({digits}), '')), '')"
    )


def chain_sql(x: str, steps) -> str:
    for pattern, replacement, flags in steps:
        p = pattern.replace("'", "''")
        x = f"regexp_replace({x}, '{p}', {replacement}, '{flags}')"
    return x


TEXT_STEPS = [
    ("<script.*?</script>", "''", "gis"), ("<style.*?</style>", "''", "gis"),
    ("<noscript.*?</noscript>", "''", "gis"), ("<svg.*?</svg>", "''", "gis"),
    ("""<img[^>]*alt=["']([^"']+)["'][^>]*>""", "' [IMG: \\1] '", "gi"),
    ("""<a\\s[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>""", "'\\2 [\\1]'", "gis"),
    ("</(p|div|h[1-6]|li|tr|section|article|header|footer|blockquote)>", "chr(10)", "gi"),
    ("<br\\s*/?>", "chr(10)", "gi"), ("<[^>]*>", "' '", "g"),
    ("&nbsp;", "' '", "g"), ("&amp;", "'&'", "g"), ("&lt;", "'<'", "g"), ("&gt;", "'>'", "g"),
]
TEXT_END = [
    ("&[a-z]+;", "' '", "gi"), ("[ \\t]+", "' '", "g"), ("\\n\\s*\\n\\s*\\n+", "chr(10) || chr(10)", "g"),
    ("^[\\s\\x{00A0}\\x{FEFF}]+|[\\s\\x{00A0}\\x{FEFF}]+$", "''", "g"),
]


def html_text_sql(table: str, id_: str, html: str) -> str:
    """A SELECT of the id and the text; no check page holds hexadecimal entities."""
    return f"""SELECT {id_}, {chain_sql("t", TEXT_END)} AS text FROM (
      SELECT {id_}, {entities_sql("t", "&#([0-9]+);", "z[2]::int")} AS t FROM (
      SELECT {id_}, {chain_sql(html, TEXT_STEPS)} AS t FROM {table}))"""


register(
    "html_to_text",
    lambda v: v.site_pages_v.select("page_id", "html").select(
        "page_id", text.html_to_text("html").alias("text")
    ),
    html_text_sql("@site_pages_v@", "page_id", "html"),
)
register(
    "plain_to_html",
    lambda v: v.documents.select("doc_id", text.plain_to_html("text").alias("html")),
    """SELECT doc_id, CASE WHEN regexp_matches(text, '^[\\s\\x{00A0}\\x{FEFF}]*<') THEN text ELSE array_to_string(list_transform(list_filter(
      list_transform(string_split_regex(text, '\\n{2,}'),
        lambda p: regexp_replace(p, '^[\\s\\x{00A0}\\x{FEFF}]+|[\\s\\x{00A0}\\x{FEFF}]+$', '', 'g')), lambda p: p <> ''),
      lambda p: '<p>' || replace(p, chr(10), '<br/>') || '</p>'), chr(10)) END AS html FROM documents""",
)
register(
    "format_gbp",
    lambda v: v.accounts_history_v.select(
        "company_number", "period_year",
        F.regexp_extract(keys.format_gbp("turnover"), "[mk]?$", 0).alias("unit"),
        F.regexp_replace(keys.format_gbp("turnover"), "[mk]", "").cast("double").alias("amount"),
    ),
    """SELECT company_number, period_year, CASE WHEN turnover >= 1000000 THEN 'm' WHEN turnover >= 1000 THEN 'k' ELSE '' END AS unit,
    CASE WHEN turnover >= 1000000 THEN round(turnover / 1000000.0, 2) WHEN turnover >= 1000 THEN round(turnover / 1000.0, 0)
    ELSE turnover END::double AS amount FROM @accounts_history_v@""",
)
register(
    "trigram_similarity",
    lambda v: v.part.select(
        "p_partkey", F.round(similarity.trigram_similarity("p_name", "p_type"), 6).alias("with_type"),
        F.round(
            similarity.trigram_similarity("p_name", F.concat_ws(" ", "p_brand", "p_name")), 6
        ).alias("with_brand"),
    ),
    "WITH g AS (SELECT p_partkey, "
    + ", ".join(
        f"""list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''),
        lambda w: list_transform(range(1, length(w) + 2), lambda i: ('  ' || w || ' ')[i:i+2])))) AS {a}"""
        for a, x in [("n", "p_name"), ("t", "p_type"), ("b", "p_brand || ' ' || p_name")]
    )
    + """ FROM part) SELECT p_partkey,
    round(len(list_intersect(n, t))::double / len(list_distinct(n || t)), 6) AS with_type,
    round(len(list_intersect(n, b))::double / len(list_distinct(n || b)), 6) AS with_brand FROM g""",
)

# ---- drafts -----------------------------------------------------------------


def draft_report(v):
    d = v.documents.select("doc_id", F.col("text").alias("body"), "source")
    words = text.word_count("body")
    return d.select(
        "doc_id",
        words.alias("words"),
        ((words < 100) | (words > 175)).alias("retry"),
        F.when(words < 95, "below min").when(words > 180, "above max").alias("warning"),
        text.subject_line(F.replace("body", F.lit("\n"), F.lit(" "))).alias("subject"),
    )


WS = "[\\s\\x{00A0}\\x{FEFF}]"
WORDS_SQL = f"""len(list_filter(string_split_regex(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '{WS}+'), lambda w: w <> ''))::int"""
PLAIN_SQL = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(10), ' '),
  '[—–]', ',', 'g'), '[‘’]', '''', 'g'), '[“”]', '"', 'g'), '…', '...', 'g'), '{WS}+\\n', chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g')"""
register(
    "draft_quality",
    draft_report,
    f"""SELECT doc_id, words, words < 100 OR words > 175 AS retry,
    CASE WHEN words < 95 THEN 'below min' WHEN words > 180 THEN 'above max' END AS warning,
    CASE WHEN length(s) <= 55 THEN s ELSE regexp_replace(regexp_replace(
      CASE WHEN contains(cut, ' ') AND length(regexp_extract(cut, '^(.*) ', 1, 's')) > 33 THEN regexp_extract(cut, '^(.*) ', 1, 's') ELSE cut END,
      '[,\\-–—:]\\s*$', ''), '^{WS}+|{WS}+$', '', 'g') END AS subject
    FROM (SELECT *, s[1:55] AS cut FROM (SELECT doc_id, {WORDS_SQL} AS words, {PLAIN_SQL} AS s FROM documents))""",
)
register(
    "draft_body",
    lambda v: v.documents.select(
        "doc_id",
        text.draft_body(
            F.concat(F.lit("We at Acme (acme.co.uk) help. "), "text", F.lit(" Acme (acme.co.uk) again")),
            "Acme", "acme.co.uk",
        ).alias("body"),
    ),
    "SELECT doc_id, '<p>' || replace("
    + PLAIN_SQL.replace("replace(text, chr(10), ' ')", "'We at Acme (acme.co.uk) help. ' || text || ' Acme again'")
    + ", chr(10), '<br/>') || '</p>' AS body FROM documents",
)
register(
    "body_hash",
    lambda v: v.documents.select("doc_id", text.body_hash("text").alias("hash")),
    "SELECT doc_id, sha256(text)[1:16] AS hash FROM documents",
)
register(
    "edit_summary",
    lambda v: v.conversations.alias("a")
    .join(
        v.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")),
        ["conv_id", "turn"],
        "left",
    )
    .select(
        "conv_id", "turn", text.edit_summary("text", "next").alias("summary"),
        (text.strip_html("next") != F.trim("text")).alias("edited"),
    ),
    """SELECT conv_id, turn, CASE WHEN n IS NULL THEN 'cleared' WHEN n = text THEN 'none'
      ELSE CASE WHEN length(n) > length(text) THEN '+' ELSE '' END || (length(n) - length(text)) || ' chars' END AS summary,
      plain <> trim(text) AS edited FROM (
    SELECT a.conv_id, a.turn, a.text, b.text AS n, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(b.text,
      '</(p|div)>', chr(10) || chr(10), 'gi'), '<br\\s*/?>', chr(10), 'gi'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '^\\s+|\\s+$', '', 'g') AS plain
    FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)""",
)

# ---- ordered sets ------------------------------------------------------------


def all_words():
    return F.regexp_extract_all("text", F.lit(r"[^ \n\t]+"), F.lit(0))


register(
    "distinct_first_seen",
    lambda v: v.documents.select(
        "doc_id",
        F.array_join(text.distinct_first_seen(all_words()), "|").alias("words"),
    ),
    """SELECT d.doc_id, coalesce(w.words, '') AS words FROM documents d LEFT JOIN (
      SELECT doc_id, string_agg(w, '|' ORDER BY p) AS words FROM (
        SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
          FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\n\\t]+') AS ws FROM documents))
        GROUP BY doc_id, w) GROUP BY doc_id) w USING (doc_id)""",
)
register(
    "first_n_array",
    lambda v: v.documents.select(
        "doc_id",
        F.array_join(text.first_n(all_words(), 8), "|").alias("words"),
    ),
    """SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[^ \\n\\t]+')))[1:8], '|'), '') AS words
    FROM documents""",
)
__all__ = ["quoted"]
