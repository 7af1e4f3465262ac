"""Registry queries: qualification, signals, scores, send windows, director links."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.operators import qualify, queues, signals
from leadloom.plans.registry import register
from leadloom.session import written
from leadloom.sources.views import EVENTS_AS_OF, REGISTER_AS_OF

AS_OF = REGISTER_AS_OF
TODAY = f"DATE '{AS_OF}'"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def text(*names: str):
    """Columns as text, so that both engines compare them alike."""
    return [F.col(n).cast("string").alias(n) for n in names]


# ---- SQL shared by several checks -------------------------------------------

STANDING_SQL = """CASE
 WHEN company_status IS DISTINCT FROM 'active' THEN 'status=' || coalesce(company_status, 'unknown')
 WHEN has_been_liquidated OR has_insolvency_history THEN 'insolvency-history'
 WHEN accounts_overdue THEN 'accounts-overdue'
 WHEN confirmation_overdue THEN 'confirmation-statement-overdue'
 WHEN regexp_matches(last_accounts_type, 'DORMANT|AA02', 'i') THEN 'last-accounts-type=' || last_accounts_type
 WHEN nullif(trim(lower(accounts_category)), '') IS NULL THEN 'no-accounts-category'
 WHEN trim(lower(accounts_category)) NOT IN ('small','medium','full','unaudited-abridged','audited-abridged')
   THEN 'accounts-category=' || trim(lower(accounts_category)) END"""
ADDRESS_SQL = (
    "nullif(array_to_string(list_filter([address_line_1, address_line_2, locality, region, "
    "postal_code, country], lambda x: x IS NOT NULL AND x <> ''), ', '), '')"
)
NOMINEE_SQL = (
    f"coalesce(len(list_filter([{quoted(rules.NOMINEE_FRAGMENTS)}], "
    f"lambda f: contains(lower({ADDRESS_SQL}), f))) > 0, false)"
)
DORMANT_SQL = (
    "coalesce(upper(last_accounts_type) IN ('DORMANT','AA02','MICRO_DORMANT','DORMANT_LBG'), false)"
)
HARD_SQL = """CASE WHEN has_been_liquidated THEN 'liquidated'
 WHEN has_insolvency_history THEN 'insolvency-history'
 WHEN company_status IS DISTINCT FROM 'active' THEN 'status=' || coalesce(company_status, 'unknown')
 WHEN len(list_filter(string_split(sic_csv, ','), lambda c: c LIKE '64%' OR c LIKE '411%')) > 0
 THEN 'sic-blocked=' || list_filter(string_split(sic_csv, ','), lambda c: c LIKE '64%' OR c LIKE '411%')[1] END"""
OFFICERS_SQL = """SELECT company_number, count(*)::int AS director_count,
  min(appointed_on) AS earliest_appointed_on, max(appointed_on) AS latest_appointed_on
  FROM @officers_v@ WHERE resigned_on IS NULL AND officer_role IN ('director', 'llp-member')
  GROUP BY company_number"""
PRIMARY_SQL = """SELECT company_number, name AS primary_director, officer_role AS primary_role FROM (
  SELECT *, row_number() OVER (PARTITION BY company_number ORDER BY appointed_on NULLS LAST,
    CASE officer_role WHEN 'director' THEN 0 ELSE 1 END, name) AS rn
  FROM @officers_v@ WHERE resigned_on IS NULL AND officer_role IN ('director', 'llp-member')) q
  WHERE rn = 1"""
FILINGS_SQL = f"""SELECT company_number,
  max(filing_date) FILTER ({TODAY} - filing_date <= 365 AND (category = 'address'
    OR regexp_matches(coalesce(description, ''), 'change.*registered.*office', 'i'))) AS office_moved_on,
  max(filing_date) FILTER ({TODAY} - filing_date <= 365 AND (category = 'capital'
    OR regexp_matches(coalesce(description, ''), 'allotment|increase.*capital', 'i'))) AS capital_event_on,
  count(*) FILTER (category = 'change-of-name' AND {TODAY} - filing_date <= 1825)::int AS name_changes
  FROM @filings_v@ GROUP BY company_number"""
CHARGES_SQL = """SELECT company_number,
  count(*) FILTER (status IN ('outstanding', 'part-satisfied'))::int AS active_charges,
  max(created_on) FILTER (status IN ('outstanding', 'part-satisfied')) AS latest_charge_on
  FROM @charges_v@ GROUP BY company_number"""
PSC_SQL = """SELECT company_number, count(*) FILTER (ceased_on IS NULL)::int AS active_psc,
  count(*) FILTER (ceased_on IS NULL AND regexp_matches(lower(kind), 'corporate|legal-person'))::int AS corporate_psc,
  count(*) FILTER (ceased_on IS NULL AND regexp_matches(lower(kind), 'individual')
    AND NOT regexp_matches(lower(kind), 'corporate|legal-person'))::int AS individual_psc
  FROM @psc_v@ GROUP BY company_number"""
SIGNALS_SQL = f"""SELECT c.*, o.* EXCLUDE company_number, f.* EXCLUDE company_number,
  h.* EXCLUDE company_number, p.* EXCLUDE company_number, a.* EXCLUDE company_number,
  d.* EXCLUDE company_number
  FROM @companies_v@ c LEFT JOIN ({OFFICERS_SQL}) o USING (company_number)
  LEFT JOIN ({PRIMARY_SQL}) d USING (company_number)
  LEFT JOIN ({FILINGS_SQL}) f USING (company_number)
  LEFT JOIN ({CHARGES_SQL}) h USING (company_number)
  LEFT JOIN ({PSC_SQL}) p USING (company_number)
  LEFT JOIN @accounts_v@ a USING (company_number)"""
CORP = "coalesce(corporate_psc, 0)"
SCORE_RULES = [
    (f"{TODAY} - latest_appointed_on BETWEEN 0 AND 90", 12, "new_director_recent"),
    ("director_count BETWEEN 1 AND 3", 8, "founder_led"),
    ("director_count >= 7", -12, "board_run"),
    ("office_moved_on IS NOT NULL", 5, "registered_office_moved_recently"),
    ("capital_event_on IS NOT NULL", 8, "recent_capital_event"),
    (f"{TODAY} - latest_charge_on <= 90", 4, "recent_charge_created"),
    (f"{CORP} > 0 AND {CORP} >= individual_psc", -12, "corporate_psc_dominant"),
    (f"{CORP} > 0 AND {CORP} < individual_psc", 0, "corporate_psc_present"),
    ("name_changes >= 2", -8, "frequent_name_changes"),
    ("accounts_overdue", -25, "accounts_overdue"),
    ("confirmation_overdue", -10, "confirmation_statement_overdue"),
    ("turnover BETWEEN 1000000 AND 20000000", 15, "turnover_in_icp_band"),
    ("turnover > 20000000", -8, "turnover_above_icp"),
    ("turnover > 0 AND turnover < 250000", -15, "turnover_below_icp"),
    ("employees BETWEEN 10 AND 100", 8, "headcount_in_icp_band"),
    ("employees > 200", -8, "headcount_above_icp"),
    ("employees > 0 AND employees < 5", -10, "headcount_below_icp"),
    ("prior_turnover > 0 AND (turnover - prior_turnover)::double / prior_turnover >= 0.1", 10, "growing_yoy"),
    ("prior_turnover > 0 AND (turnover - prior_turnover)::double / prior_turnover <= -0.15", -5, "contracting_yoy"),
    ("turnover IS NULL AND employees IS NULL", 0, "no_parseable_accounts"),
]
SCORE_SQL = "greatest(0, least(100, 50 " + " ".join(
    f"+ CASE WHEN {c} THEN {d} ELSE 0 END" for c, d, _ in SCORE_RULES if d
) + "))::int"
SIGNAL_LIST_SQL = "concat_ws('|', " + ", ".join(
    f"CASE WHEN {c} THEN '{s}' END" for c, _, s in SCORE_RULES
) + ")"
REASON_COUNT_SQL = "(" + " + ".join(
    f"coalesce(({c})::int, 0)" for c, d, _ in SCORE_RULES if d
) + ")::int"
PARENT_SQL = f"""WITH homes AS (SELECT company_number, company_name, date_of_creation,
    lower({ADDRESS_SQL}) AS seat FROM @companies_v@ WHERE NOT {NOMINEE_SQL}),
  seats AS (SELECT DISTINCT o.company_number, company_name, date_of_creation, seat,
    trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS director
    FROM @officers_v@ o JOIN homes USING (company_number)
    WHERE resigned_on IS NULL AND officer_role IN ('director', 'llp-member')),
  accepted AS (SELECT company_number FROM @companies_v@ WHERE company_name IS NOT NULL
    AND NOT coalesce({DORMANT_SQL}, false) AND {STANDING_SQL} IS NULL AND {HARD_SQL} IS NULL),
  heads AS (SELECT * FROM seats WHERE company_number IN (SELECT company_number FROM accepted)),
  pairs AS (SELECT c.company_number, p.company_number AS parent_number, p.company_name AS parent_name,
    p.date_of_creation AS born, c.director FROM seats c JOIN heads p ON c.seat = p.seat
    AND c.director = p.director AND (p.date_of_creation, p.company_number) < (c.date_of_creation, c.company_number)),
  best AS (SELECT *, min((born, parent_number)) OVER (PARTITION BY company_number) AS first FROM pairs)
"""
PARENT_ROWS_SQL = (
    PARENT_SQL
    + """SELECT company_number, parent_number, parent_name,
  string_agg(director, '|' ORDER BY director) AS shared_directors
  FROM best WHERE (born, parent_number) = first GROUP BY 1, 2, 3"""
)


def year_end_sql(made: str, now_date: str) -> str:
    same = "(make_date({y}, month(" + made + ")::bigint, 1) + (day(" + made + ")::int - 1))"
    this, following = same.format(y=f"year({now_date})"), same.format(y=f"year({now_date}) + 1")
    return f"(CASE WHEN {this} > {now_date} THEN {this} ELSE {following} END)"


def window_sql(now_date: str, inc: str, made: str, due: str, appointed: str) -> str:
    milestones = " ".join(
        f"WHEN ({now_date} - {inc}) / 365.25 < {m} THEN {m}" for m in rules.ANNIVERSARY_YEARS
    )
    m = f"(CASE {milestones} END)"
    anniversary = (
        f"(make_date(year({inc}) + {m}, month({inc})::bigint, 1) + (day({inc})::int - 1) - 14)"
    )
    return f"""list_sort(list_filter([
  CASE WHEN {now_date} - {appointed} BETWEEN 0 AND 90 THEN {{'at': {now_date}, 'n': 0, 'reason': 'new-director-honeymoon'}} END,
  CASE WHEN {made} IS NOT NULL THEN {{'at': {year_end_sql(made, now_date)} + 35, 'n': 1, 'reason': 'post-year-end'}} END,
  CASE WHEN {due} - 35 > {now_date} THEN {{'at': {due} - 35, 'n': 2, 'reason': 'pre-accounts-deadline'}} END,
  CASE WHEN {m} IS NOT NULL THEN {{'at': {anniversary}, 'n': 3, 'reason': {m} || '-year-anniversary'}} END
  ], lambda x: x IS NOT NULL))[1]"""


# ---- qualification ----------------------------------------------------------

register(
    "financial_standing",
    lambda v: qualify.financial_standing(v.companies_v).select(
        "company_number",
        "accounts_category",
        "standing_reason",
        F.col("standing_reason").isNull().alias("passes"),
    ),
    f"""SELECT company_number, nullif(trim(lower(accounts_category)), '') AS accounts_category,
    {STANDING_SQL} AS standing_reason, {STANDING_SQL} IS NULL AS passes FROM @companies_v@""",
)
register(
    "dormant_filer",
    lambda v: v.companies_v.where(qualify.is_dormant_filer()).select(
        "company_number", "last_accounts_type"
    ),
    f"SELECT company_number, last_accounts_type FROM @companies_v@ WHERE {DORMANT_SQL}",
)
register(
    "nominee_address",
    lambda v: v.companies_v.select(
        "company_number",
        qualify.company_address().alias("address"),
        qualify.is_nominee_address(qualify.company_address()).alias("nominee"),
    ),
    f"SELECT company_number, {ADDRESS_SQL} AS address, {NOMINEE_SQL} AS nominee FROM @companies_v@",
)
register(
    "hard_exclude",
    lambda v: v.companies_v.select(
        "company_number", qualify.hard_exclude_reason(["64", "411"]).alias("reason")
    ).where("reason IS NOT NULL"),
    f"SELECT * FROM (SELECT company_number, {HARD_SQL} AS reason FROM @companies_v@) WHERE reason IS NOT NULL",
)


def scored(v, companies=None):
    wide = signals.company_signals(
        v.companies_v if companies is None else companies,
        v.officers_v, v.filings_v, v.charges_v, v.psc_v, v.accounts_v, AS_OF,
    )
    return signals.pre_score(wide, AS_OF)


def registry(v):
    """The register with its reasons, one written stage: whoever reads it plans a scan, not the rules."""
    return written(qualify.registry_gate(v.companies_v, sic_prefixes=["64", "411"]), "registry")


def parents(v, companies=None):
    """Only companies that pass the register's own rules may be a parent."""
    companies = registry(v) if companies is None else companies
    accepted = companies.where("registry_reason IS NULL")
    return signals.parent_company(companies, v.officers_v, accepted)


def gated(v, policy="flag"):
    """Companies that their own row rejects are not joined or scored."""
    companies = registry(v)
    linked = parents(v, companies).select("company_number", "parent_number")
    kept = written(scored(v, companies.where("registry_reason IS NULL")), "scored").join(linked, "company_number", "left")
    rejected = companies.where("registry_reason IS NOT NULL").withColumns(
        {"reject_reason": F.col("registry_reason"), "is_subsidiary": F.lit(False)}
    )
    return qualify.discovery_gate(kept, policy).unionByName(rejected, allowMissingColumns=True)


GATED_SQL = f"""SELECT *, own IS NULL AND parent_number IS NOT NULL AS is_subsidiary,
  CASE WHEN own IS NOT NULL THEN own WHEN pre_score < 30 THEN 'pre-score' END AS reject_reason
  FROM (SELECT s.*, {SCORE_SQL} AS pre_score, par.parent_number,
    CASE WHEN company_name IS NULL THEN 'profile-missing' WHEN {DORMANT_SQL} THEN 'dormant'
    WHEN {STANDING_SQL} LIKE 'status=%' THEN 'status-inactive'
    WHEN {STANDING_SQL} = 'insolvency-history' THEN 'insolvency'
    WHEN {STANDING_SQL} LIKE '%-overdue' THEN 'overdue'
    WHEN {STANDING_SQL} LIKE 'last-accounts-type%' THEN 'dormant'
    WHEN {STANDING_SQL} = 'no-accounts-category' THEN 'no-accounts-category'
    WHEN {STANDING_SQL} LIKE 'accounts-category=%' THEN 'accounts-category'
    WHEN {HARD_SQL} IS NOT NULL THEN 'hard-exclude'
    WHEN {NOMINEE_SQL} THEN 'nominee-address' END AS own
    FROM ({SIGNALS_SQL}) s LEFT JOIN (SELECT DISTINCT company_number, parent_number FROM ({PARENT_ROWS_SQL}) z) par
    USING (company_number)) y"""

register(
    "discovery_gate",
    lambda v: gated(v).select("company_number", "reject_reason", "is_subsidiary", "pre_score"),
    f"""SELECT company_number, reject_reason, is_subsidiary, CASE WHEN own IS NULL THEN pre_score END AS pre_score
    FROM ({GATED_SQL})""",
)
register(
    "discovery_gate_reject",
    lambda v: gated(v, "reject").select("company_number", "reject_reason", "is_subsidiary"),
    f"""SELECT company_number, is_subsidiary, CASE WHEN own IS NOT NULL THEN own WHEN is_subsidiary THEN 'subsidiary'
    ELSE reject_reason END AS reject_reason FROM ({GATED_SQL})""",
)
register(
    "discovery_gate_ignore",
    lambda v: gated(v, "ignore").select("company_number", "reject_reason", "is_subsidiary"),
    f"SELECT company_number, reject_reason, false AS is_subsidiary FROM ({GATED_SQL})",
)
register(
    "rejection_funnel",
    lambda v: qualify.rejection_funnel(gated(v)),
    "SELECT locality, count(*) AS searched, count(*) FILTER (reject_reason IS NULL) AS kept, "
    + ", ".join(
        f"count(*) FILTER (reject_reason = '{r}') AS rejected_{r.replace('-', '_')}"
        for r in qualify.GATE_REASONS
    )
    + f""", count(*) FILTER (reject_reason IN ({quoted(qualify.STANDING_REASONS)})) AS rejected_standing,
    count(*) FILTER (is_subsidiary) AS flagged_subsidiary, grouping(locality)::int AS is_total
    FROM ({GATED_SQL}) GROUP BY ROLLUP (locality)""",
)

# ---- aggregated signals -----------------------------------------------------

register(
    "officer_signals",
    lambda v: signals.officer_signals(v.officers_v).select(
        "company_number", "director_count", *text("earliest_appointed_on", "latest_appointed_on")
    ),
    f"""SELECT company_number, director_count, earliest_appointed_on::varchar AS earliest_appointed_on,
    latest_appointed_on::varchar AS latest_appointed_on FROM ({OFFICERS_SQL})""",
)
register(
    "primary_director",
    lambda v: signals.primary_director(v.officers_v),
    PRIMARY_SQL,
)
register(
    "filing_signals",
    lambda v: signals.filing_signals(v.filings_v, AS_OF).select(
        "company_number", *text("office_moved_on", "capital_event_on")
    ),
    f"""SELECT company_number, office_moved_on::varchar AS office_moved_on,
    capital_event_on::varchar AS capital_event_on FROM ({FILINGS_SQL})""",
)
register(
    "name_changes",
    lambda v: signals.filing_signals(v.filings_v, AS_OF).select("company_number", "name_changes"),
    f"SELECT company_number, name_changes FROM ({FILINGS_SQL})",
)
register(
    "charges_summary",
    lambda v: signals.charges_summary(v.charges_v).select(
        "company_number", "active_charges", *text("latest_charge_on")
    ),
    f"""SELECT company_number, active_charges, latest_charge_on::varchar AS latest_charge_on
    FROM ({CHARGES_SQL})""",
)
register(
    "psc_breakdown",
    lambda v: signals.psc_breakdown(v.psc_v),
    PSC_SQL,
)
register(
    "psc_dominance",
    lambda v: signals.psc_breakdown(v.psc_v)
    .select(
        "company_number", signals.psc_dominance("corporate_psc", "individual_psc").alias("dominance")
    )
    .where("dominance IS NOT NULL"),
    f"""SELECT company_number, CASE WHEN corporate_psc >= individual_psc THEN 'corporate_psc_dominant'
    ELSE 'corporate_psc_present' END AS dominance FROM ({PSC_SQL}) WHERE corporate_psc > 0""",
)
register(
    "yoy_growth",
    lambda v: signals.yearly_growth(v.accounts_history_v).select(
        "company_number",
        "period_year",
        F.round("turnover_growth", 6).alias("turnover_growth"),
        F.round("employee_growth", 6).alias("employee_growth"),
    ),
    """SELECT c.company_number, c.period_year,
    round((c.turnover - p.turnover)::double / p.turnover, 6) AS turnover_growth,
    round((c.employees - p.employees)::double / p.employees, 6) AS employee_growth
    FROM @accounts_history_v@ c LEFT JOIN @accounts_history_v@ p
    ON p.company_number = c.company_number AND p.period_year = c.period_year - 1""",
)

# ---- scores, windows, facts -------------------------------------------------

register(
    "pre_score",
    lambda v: scored(v).select(
        "company_number",
        "pre_score",
        F.array_join("signals", "|").alias("signals"),
        F.size("score_reasons").alias("n_reasons"),
    ),
    f"""SELECT company_number, {SCORE_SQL} AS pre_score, {SIGNAL_LIST_SQL} AS signals,
    {REASON_COUNT_SQL} AS n_reasons FROM ({SIGNALS_SQL})""",
)
register(
    "send_window",
    lambda v: signals.with_send_window(
        v.companies_v.join(signals.officer_signals(v.officers_v), "company_number", "left"), AS_OF
    ).select(
        "company_number",
        F.date_format("window_at", "yyyy-MM-dd HH:mm:ss").alias("window_at"),
        "window_reason",
    ),
    f"""SELECT company_number, w.at::varchar || ' 00:00:00' AS window_at, w.reason AS window_reason
    FROM (SELECT company_number, {window_sql(TODAY, "date_of_creation", "last_made_up_to",
    "accounts_next_due", "latest_appointed_on")} AS w FROM ({SIGNALS_SQL}))""",
)
EVENTS_TODAY = f"DATE '{EVENTS_AS_OF[:10]}'"
register(
    "send_window_refresh",
    lambda v: signals.send_window_refresh(v.leads_v, EVENTS_AS_OF).select(
        "id", F.date_format("window_at", "yyyy-MM-dd HH:mm:ss").alias("window_at"), "window_reason"
    ),
    f"""SELECT id, w.at::varchar || ' 00:00:00' AS window_at, w.reason AS window_reason FROM (
    SELECT *, {window_sql(EVENTS_TODAY, "incorporated_on", "accounts_last_made_up_to",
    "accounts_next_due", "latest_director_appointed_on")} AS w FROM @leads_v@
    WHERE status = 'new_lead' AND coalesce(incorporated_on, accounts_last_made_up_to,
      latest_director_appointed_on) IS NOT NULL)
    WHERE w.at::timestamp IS DISTINCT FROM next_outreach_window
      OR w.reason IS DISTINCT FROM next_outreach_window_reason""",
)


def gbp_sql(c: str) -> str:
    """Money text of a whole number, rounded half up."""
    return f"""CASE WHEN {c} >= 1000000 THEN ({c} + 5000) // 1000000 || '.' || lpad((({c} + 5000) // 10000 % 100)::varchar, 2, '0') || 'm'
      WHEN {c} >= 1000 THEN ({c} + 500) // 1000 || 'k' ELSE {c}::varchar END"""


GROWTH_SQL = "((turnover - prior_turnover)::double / prior_turnover * 100)"
register(
    "facts_block",
    lambda v: scored(v)
    .withColumns(
        {
            "vat_registered": F.when(F.col("company_number").endswith("1"), F.lit(True)).when(
                F.col("company_number").endswith("2"), F.lit(False)
            ),
            "vat_number": F.when(F.col("company_number").endswith("11"), F.lit("123456789")),
        }
    )
    .select("company_number", signals.facts_block(AS_OF).alias("facts")),
    f"""SELECT company_number, concat_ws(chr(10), 'Company: ' || company_name || ' (CRN ' || company_number || ')',
    'Founded: ' || date_of_creation::varchar || ' (' || floor(({TODAY} - date_of_creation) / 365.25)::int || ' years).',
    'Accounts category: ' || accounts_category || '.', 'SIC codes: ' || replace(sic_csv, ',', ', ') || '.',
    'Primary director: ' || primary_director || ' (' || primary_role || ')'
      || coalesce(', in role since ' || earliest_appointed_on::varchar, '') || '.',
    'Active directors: ' || director_count || '.',
    CASE WHEN {SCORE_RULES[0][0]} THEN 'Most recent appointment: ' || latest_appointed_on::varchar
      || ' — in mandate-honeymoon window.' END,
    'Turnover (latest filed): £' || {gbp_sql("turnover")} || CASE WHEN prior_turnover > 0 THEN ', ' ||
      CASE WHEN {GROWTH_SQL} < 0 THEN '-' ELSE '' END || floor(abs({GROWTH_SQL}) + 0.5)::bigint || '% YoY (prior £'
      || {gbp_sql("prior_turnover")} || ')' ELSE '' END || '.',
    'Average employees: ' || employees || coalesce(' (prior year ' || prior_employees || ')', '') || '.',
    'Accounts made up to: ' || made_up_to::varchar || '.', 'Next accounts due: ' || accounts_next_due::varchar || '.',
    CASE WHEN active_charges > 0 THEN 'Outstanding charges: ' || active_charges || '.'
      WHEN active_charges = 0 THEN 'No outstanding charges.' END,
    CASE WHEN company_number LIKE '%11' THEN 'VAT-registered (GB123456789).' WHEN company_number LIKE '%1' THEN 'VAT-registered.'
      WHEN company_number LIKE '%2' THEN 'Not VAT-registered.' END,
    CASE WHEN {SIGNAL_LIST_SQL} <> '' THEN 'CH signals: ' || replace({SIGNAL_LIST_SQL}, '|', ', ') || '.' END) AS facts
    FROM ({SIGNALS_SQL})""",
)

# ---- links between companies ------------------------------------------------

register(
    "parent_company",
    lambda v: parents(v).withColumn(
        "shared_directors", F.array_join("shared_directors", "|")
    ),
    PARENT_ROWS_SQL,
)
PEOPLE_SQL = """SELECT *, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS director,
  coalesce(dob_month, 0) AS m, coalesce(dob_year, 0) AS y,
  (coalesce(appointed_on, DATE '0001-01-01'), company_number, officer_role, coalesce(resigned_on, DATE '9999-12-31')) AS ver
  FROM @officers_v@ WHERE officer_role IN ('director', 'llp-member')"""
register(
    "directors",
    lambda v: signals.director_graph(v.officers_v)[0],
    f"""SELECT director, m AS dob_month, y AS dob_year, max_by(name, ver) AS full_name,
    (max_by({{'v': nationality}}, ver)).v AS nationality, (max_by({{'v': occupation}}, ver)).v AS occupation,
    (max_by({{'v': country_of_residence}}, ver)).v AS country_of_residence
    FROM ({PEOPLE_SQL}) GROUP BY 1, 2, 3""",
)
register(
    "director_graph",
    lambda v: signals.director_graph(v.officers_v)[1].select(
        "company_number", "director", "dob_month", "dob_year", "role",
        *text("appointed_on", "resigned_on"), "is_active",
    ),
    f"""SELECT company_number, director, m AS dob_month, y AS dob_year, officer_role AS role,
    (max_by({{'v': appointed_on}}, ver)).v::varchar AS appointed_on,
    (max_by({{'v': resigned_on}}, ver)).v::varchar AS resigned_on,
    (max_by({{'v': resigned_on}}, ver)).v IS NULL AS is_active
    FROM ({PEOPLE_SQL}) GROUP BY 1, 2, 3, 4, 5""",
)
register(
    "director_overlap",
    lambda v: parents(v).select(
        "company_number", "parent_number", F.size("shared_directors").alias("n_shared")
    ),
    f"""SELECT company_number, parent_number, len(string_split(shared_directors, '|'))::int AS n_shared
    FROM ({PARENT_ROWS_SQL})""",
)

# ---- the whole path, register to queue --------------------------------------


def company_queue(v):
    survivors = signals.with_send_window(gated(v).where("reject_reason IS NULL"), AS_OF)
    return queues.top_queue(
        survivors.where(
            F.col("window_at").isNull() | (F.col("window_at") <= signals.as_moment(AS_OF))
        ),
        ["pre_score", "date_of_creation", "company_number"],
        limit=50,
    ).select(
        "company_number", "company_name", "pre_score",
        F.array_join("signals", "|").alias("signals"), "window_reason",
    )


register(
    "company_queue",
    company_queue,
    f"""SELECT company_number, company_name, pre_score, {SIGNAL_LIST_SQL} AS signals, w.reason AS window_reason
    FROM (SELECT *, {window_sql(TODAY, "date_of_creation", "last_made_up_to", "accounts_next_due",
    "latest_appointed_on")} AS w FROM ({GATED_SQL}) WHERE reject_reason IS NULL)
    WHERE w IS NULL OR w.at <= {TODAY}
    ORDER BY pre_score DESC NULLS LAST, date_of_creation, company_number LIMIT 50""",
)
