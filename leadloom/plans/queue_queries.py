"""Queues, follow-ups, contact merging, routing and scan plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import queues
from leadloom.plans.key_queries import email_sql, phone_sql
from leadloom.plans.registry import register
from leadloom.sources.views import EVENTS_AS_OF as AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"

ELIGIBLE_SQL = f"""status = 'new_lead' AND NOT locked
  AND (next_outreach_window IS NULL OR next_outreach_window <= {NOW}) AND research_failures < 3
  AND (last_research_attempt_at IS NULL OR last_research_attempt_at <= {NOW} - INTERVAL 6 HOUR)"""
register(
    "queue_eligible",
    lambda v: v.leads_v.where(queues.is_queue_eligible(AS_OF)).select("id", "ch_pre_score"),
    f"SELECT id, ch_pre_score FROM @leads_v@ WHERE {ELIGIBLE_SQL}",
)
register(
    "work_queue",
    lambda v: queues.work_queue(v.leads_v, AS_OF).select("id", "business_name", "ch_pre_score"),
    f"""SELECT id, business_name, ch_pre_score FROM @leads_v@ WHERE {ELIGIBLE_SQL}
    ORDER BY ch_pre_score DESC NULLS LAST, created_at, id LIMIT 5""",
)
FOLLOW_SQL = f"""status = 'outreach_sent' AND NOT reply_received
  AND last_contacted_at < {NOW} - INTERVAL 3 DAY AND follow_up_draft_id IS NULL"""
KILL_SQL = """scenario = 'S8_Kill_Switch' AND error_code = 'KILL_SWITCH_ACTIVE' AND kill_switch
  AND ts >= {now} - INTERVAL 24 HOUR"""
# By this moment the last switch has lapsed; at AS_OF itself follow-ups are blocked.
LATER = "2024-02-02 00:00:00"
register(
    "followup_eligible",
    lambda v: queues.followup_eligible(v.leads_v, v.error_log_v, LATER).select("id", "email"),
    f"""SELECT id, email FROM @leads_v@ WHERE status = 'outreach_sent' AND NOT reply_received
    AND last_contacted_at < TIMESTAMP '{LATER}' - INTERVAL 3 DAY AND follow_up_draft_id IS NULL
    AND NOT EXISTS (SELECT 1 FROM @error_log_v@ WHERE {KILL_SQL.format(now=f"TIMESTAMP '{LATER}'")})""",
)
register(
    "followup_queue",
    lambda v: queues.followup_queue(v.leads_v.where(queues.is_followup_eligible(AS_OF)), AS_OF).select(
        "id", "days_since_contact", "outcome"
    ),
    f"""SELECT id, floor(epoch({NOW} - last_contacted_at) / 86400)::int AS days_since_contact,
    CASE WHEN email IS NULL THEN 'skipped_no_email' ELSE 'queued' END AS outcome
    FROM @leads_v@ WHERE {FOLLOW_SQL} ORDER BY last_contacted_at, id LIMIT 5""",
)
register(
    "stale_locks",
    lambda v: queues.release_stale_locks(v.leads_v, AS_OF)
    .where("released OR recovered")
    .select("id", "locked", "status", "released", "recovered"),
    f"""SELECT * FROM (SELECT id, locked AND NOT released AS locked,
      CASE WHEN recovered THEN 'new_lead' ELSE status END AS status, released, recovered FROM (
      SELECT *, status IN ('enriching', 'verifying') AND NOT (locked AND NOT released)
        AND updated_at < {NOW} - INTERVAL 30 MINUTE AS recovered FROM (
      SELECT *, locked AND (lock_at IS NULL OR lock_at < {NOW} - INTERVAL 30 MINUTE) AS released
      FROM @leads_v@))) WHERE released OR recovered""",
)
MERGED_SQL = f"""SELECT l.id, {email_sql("coalesce(CASE WHEN s.outcome <> 'failed' THEN s.email END, r.email, l.email)")} AS email,
  coalesce(s.phone, r.phone, l.phone) AS phone, {phone_sql("coalesce(s.phone, r.phone, l.phone)")} AS phone_e164,
  coalesce(l.owner_name, s.owner_name, r.owner_name) AS owner_name,
  coalesce(s.description, r.description, l.description) AS description,
  coalesce(r.website, l.website_url) AS website_url, l.scrape_attempts,
  CASE WHEN coalesce(r.website, l.website_url) IS NULL OR s.lead_id IS NULL THEN 'skipped' WHEN s.outcome = 'failed' THEN 'failed'
    WHEN s.email IS NULL THEN 'empty' ELSE 'ok' END AS scrape_outcome
  FROM @leads_v@ l LEFT JOIN @research_v@ r ON r.lead_id = l.id LEFT JOIN @scrapes_v@ s ON s.lead_id = l.id"""


def merged(v):
    return queues.merge_contacts(v.leads_v, v.research_v, v.scrapes_v)


register(
    "contact_merge",
    lambda v: merged(v).drop("greeting"),
    MERGED_SQL,
)
NO_EMAIL_SQL = f"""SELECT id, CASE WHEN website_url IS NULL THEN 'no_email_no_website'
    WHEN scrape_outcome = 'failed' AND scrape_attempts + 1 >= 3 THEN 'no_email_scrape_failed_max_retries'
    WHEN scrape_outcome = 'failed' THEN 'no_email_scrape_failed' ELSE 'no_email_scrape_empty' END AS outcome,
    CASE WHEN website_url IS NOT NULL AND scrape_outcome = 'failed' AND scrape_attempts + 1 < 3 THEN 'new_lead'
    ELSE 'exclude' END AS next_status,
    (scrape_attempts + CASE WHEN website_url IS NOT NULL AND scrape_outcome = 'failed' THEN 1 ELSE 0 END)::int AS scrape_attempts
    FROM ({MERGED_SQL}) WHERE email IS NULL"""
register("no_email_route", lambda v: queues.no_email_route(merged(v)), NO_EMAIL_SQL)
RETRY_SQL = """SELECT l.id, (research_failures + 1)::int AS research_failures,
    CASE WHEN research_failures + 1 >= 3 THEN 'needs_review' ELSE 'new_lead' END AS next_status,
    CASE WHEN research_failures + 1 >= 3 THEN 'research_failed_max_retries' ELSE 'research_failed_will_retry' END AS outcome
    FROM @leads_v@ l JOIN @research_v@ r ON r.lead_id = l.id WHERE NOT ok"""
register("research_retry", lambda v: queues.research_retry(v.leads_v, v.research_v), RETRY_SQL)
register(
    "outcome_counts",
    lambda v: queues.outcome_counts(
        queues.no_email_route(merged(v))
        .select("outcome")
        .unionByName(queues.research_retry(v.leads_v, v.research_v).select("outcome"))
    ),
    f"""SELECT outcome, count(*) AS n FROM (SELECT outcome FROM ({NO_EMAIL_SQL})
    UNION ALL SELECT outcome FROM ({RETRY_SQL})) GROUP BY outcome""",
)
register(
    "verification_score",
    lambda v: v.email_probe_v.select("email", queues.verification_score().alias("score")),
    """SELECT email, CASE WHEN NOT mx_valid THEN 0 WHEN blocked THEN 20
    WHEN smtp_code = 250 AND catch_all THEN 50 WHEN smtp_code = 250 THEN 90
    WHEN smtp_code < 500 THEN 30 ELSE 20 END::int AS score FROM @email_probe_v@""",
)
register(
    "tier_assign",
    lambda v: v.leads_v.select(
        "id", "brand_fit_score", queues.tier().alias("assigned"),
        (queues.tier() != F.col("tier")).alias("overridden"),
    ),
    """SELECT id, brand_fit_score, t AS assigned, t <> tier AS overridden FROM (SELECT *, CASE
    WHEN brand_fit_score >= 70 THEN 'Tier1' WHEN brand_fit_score >= 50 THEN 'Tier2' ELSE 'Exclude' END AS t FROM @leads_v@)""",
)
register(
    "daily_digest",
    lambda v: queues.daily_digest(v.leads_v, v.followups_v),
    "WITH s AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS section, {rank} AS rank, id FROM @leads_v@ WHERE {c}"
        for n, rank, c in [
            ("warm_replies", "epoch_us(last_reply_at)", "status = 'interested'"),
            ("pending_approvals", "brand_fit_score", "status = 'waiting_concierge'"),
            ("tier2_drafts", "brand_fit_score", "status = 'waiting_concierge' AND tier = 'Tier2'"),
            ("top_leads", "brand_fit_score", "status IN ('outreach_sent', 'waiting_concierge')"),
        ]
    )
    + """ UNION ALL SELECT 'follow_ups', -epoch_us(queued_at), lead_id FROM @followups_v@ WHERE queue_status = 'pending')
    SELECT section, place::int AS place, id FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY rank DESC NULLS LAST, id) AS place
    FROM s) WHERE place <= 5""",
)
register(
    "sweep_replay",
    lambda v: queues.sweep_replay(v.scans_v),
    """WITH r AS (SELECT *, row_number() OVER w AS attempt, sum(new_leads) OVER w AS total_new, sum(duration_ms) OVER w AS elapsed_ms,
      last_value(CASE WHEN new_leads > 0 THEN scan_ord END IGNORE NULLS) OVER w AS hit FROM @scans_v@
      WINDOW w AS (PARTITION BY sweep_id ORDER BY scan_ord ROWS UNBOUNDED PRECEDING)),
    z AS (SELECT *, sum((NOT skipped AND NOT failed AND new_leads = 0)::int) OVER (PARTITION BY sweep_id, hit ORDER BY scan_ord ROWS UNBOUNDED PRECEDING) AS streak FROM r),
    t AS (SELECT *, CASE WHEN total_new >= 50 THEN 'target_hit' WHEN attempt >= 30 THEN 'attempts_exhausted'
      WHEN elapsed_ms >= 1500000 THEN 'timeout' WHEN streak >= 3 THEN 'consecutive_zero_yield' END AS stop FROM z),
    e AS (SELECT sweep_id, min(attempt) FILTER (stop IS NOT NULL) AS last FROM t GROUP BY sweep_id)
    SELECT sweep_id, count(*) AS attempts, max(total_new)::int AS total_new, count(*) FILTER (skipped) AS skipped,
      max(elapsed_ms)::bigint AS elapsed_ms, coalesce(max(stop), 'plan_exhausted') AS stop_reason
    FROM t JOIN e USING (sweep_id) WHERE last IS NULL OR attempt <= last GROUP BY sweep_id""",
)
register(
    "cooldown",
    lambda v: queues.cooldown(
        v.nation.select(
            F.lit("register").alias("source"),
            F.lit("70229,62012").alias("query"),
            F.concat(F.lit("Region "), F.col("n_nationkey").cast("string")).alias("region"),
        ),
        v.runs_v,
        "2024-01-30 12:00:00",
    ),
    """SELECT 'register' AS source, '62012,70229' AS query, 'Region ' || n_nationkey AS region FROM nation
    WHERE 'Region ' || n_nationkey NOT IN (SELECT region FROM @runs_v@
      WHERE ran_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 48 HOUR)""",
)
register(
    "vat_status",
    lambda v: queues.vat_status(v.leads_v, v.vat_register_v),
    """SELECT id, d AS vrn, CASE WHEN d IS NOT NULL THEN EXISTS (SELECT 1 FROM @vat_register_v@ r WHERE r.vrn = d) END AS registered
    FROM (SELECT id, CASE WHEN length(n) IN (9, 12) THEN n END AS d FROM (SELECT id, regexp_replace(vat_number, '[^0-9]', '', 'g') AS n
      FROM @leads_v@ WHERE vat_checked_on IS NULL))""",
)
