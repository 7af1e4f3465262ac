"""Mail, log and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.operators import events, mail, tables
from leadloom.plans.key_queries import email_sql
from leadloom.plans.register_queries import quoted
from leadloom.plans.registry import register
from leadloom.session import cut_lineage
from leadloom.sources.views import EVENTS_AS_OF

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def stamp(*names: str):
    return [F.date_format(n, STAMP).alias(n) for n in names]


def stamp_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def re_sql(c: str, pattern: str) -> str:
    flags = ", 'i'" if pattern.startswith("(?i)") else ""
    return f"regexp_matches({c}, '{pattern.removeprefix('(?i)').replace(chr(39), chr(39) * 2)}'{flags})"


SENDER = "lower(trim(from_email))"
BOUNCE_SQL = " OR ".join(
    [re_sql(SENDER, p) for p in rules.BOUNCE_SENDER_PATTERNS]
    + [re_sql("coalesce(subject, '')", p) for p in rules.BOUNCE_SUBJECT_PATTERNS]
)
REASON_SQL = "CASE " + " ".join(
    f"WHEN {re_sql(c, p)} THEN '{part}:{p.removeprefix('(?i)')[:40].replace(chr(39), chr(39) * 2)}'"
    for part, c, ps in [
        ("subject", "coalesce(subject, '')", rules.AUTO_SUBJECT_PATTERNS),
        ("body", "text_body", rules.AUTO_BODY_PATTERNS),
    ]
    for p in ps
) + " END"
BOUNCED_SQL = "lower(coalesce(" + ", ".join(
    f"nullif(regexp_extract(text_body, '{p.removeprefix('(?i)')}', 1, 'i'), '')"
    for p in rules.BOUNCED_ADDRESS_PATTERNS
) + "))"
CLASSIFIED_SQL = f"""SELECT *, CASE WHEN b THEN 'bounce' WHEN r IS NOT NULL THEN 'auto_responder' ELSE 'real' END AS classification,
  CASE WHEN NOT b THEN r END AS auto_reason, CASE WHEN b THEN {BOUNCED_SQL} END AS bounced_address
  FROM (SELECT *, ({BOUNCE_SQL}) AS b, {REASON_SQL} AS r FROM @messages_v@)"""

register(
    "reply_classify",
    lambda v: mail.classify_replies(v.messages_v).select("message_id", "classification", "auto_reason"),
    f"SELECT message_id, classification, auto_reason FROM ({CLASSIFIED_SQL})",
)
register(
    "bounced_address",
    lambda v: mail.classify_replies(v.messages_v)
    .where("classification = 'bounce'")
    .select("message_id", "bounced_address"),
    f"SELECT message_id, bounced_address FROM ({CLASSIFIED_SQL}) WHERE classification = 'bounce'",
)


def by_email_sql(where: str) -> str:
    return f"""SELECT inbox, id AS lead_id, status AS lead_status FROM (SELECT *, row_number() OVER (PARTITION BY inbox
      ORDER BY last_contacted_at DESC NULLS LAST, id DESC) AS n FROM (SELECT *, {email_sql('email')} AS inbox FROM @leads_v@ {where})
      WHERE inbox IS NOT NULL) WHERE n = 1"""


ACTIVE_SQL = by_email_sql(f"WHERE status IN ({quoted(rules.AWAITING_REPLY)})")
register(
    "reply_to_lead",
    lambda v: mail.reply_to_lead(v.messages_v, v.leads_v).select("message_id", "lead_id", "lead_status"),
    f"""SELECT message_id, lead_id, lead_status FROM (SELECT *, {email_sql('from_email')} AS inbox FROM @messages_v@) m
    LEFT JOIN ({ACTIVE_SQL}) l USING (inbox)""",
)
FLOW_SQL = f"""SELECT message_id, received_at, classification, auto_reason, inbox, lead_id,
  CASE WHEN lead_id IS NULL THEN NULL WHEN b THEN 'verification_failed' WHEN classification <> 'real' THEN lead_status
    WHEN sentiment = 'positive' THEN 'interested' WHEN sentiment = 'hard_no' THEN 'not_interested' ELSE 'needs_review' END AS new_status,
  CASE WHEN b THEN 'bounced' WHEN classification = 'real' THEN 'replied' END AS suppress_as
  FROM (SELECT c.*, CASE WHEN b THEN a.lead_id ELSE t.lead_id END AS lead_id, t.lead_status FROM (
    SELECT *, {email_sql("(CASE WHEN b THEN bounced_address ELSE from_email END)")} AS inbox FROM ({CLASSIFIED_SQL})) c
    LEFT JOIN ({by_email_sql('')}) a USING (inbox) LEFT JOIN ({ACTIVE_SQL}) t USING (inbox))"""
register(
    "reply_flow",
    lambda v: mail.reply_flow(v.messages_v, v.leads_v).drop("received_at"),
    f"SELECT * EXCLUDE received_at FROM ({FLOW_SQL})",
)
register(
    "suppression_upsert",
    # the flow feeds several tables, so it is written once
    lambda v: mail.suppress(
        v.suppression_v, cut_lineage(mail.reply_flow(v.messages_v, v.leads_v))
    ).select("email", "reason", "lead_id"),
    f"""WITH f AS ({FLOW_SQL}), a AS (SELECT lower(email) AS email, reason, NULL AS lead_id, 0 AS batch, created_at, '' AS source FROM @suppression_v@
      UNION ALL SELECT inbox, suppress_as, lead_id, 1, received_at, message_id FROM f WHERE suppress_as IS NOT NULL AND inbox IS NOT NULL)
    SELECT email, CASE WHEN bool_or(reason = 'bounced') THEN 'bounced' ELSE arg_min(reason, (batch, created_at, source)) END AS reason,
      arg_max(lead_id, (batch, created_at, source)) FILTER (lead_id IS NOT NULL) AS lead_id FROM a GROUP BY email""",
)
MATCH_SQL = """SELECT notification_id, rank AS matched_by, lead_id FROM (SELECT *, row_number() OVER (PARTITION BY notification_id
    ORDER BY rank, last_contacted_at DESC NULLS LAST, lead_id DESC) AS n FROM (
  SELECT notification_id, 1 AS rank, l.id AS lead_id, last_contacted_at FROM {sent} s JOIN @leads_v@ l
    ON s.message_id = l.draft_id OR s.message_id = l.follow_up_draft_id
  UNION ALL SELECT notification_id, 2, l.id, last_contacted_at FROM {sent} s JOIN @leads_v@ l ON s.conversation_id = l.conversation_id
  UNION ALL SELECT notification_id, 3, lead_id, NULL FROM {sent} s JOIN @followups_v@ f ON f.draft_id = s.message_id AND queue_status = 'pending'))
  WHERE n = 1"""
register(
    "message_to_lead",
    lambda v: mail.message_to_lead(v.sent_items_v, v.leads_v, v.followups_v),
    MATCH_SQL.format(sent="@sent_items_v@"),
)
register(
    "sent_reconcile",
    lambda v: mail.reconcile_sent(v.sent_items_v, v.leads_v, v.followups_v, "secret").withColumn(
        "sent_at", F.date_format("sent_at", STAMP)
    ),
    f"""WITH ok AS (SELECT * FROM @sent_items_v@ WHERE client_state = 'secret' AND change_type IN ('created', 'updated') AND NOT is_draft),
    m AS ({MATCH_SQL.format(sent="ok")}),
    f AS (SELECT m.lead_id, ok.*, row_number() OVER (PARTITION BY m.lead_id ORDER BY sent_at, notification_id) AS n FROM m JOIN ok USING (notification_id))
    SELECT lead_id, CASE status WHEN 'waiting_concierge' THEN 'outreach_sent' ELSE 'follow_up_sent' END AS new_status,
      CASE status WHEN 'waiting_concierge' THEN 'outreach' ELSE 'follow_up' END AS direction, message_id,
      {stamp_sql('sent_at')} AS sent_at, 'outlook-direct:' || coalesce(from_addr, 'unknown') AS sent_by
    FROM f JOIN @leads_v@ l ON l.id = f.lead_id WHERE n = 1 AND status IN ('waiting_concierge', 'follow_up_queued')""",
)
register(
    "suppressed",
    lambda v: mail.approval_outcome(v.followups_v, v.leads_v, v.suppression_v),
    """SELECT queue_id, lead_id, reasoning LIKE 'Hard no detected%' AS goodbye,
    CASE WHEN queue_status <> 'pending' THEN 'already_actioned'
      WHEN reasoning NOT LIKE 'Hard no detected%' AND EXISTS (SELECT 1 FROM @suppression_v@ s WHERE lower(s.email) = lower(l.email)) THEN 'suppressed'
      WHEN f.draft_id IS NULL THEN 'missing_draft' ELSE 'ok' END AS outcome,
    CASE WHEN reasoning LIKE 'Hard no detected%' THEN 'goodbye' ELSE 'follow_up' END AS direction
    FROM @followups_v@ f LEFT JOIN @leads_v@ l ON l.id = f.lead_id""",
)

# ---- the log ------------------------------------------------------------------

SENDS_SQL = """SELECT id, coalesce(message ->> '$.leadId', lead_id, '') AS lead_id,
  coalesce(message ->> '$.direction', lower(error_code)) AS direction, coalesce(message ->> '$.subject', '') AS subject,
  message ->> '$.messageId' AS message_id, ts AS sent_at, coalesce(message ->> '$.sentBy', 'unknown') AS sent_by,
  coalesce((message ->> '$.wasEdited')::boolean, false) AS was_edited
  FROM (SELECT * FROM @error_log_v@ WHERE scenario = 'EMAIL_SENT' AND json_valid(message))"""
SEND_COLUMNS = ["id", "lead_id", "direction", "subject", "message_id", "sent_by", "was_edited"]
register(
    "send_log_parse",
    lambda v: mail.send_rows(v.error_log_v).select(*SEND_COLUMNS, *stamp("sent_at")),
    f"SELECT * REPLACE ({stamp_sql('sent_at')} AS sent_at) FROM ({SENDS_SQL})",
)
register(
    "send_history",
    lambda v: mail.lead_history(mail.send_rows(v.error_log_v)).select("lead_id", "place", "id"),
    f"""SELECT lead_id, place::int AS place, id FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY sent_at DESC, id DESC) AS place
    FROM ({SENDS_SQL})) WHERE place <= 20""",
)
register(
    "recent_sends",
    lambda v: mail.recent_sends(mail.send_rows(v.error_log_v)).select("id", "lead_id", "direction"),
    f"SELECT id, lead_id, direction FROM ({SENDS_SQL}) ORDER BY sent_at DESC, id DESC LIMIT 50",
)
register(
    "sends_by_day",
    lambda v: mail.sends_by_day(v.error_log_v, daily_cap=100).withColumn("day", F.col("day").cast("string")),
    """SELECT ts::date::varchar AS day, count(*) FILTER (error_code = 'OUTREACH') AS outreach,
    count(*) FILTER (error_code = 'FOLLOW_UP') AS follow_up, count(*) FILTER (error_code = 'GOODBYE') AS goodbye,
    count(*) FILTER (error_code IN ('OUTREACH', 'FOLLOW_UP', 'GOODBYE')) >= 100 AS cap_reached
    FROM @error_log_v@ WHERE scenario = 'EMAIL_SENT' GROUP BY 1""",
)
RATE_AT = "2024-01-28 12:00:00"
register(
    "bounce_rate",
    lambda v: mail.bounce_rate(v.error_log_v, v.leads_v, RATE_AT).withColumn("rate", F.round("rate", 6)),
    f"""SELECT bounces, contacted, round(CASE WHEN contacted > 0 THEN bounces::double / contacted ELSE 0 END, 6) AS rate,
    contacted > 0 AND bounces * 100.0 / contacted > 5 AS fires FROM
    (SELECT count(*) AS bounces FROM @error_log_v@ WHERE ts BETWEEN TIMESTAMP '{RATE_AT}' - INTERVAL 1 HOUR AND TIMESTAMP '{RATE_AT}'
      AND (contains(error_code, '550') OR contains(error_code, '551') OR contains(lower(error_code), 'bounce'))),
    (SELECT count(*) AS contacted FROM @leads_v@ WHERE last_contacted_at BETWEEN TIMESTAMP '{RATE_AT}' - INTERVAL 1 HOUR AND TIMESTAMP '{RATE_AT}')""",
)

# ---- replay --------------------------------------------------------------------

ARROWS = ", ".join(f"('{k}', '{a}', '{b}')" for k, a, b in rules.LEAD_TRANSITIONS)
register(
    "lead_state",
    lambda v: events.lead_state(v.lead_events_v).select(
        "lead_id", "status", "applied", "refused", *stamp("last_event_at")
    ),
    f"""WITH RECURSIVE t(kind, accepted, leads_to) AS (VALUES {ARROWS}),
    e AS MATERIALIZED (SELECT lead_id, kind, ts, row_number() OVER (PARTITION BY lead_id ORDER BY ts, event_id) AS n FROM @lead_events_v@),
    walk AS (SELECT DISTINCT lead_id, 0::bigint AS n, 'new_lead' AS status, 0::bigint AS applied, 0::bigint AS refused FROM e
      UNION ALL SELECT w.lead_id, e.n, CASE WHEN t.kind IS NULL OR leads_to = '=' THEN status ELSE leads_to END,
        applied + (t.kind IS NOT NULL)::int, refused + (t.kind IS NULL)::int
      FROM walk w JOIN e ON e.lead_id = w.lead_id AND e.n = w.n + 1 LEFT JOIN t ON t.kind = e.kind AND t.accepted IN ('*', w.status))
    SELECT w.lead_id, status, applied, refused, {stamp_sql('e.ts')} AS last_event_at FROM walk w JOIN e USING (lead_id, n)
    WHERE n = (SELECT max(n) FROM e x WHERE x.lead_id = w.lead_id)""",
)
INTERVALS_SQL = """SELECT min(ts) AS on_from, max(ts) + INTERVAL 24 HOUR AS on_until FROM (
    SELECT *, sum(fresh) OVER (ORDER BY ts, id) AS island FROM (SELECT *,
      CASE WHEN ts <= lag(ts) OVER (ORDER BY ts, id) + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS fresh
      FROM @error_log_v@ WHERE kill_switch)) GROUP BY island"""
register(
    "kill_switch",
    lambda v: events.kill_switch_intervals(v.error_log_v).select(*stamp("on_from", "on_until")),
    f"SELECT {stamp_sql('on_from')} AS on_from, {stamp_sql('on_until')} AS on_until FROM ({INTERVALS_SQL})",
)
register(
    "kill_switch_blocks",
    lambda v: events.while_switched_on(
        v.error_log_v.where("error_code = 'FOLLOW_UP'"), events.kill_switch_intervals(v.error_log_v, 3)
    ).select("id", "switched_on"),
    f"""SELECT id, EXISTS (SELECT 1 FROM ({INTERVALS_SQL.replace('24 HOUR', '3 HOUR')}) k WHERE ts BETWEEN on_from AND on_until) AS switched_on
    FROM @error_log_v@ WHERE error_code = 'FOLLOW_UP'""",
)
# the log is sparse, so the breaker is run with a window of a day
register(
    "failure_breaker",
    lambda v: events.failure_breaker(v.call_log_v, 5, 1440, 2880).select(
        "label", *stamp("opened_at", "closes_at")
    ),
    f"""WITH RECURSIVE c AS MATERIALIZED (SELECT label, ts, lag(ts, 4) OVER w AS started, bool_or(ok) OVER (w ROWS 4 PRECEDING) AS any_ok
      FROM @call_log_v@ WINDOW w AS (PARTITION BY label ORDER BY ts, event_id)),
    k AS MATERIALIZED (SELECT label, ts, started FROM c WHERE NOT any_ok AND ts - started < INTERVAL 1440 MINUTE),
    walk AS (SELECT label, min(ts) AS ts FROM k GROUP BY label UNION ALL
      SELECT w.label, n.ts FROM walk w JOIN LATERAL (SELECT min(k.ts) AS ts FROM k WHERE k.label = w.label
        AND k.started >= w.ts + INTERVAL 2880 MINUTE) n ON n.ts IS NOT NULL)
    SELECT label, {stamp_sql('ts')} AS opened_at, {stamp_sql('ts + INTERVAL 2880 MINUTE')} AS closes_at FROM walk""",
)

# ---- upkeep ---------------------------------------------------------------------

register(
    "latest_per_key",
    lambda v: tables.latest_per_key(v.error_log_v, ["lead_id"], ["ts", "id"]).select(
        "lead_id", "id", "error_code"
    ),
    """SELECT lead_id, id, error_code FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY ts DESC, id DESC) AS n
    FROM @error_log_v@) WHERE n = 1""",
)
HALF = "2024-01-15 00:00:00"
for op, first in [("upsert_latest", False), ("upsert_keep_first", True)]:
    register(
        op,
        lambda v, first=first: tables.upsert_latest(
            *(
                tables.latest_per_key(v.error_log_v.where(c), ["lead_id"], ["ts", "id"]).select(
                    "lead_id", "error_code", "id"
                )
                for c in (f"ts < TIMESTAMP '{HALF}'", f"ts >= TIMESTAMP '{HALF}' AND scenario = 'EMAIL_SENT'")
            ),
            ["lead_id"], "id", keep_first=first,
        ),
        f"""WITH o AS (SELECT lead_id, arg_max(error_code, (ts, id)) AS error_code, arg_max(id, (ts, id)) AS id FROM @error_log_v@
          WHERE ts < TIMESTAMP '{HALF}' GROUP BY lead_id),
        n AS (SELECT lead_id, arg_max(error_code, (ts, id)) AS error_code, arg_max(id, (ts, id)) AS id FROM @error_log_v@
          WHERE ts >= TIMESTAMP '{HALF}' AND scenario = 'EMAIL_SENT' GROUP BY lead_id)
        SELECT * FROM {'o' if first else 'n'} UNION ALL SELECT * FROM {'n' if first else 'o'} ANTI JOIN {'o' if first else 'n'} USING (lead_id)""",
    )
register(
    "retention",
    lambda v: tables.retention(
        v.error_log_v, "2024-01-30 12:00:00", 24, keep=F.col("scenario") == "EMAIL_SENT"
    ).select("id", "scenario"),
    """SELECT id, scenario FROM @error_log_v@ WHERE ts >= TIMESTAMP '2024-01-29 12:00:00' OR scenario = 'EMAIL_SENT'""",
)
__all__ = ["EVENTS_AS_OF"]
