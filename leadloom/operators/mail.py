"""Mail: reply classification, matching to leads, the send log, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.functions.keys import first_group, norm_email, strip
from leadloom.operators.signals import as_moment


def _any(c: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | c.rlike(p)
    return hit


def sender(c: str = "from_email") -> Column:
    return F.lower(strip(c))


def is_bounce(subject: Column) -> Column:
    return _any(sender(), rules.BOUNCE_SENDER_PATTERNS) | _any(
        subject, rules.BOUNCE_SUBJECT_PATTERNS
    )


def auto_reason(subject: Column, body: Column) -> Column:
    """Name of the first auto-responder pattern that matches, else null."""
    reason = F.when(F.lit(False), "")
    for part, c, patterns in [
        ("subject", subject, rules.AUTO_SUBJECT_PATTERNS),
        ("body", body, rules.AUTO_BODY_PATTERNS),
    ]:
        for p in patterns:
            reason = reason.when(c.rlike(p), f"{part}:{p.removeprefix('(?i)')[:40]}")
    return reason


def bounced_address(body: Column | str) -> Column:
    found = [first_group(body, p) for p in rules.BOUNCED_ADDRESS_PATTERNS]
    return F.lower(F.coalesce(*found))


def classify_replies(messages: DataFrame) -> DataFrame:
    """Adds ``classification``, ``auto_reason`` and ``bounced_address``."""
    subject, body = F.coalesce("subject", F.lit("")), F.coalesce("text_body", F.lit(""))
    # One projection per step: each pattern is then evaluated once per message.
    return (
        messages.withColumn("_bounce", is_bounce(subject))
        .withColumn("auto_reason", F.when(~F.col("_bounce"), auto_reason(subject, body)))
        .withColumn("bounced_address", F.when(F.col("_bounce"), bounced_address(body)))
        .withColumn(
            "classification",
            F.when(F.col("_bounce"), "bounce")
            .when(F.col("auto_reason").isNotNull(), "auto_responder")
            .otherwise("real"),
        )
        .drop("_bounce")
    )


# ---- matching to leads -------------------------------------------------------

def _recency() -> Column:
    seen = F.col("last_contacted_at")
    return F.struct(seen.isNotNull(), seen, F.col("id"))


def leads_by_email(leads: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """One lead per inbox: the one contacted last. Reduced before any join."""
    rows = leads if statuses is None else leads.where(F.col("status").isin(statuses))
    return (
        rows.withColumn("inbox", norm_email("email"))
        .where(F.col("inbox").isNotNull())
        .groupBy("inbox")
        .agg(F.max_by(F.struct("id", "status"), _recency()).alias("lead"))
        .select("inbox", F.col("lead.id").alias("lead_id"), F.col("lead.status").alias("lead_status"))
    )


def reply_to_lead(messages: DataFrame, leads: DataFrame) -> DataFrame:
    index = leads_by_email(leads, rules.AWAITING_REPLY)
    return messages.withColumn("inbox", norm_email("from_email")).join(index, "inbox", "left")


def message_to_lead(sent: DataFrame, leads: DataFrame, followups: DataFrame) -> DataFrame:
    """The lead a sent mail belongs to: by draft, else conversation, else queued draft."""
    key = F.struct
    direct = leads.select(
        "id", "last_contacted_at",
        F.explode(
            F.filter(
                F.array(
                    key(F.lit(1).alias("rank"), F.col("draft_id").alias("key")),
                    key(F.lit(1).alias("rank"), F.col("follow_up_draft_id").alias("key")),
                    key(F.lit(2).alias("rank"), F.col("conversation_id").alias("key")),
                ),
                lambda e: e.key.isNotNull(),
            )
        ).alias("e"),
    ).select("id", "last_contacted_at", "e.rank", "e.key")
    queued = (
        followups.where(F.col("queue_status") == "pending")
        .select(
            F.col("lead_id").alias("id"), F.lit(None).cast("timestamp_ntz").alias("last_contacted_at"),
            F.lit(3).alias("rank"), F.col("draft_id").alias("key"),
        )
        .where(F.col("key").isNotNull())
    )
    index = (
        direct.unionByName(queued)
        .groupBy("rank", "key")
        .agg(F.max_by("id", _recency()).alias("lead_id"))
    )
    asked = sent.select(
        "notification_id",
        F.explode(
            F.array(
                key(F.lit(1).alias("rank"), F.col("message_id").alias("key")),
                key(F.lit(2).alias("rank"), F.col("conversation_id").alias("key")),
                key(F.lit(3).alias("rank"), F.col("message_id").alias("key")),
            )
        ).alias("e"),
    ).select("notification_id", "e.rank", "e.key")
    return (
        asked.where(F.col("key").isNotNull())
        .join(index, ["rank", "key"])
        .groupBy("notification_id")
        .agg(F.min(F.struct("rank", "lead_id")).alias("m"))
        .select("notification_id", F.col("m.rank").alias("matched_by"), "m.lead_id")
    )


def relevant_sent_items(sent: DataFrame, client_state: str) -> DataFrame:
    return sent.where(
        (F.col("client_state") == client_state)
        & F.col("change_type").isin("created", "updated")
        & ~F.col("is_draft")
    )


def reconcile_sent(
    sent: DataFrame,
    leads: DataFrame,
    followups: DataFrame,
    client_state: str,
    changed: DataFrame | None = None,
) -> DataFrame:
    """Status changes and send records for mail that was sent by hand.

    Only a lead still waiting changes, and only for its first message, so running this
    again over the same items changes nothing. ``changed`` names leads that an earlier
    run has changed since ``leads`` was written.
    """
    items = relevant_sent_items(sent, client_state)
    found = message_to_lead(items, leads, followups)
    first = (
        found.join(items, "notification_id")
        .groupBy("lead_id")
        .agg(
            F.min_by(
                F.struct("message_id", "sent_at", "from_addr", "subject"),
                F.struct("sent_at", "notification_id"),
            ).alias("m")
        )
    )
    waiting = leads.select(F.col("id").alias("lead_id"), "status").where(
        F.col("status").isin("waiting_concierge", "follow_up_queued")
    )
    if changed is not None:
        waiting = waiting.join(changed.select("lead_id"), "lead_id", "left_anti")
    outreach = F.col("status") == "waiting_concierge"
    return first.join(waiting, "lead_id").select(
        "lead_id",
        F.when(outreach, "outreach_sent").otherwise("follow_up_sent").alias("new_status"),
        F.when(outreach, "outreach").otherwise("follow_up").alias("direction"),
        "m.message_id",
        "m.sent_at",
        F.concat(F.lit("outlook-direct:"), F.coalesce("m.from_addr", F.lit("unknown"))).alias("sent_by"),
    )


def approval_outcome(followups: DataFrame, leads: DataFrame, suppression: DataFrame) -> DataFrame:
    """What approving each queued follow-up gives.

    A goodbye answers a refusal, so suppression does not stop it.
    """
    blocked = suppression.select(F.lower("email").alias("inbox")).distinct().withColumn(
        "blocked", F.lit(True)
    )
    goodbye = F.coalesce(F.col("reasoning").startswith("Hard no detected"), F.lit(False))
    rows = (
        followups.join(leads.select(F.col("id").alias("lead_id"), "email"), "lead_id", "left")
        .withColumn("inbox", F.lower("email"))
        .join(blocked, "inbox", "left")
        .withColumn("goodbye", goodbye)
    )
    return rows.select(
        "queue_id", "lead_id", "goodbye",
        F.when(F.col("queue_status") != "pending", "already_actioned")
        .when(~F.col("goodbye") & F.col("blocked"), "suppressed")
        .when(F.col("draft_id").isNull(), "missing_draft")
        .otherwise("ok")
        .alias("outcome"),
        F.when(F.col("goodbye"), "goodbye").otherwise("follow_up").alias("direction"),
    )


def reply_flow(messages: DataFrame, leads: DataFrame) -> DataFrame:
    """Classification, matched lead, suppression entry and new lead status per message."""
    classified = classify_replies(messages)
    bounce = F.col("classification") == "bounce"
    real = F.col("classification") == "real"
    address = F.when(bounce, F.col("bounced_address")).otherwise(F.col("from_email"))
    any_lead = leads_by_email(leads).select(
        "inbox", F.col("lead_id").alias("any_lead")
    )
    active = leads_by_email(leads, rules.AWAITING_REPLY).select(
        "inbox", F.col("lead_id").alias("active_lead"), "lead_status"
    )
    joined = (
        classified.withColumn("address", address)
        .withColumn("inbox", norm_email("address"))
        .join(any_lead, "inbox", "left")
        .join(active, "inbox", "left")
    )
    lead = F.when(bounce, F.col("any_lead")).otherwise(F.col("active_lead"))
    sentiment = F.coalesce("sentiment", F.lit("neutral"))
    status = (
        F.when(bounce, "verification_failed")
        .when(~real, F.col("lead_status"))
        .when(sentiment == "positive", "interested")
        .when(sentiment == "hard_no", "not_interested")
        .otherwise("needs_review")
    )
    return joined.select(
        "message_id", "received_at", "classification", "auto_reason", "inbox",
        lead.alias("lead_id"),
        F.when(lead.isNotNull(), status).alias("new_status"),
        F.when(bounce, "bounced").when(real, "replied").alias("suppress_as"),
    )


def suppress(existing: DataFrame, flow: DataFrame) -> DataFrame:
    """The suppression table after a batch: a bounce overwrites, a reply does not."""
    fresh = flow.where(F.col("suppress_as").isNotNull() & F.col("inbox").isNotNull()).select(
        F.col("inbox").alias("email"), F.col("suppress_as").alias("reason"), "lead_id",
        F.col("received_at").alias("created_at"), F.lit(1).alias("batch"),
        F.col("message_id").alias("source"),
    )
    old = existing.select(
        F.lower("email").alias("email"), "reason", "lead_id", "created_at",
        F.lit(0).alias("batch"), F.lit("").alias("source"),
    )
    order = F.struct("batch", "created_at", "source")
    bounced = F.when(F.col("reason") == "bounced", order)
    last_lead = F.when(F.col("lead_id").isNotNull(), order)
    return (
        old.unionByName(fresh)
        .groupBy("email")
        .agg(
            F.max(F.col("reason") == "bounced").alias("any_bounce"),
            F.min_by("reason", order).alias("first_reason"),
            F.max_by("lead_id", last_lead).alias("lead_id"),
            F.min("created_at").alias("created_at"),
        )
        .select(
            "email",
            F.when(F.col("any_bounce"), "bounced").otherwise(F.col("first_reason")).alias("reason"),
            "lead_id", "created_at",
        )
    )


# ---- the send log ------------------------------------------------------------

SEND_JSON = (
    "leadId string, direction string, subject string, bodyHash string, messageId string, "
    "sentAt string, sentBy string, wasEdited boolean, editSummary string"
)


def send_rows(event_log: DataFrame) -> DataFrame:
    """Send records from the log; entries that are not JSON are dropped."""
    p = F.from_json("message", SEND_JSON)
    return (
        event_log.where(F.col("scenario") == "EMAIL_SENT")
        .where(F.try_parse_json("message").isNotNull())
        .withColumn("p", p)
        .select(
            "id",
            F.coalesce("p.leadId", "lead_id", F.lit("")).alias("lead_id"),
            F.coalesce("p.direction", F.lower("error_code")).alias("direction"),
            F.coalesce("p.subject", F.lit("")).alias("subject"),
            F.coalesce("p.bodyHash", F.lit("")).alias("body_hash"),
            F.col("p.messageId").alias("message_id"),
            F.coalesce(F.try_to_timestamp("p.sentAt").cast("timestamp_ntz"), "ts").alias("sent_at"),
            F.coalesce("p.sentBy", F.lit("unknown")).alias("sent_by"),
            F.coalesce("p.wasEdited", F.lit(False)).alias("was_edited"),
            F.col("p.editSummary").alias("edit_summary"),
        )
    )


def lead_history(sends: DataFrame, limit: int = 20) -> DataFrame:
    """The newest sends of each lead."""
    w = Window.partitionBy("lead_id").orderBy(F.desc("sent_at"), F.desc("id"))
    return sends.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def recent_sends(sends: DataFrame, limit: int = 50) -> DataFrame:
    return sends.orderBy(F.desc("sent_at"), F.desc("id")).limit(limit)


# fixed values: what counts towards the daily cap
DIRECTIONS = ["OUTREACH", "FOLLOW_UP", "GOODBYE"]


def sends_by_day(event_log: DataFrame, daily_cap: int = 0) -> DataFrame:
    counts = {d.lower(): F.count_if(F.col("error_code") == d) for d in DIRECTIONS}
    total = F.count_if(F.col("error_code").isin(DIRECTIONS))
    return (
        event_log.where(F.col("scenario") == "EMAIL_SENT")
        .groupBy(F.to_date("ts").alias("day"))
        .agg(
            *(c.alias(n) for n, c in counts.items()),
            ((total >= daily_cap) & (F.lit(daily_cap) > 0)).alias("cap_reached"),
        )
    )


def is_bounce_code(c: str = "error_code") -> Column:
    code = F.col(c)
    return code.contains("550") | code.contains("551") | F.lower(code).contains("bounce")


def bounce_rate(
    event_log: DataFrame, leads: DataFrame, as_of: str, threshold: float = 5.0
) -> DataFrame:
    """Bounces logged in the last hour per lead contacted in it, and whether it fires."""
    now = as_moment(as_of)
    since = now - F.expr("INTERVAL '1' HOUR")
    bounces = event_log.where(F.col("ts").between(since, now)).agg(
        F.count_if(is_bounce_code()).alias("bounces")
    )
    sent = leads.where(F.col("last_contacted_at").between(since, now)).agg(
        F.count("*").alias("contacted")
    )
    rate = F.when(F.col("contacted") > 0, F.col("bounces") / F.col("contacted")).otherwise(0.0)
    return (
        bounces.withColumn("contacted", sent.scalar())
        .withColumn("rate", rate)
        .withColumn("fires", F.col("rate") * 100 > threshold)
    )


def next_bounces(event_log: DataFrame, within: str = "24 HOURS", bucket: str = "DAY") -> DataFrame:
    """``id, lead_id, sent_at, bounced``: each send, and whether its lead bounced in time.

    The first bounce after a send is looked for within a time bucket of the lead, and beyond it in the next
    bucket that has one, so no pair of rows is formed and a lead may hold any share of the log.
    """
    rows = event_log.select(
        "id", "lead_id", "ts", is_bounce_code().alias("bounce"), F.col("error_code").isin(DIRECTIONS).alias("sent")
    ).where("(bounce OR sent) AND lead_id IS NOT NULL").withColumn("bucket", F.date_trunc(bucket, "ts"))
    bounce_at = F.when(F.col("bounce"), F.col("ts"))
    # Bounces of a send's own moment count: at the same time all rows look ahead.
    ahead = Window.partitionBy("lead_id", "bucket").orderBy("ts").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    firsts = rows.groupBy("lead_id", "bucket").agg(F.min(bounce_at).alias("first"))
    later = Window.partitionBy("lead_id").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select("lead_id", "bucket", F.first("first", ignorenulls=True).over(later).alias("beyond"))
    bounced = F.coalesce(F.coalesce("inside", "beyond") <= F.col("ts") + F.expr(f"INTERVAL {within}"), F.lit(False))
    return (
        rows.withColumn("inside", F.min(bounce_at).over(ahead)).where("sent")
        .join(firsts, ["lead_id", "bucket"])
        .select("id", "lead_id", F.col("ts").alias("sent_at"), bounced.alias("bounced"))
    )


def cohort_bounce_rate(sends: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Sends of each hour and how many of these same sends bounced.

    ``sends`` has ``id, sent_at, bounced``; a send that stands in it several times counts once.
    """
    once = sends.groupBy("id", F.date_trunc("HOUR", "sent_at").alias("hour")).agg(F.max("bounced").alias("bounced"))
    n, bad = F.count(F.lit(1)), F.count_if("bounced")
    return once.groupBy("hour").agg(
        n.alias("sends"), bad.alias("bounced"), (bad / n).alias("rate"), (bad * 100 / n > threshold).alias("fires")
    )
