"""Work queues, follow-ups, scan plans and their limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.keys import greeting_name, norm_email, norm_vrn, phone_e164
from leadloom.operators.signals import as_moment


def top_queue(df: DataFrame, order: Sequence[str], limit: int | None) -> DataFrame:
    """Highest score first, then oldest, then id; ``limit`` is the batch size."""
    score, *rest = order
    ordered = df.orderBy(F.desc_nulls_last(score), *map(F.asc, rest))
    return ordered if limit is None else ordered.limit(limit)


def is_queue_eligible(as_of: str, max_failures: int = 3, backoff_hours: int = 6) -> Column:
    now = as_moment(as_of)
    window, tried = F.col("next_outreach_window"), F.col("last_research_attempt_at")
    return (
        (F.col("status") == "new_lead")
        & ~F.col("locked")
        & (window.isNull() | (window <= now))
        & (F.col("research_failures") < max_failures)
        & (tried.isNull() | (tried <= now - F.expr(f"INTERVAL '{backoff_hours}' HOUR")))
    )


def work_queue(leads: DataFrame, as_of: str, batch: int | None = 5, **kw) -> DataFrame:
    return top_queue(
        leads.where(is_queue_eligible(as_of, **kw)), ["ch_pre_score", "created_at", "id"], batch
    )


def is_followup_eligible(as_of: str, min_days: int = 3) -> Column:
    cutoff = as_moment(as_of) - F.expr(f"INTERVAL '{min_days}' DAY")
    return (
        (F.col("status") == "outreach_sent")
        & ~F.col("reply_received")
        & (F.col("last_contacted_at") < cutoff)
        & F.col("follow_up_draft_id").isNull()
    )


def is_kill_switch(as_of: str, hours: int = 24) -> Column:
    return (
        (F.col("scenario") == "S8_Kill_Switch")
        & (F.col("error_code") == "KILL_SWITCH_ACTIVE")
        & F.col("kill_switch")
        & (F.col("ts") >= as_moment(as_of) - F.expr(f"INTERVAL '{hours}' HOUR"))
    )


def followup_eligible(
    leads: DataFrame, event_log: DataFrame, as_of: str, min_days: int = 3
) -> DataFrame:
    """Leads due for a follow-up; none while the kill switch is on."""
    switch = event_log.where(is_kill_switch(as_of)).agg(F.count("*").alias("fired"))
    return leads.where(is_followup_eligible(as_of, min_days) & (switch.scalar() == 0))


def followup_queue(due: DataFrame, as_of: str, batch: int | None = 5) -> DataFrame:
    days = F.floor(
        F.timestamp_diff("SECOND", F.col("last_contacted_at"), as_moment(as_of)) / 86400
    )
    queue = due.withColumns(
        {
            "days_since_contact": F.coalesce(days, F.lit(4)).cast("int"),
            "outcome": F.when(F.col("email").isNull(), "skipped_no_email").otherwise("queued"),
        }
    ).orderBy("last_contacted_at", "id")
    return queue if batch is None else queue.limit(batch)


def release_stale_locks(leads: DataFrame, as_of: str, minutes: int = 30) -> DataFrame:
    """Frees old or undated locks, then puts orphaned rows back in the queue."""
    cutoff = as_moment(as_of) - F.expr(f"INTERVAL '{minutes}' MINUTE")
    stale = F.col("locked") & (F.col("lock_at").isNull() | (F.col("lock_at") < cutoff))
    freed = leads.withColumns(
        {
            "released": stale,
            "locked": F.col("locked") & ~stale,
            "lock_at": F.when(~stale, F.col("lock_at")),
        }
    )
    orphan = (
        F.col("status").isin("enriching", "verifying")
        & ~F.col("locked")
        & (F.col("updated_at") < cutoff)
    )
    return freed.withColumns(
        {"recovered": orphan, "status": F.when(orphan, "new_lead").otherwise(F.col("status"))}
    )


def merge_contacts(leads: DataFrame, research: DataFrame, scrapes: DataFrame) -> DataFrame:
    """Contact fields by source precedence; both side tables hold one row per lead."""
    r, s = research.alias("r"), scrapes.alias("s")
    merged = (
        leads.alias("l")
        .join(r, F.col("r.lead_id") == F.col("l.id"), "left")
        .join(s, F.col("s.lead_id") == F.col("l.id"), "left")
    )
    phone = F.coalesce("s.phone", "r.phone", "l.phone")
    website = F.coalesce("r.website", "l.website_url")
    outcome = (
        F.when(website.isNull() | F.col("s.lead_id").isNull(), "skipped")
        .when(F.col("s.outcome") == "failed", "failed")
        .when(F.col("s.email").isNull(), "empty")
        .otherwise("ok")
    )
    usable = F.col("s.outcome") != "failed"
    return merged.select(
        F.col("l.id").alias("id"),
        norm_email(F.coalesce(F.when(usable, F.col("s.email")), "r.email", "l.email")).alias("email"),
        phone.alias("phone"),
        phone_e164(phone).alias("phone_e164"),
        F.coalesce("l.owner_name", "s.owner_name", "r.owner_name").alias("owner_name"),
        F.coalesce("s.description", "r.description", "l.description").alias("description"),
        website.alias("website_url"),
        outcome.alias("scrape_outcome"),
        F.col("l.scrape_attempts").alias("scrape_attempts"),
        greeting_name(F.coalesce("l.owner_name", "s.owner_name", "r.owner_name")).alias("greeting"),
    )


def no_email_route(merged: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Where a lead goes that still has no address after research and scraping."""
    no_site = F.col("website_url").isNull()
    failed = F.col("scrape_outcome") == "failed"
    attempts = F.when(~no_site & failed, F.col("scrape_attempts") + 1).otherwise(
        F.col("scrape_attempts")
    )
    spent = attempts >= max_attempts
    return merged.where(F.col("email").isNull()).select(
        "id",
        F.when(no_site, "no_email_no_website")
        .when(failed & spent, "no_email_scrape_failed_max_retries")
        .when(failed, "no_email_scrape_failed")
        .otherwise("no_email_scrape_empty")
        .alias("outcome"),
        F.when(~no_site & failed & ~spent, "new_lead").otherwise("exclude").alias("next_status"),
        attempts.cast("int").alias("scrape_attempts"),
    )


def research_retry(leads: DataFrame, research: DataFrame, max_failures: int = 3) -> DataFrame:
    failures = F.col("research_failures") + 1
    give_up = failures >= max_failures
    failed = research.where(~F.col("ok")).select(F.col("lead_id").alias("id"))
    return leads.join(failed, "id").select(
        "id",
        failures.cast("int").alias("research_failures"),
        F.when(give_up, "needs_review").otherwise("new_lead").alias("next_status"),
        F.when(give_up, "research_failed_max_retries")
        .otherwise("research_failed_will_retry")
        .alias("outcome"),
    )


def verification_score() -> Column:
    """0-100 from the results of a mail server probe."""
    mx, code = F.col("mx_valid"), F.col("smtp_code")
    probed = (
        F.when(code == 250, 20 + 50 + F.when(F.col("catch_all"), -20).otherwise(20))
        .when(code < 500, 20 + 10)
        .otherwise(20)
    )
    return F.when(~mx, 0).when(F.col("blocked"), 20).otherwise(probed).cast("int")


def tier(score: str = "brand_fit_score", tier1: int = 70, tier2: int = 50) -> Column:
    if tier1 <= tier2:
        raise ValueError("the threshold of tier 1 must lie above that of tier 2")
    s = F.col(score)
    return F.when(s >= tier1, "Tier1").when(s >= tier2, "Tier2").otherwise("Exclude")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "outcome")


# fixed values: digest sections
DIGEST = ["warm_replies", "pending_approvals", "tier2_drafts", "follow_ups", "top_leads"]


def daily_digest(leads: DataFrame, followups: DataFrame, top: int = 5) -> DataFrame:
    """Five top lists. A lead can be in several, so each row names its sections once."""
    waiting = F.col("status") == "waiting_concierge"
    replied = F.unix_micros(F.col("last_reply_at").cast("timestamp_ltz"))
    fit = F.col("brand_fit_score").cast("bigint")

    def entry(condition: Column, section: str, rank: Column) -> Column:
        return F.when(condition, F.struct(F.lit(section).alias("section"), rank.alias("rank")))

    sections = F.array(
        entry(F.col("status") == "interested", "warm_replies", replied),
        entry(waiting, "pending_approvals", fit),
        entry(waiting & (F.col("tier") == "Tier2"), "tier2_drafts", fit),
        entry(waiting | (F.col("status") == "outreach_sent"), "top_leads", fit),
    )
    listed = leads.select(
        "id", F.explode(F.filter(sections, lambda s: s.isNotNull())).alias("s")
    ).select("s.section", "s.rank", "id")
    queued = followups.where(F.col("queue_status") == "pending").select(
        F.lit("follow_ups").alias("section"),
        (-F.unix_micros(F.col("queued_at").cast("timestamp_ltz"))).alias("rank"),
        F.col("lead_id").alias("id"),
    )
    w = Window.partitionBy("section").orderBy(F.desc_nulls_last("rank"), "id")
    return (
        listed.unionByName(queued)
        .withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= top)
        .select("section", "place", "id")
    )


# ---- scanning ---------------------------------------------------------------

def sorted_codes(c: Column | str) -> Column:
    return F.array_join(F.array_sort(F.split(c, ",")), ",")


def cooldown(plan: DataFrame, runs: DataFrame, as_of: str, hours: int = 48) -> DataFrame:
    """Planned scans without a recent run of the same source, codes and region."""
    recent = (
        runs.where(F.col("ran_at") >= as_moment(as_of) - F.expr(f"INTERVAL '{hours}' HOUR"))
        .select("source", sorted_codes("query").alias("query"), "region")
        .distinct()
    )
    return plan.withColumn("query", sorted_codes("query")).join(
        recent, ["source", "query", "region"], "left_anti"
    )


def sweep_replay(
    scans: DataFrame,
    target: int = 50,
    max_attempts: int = 30,
    max_runtime_ms: int = 1_500_000,
    max_zero_streak: int = 3,
) -> DataFrame:
    """Which scans of a sweep ran, and why it stopped.

    A sweep never runs more than ``max_attempts`` scans, so all later rows of its log
    are pruned before the shuffle and every window below is small.
    """
    by_sweep = Window.partitionBy("sweep_id").orderBy("scan_ord")
    run = scans.withColumn("attempt", F.row_number().over(by_sweep)).where(
        F.col("attempt") <= max_attempts
    )
    so_far = by_sweep.rowsBetween(Window.unboundedPreceding, 0)
    counted = ~F.col("skipped") & ~F.col("failed")
    zero = counted & (F.col("new_leads") == 0)
    found = counted & (F.col("new_leads") > 0)
    run = run.withColumns(
        {
            "total_new": F.sum("new_leads").over(so_far).cast("int"),
            "elapsed_ms": F.sum("duration_ms").over(so_far),
            "island": F.sum(found.cast("int")).over(so_far),
        }
    )
    streak = F.sum(zero.cast("int")).over(
        Window.partitionBy("sweep_id", "island")
        .orderBy("scan_ord")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    run = run.withColumn("streak", streak.cast("int"))
    stop = (
        F.when(F.col("total_new") >= target, "target_hit")
        .when(F.col("attempt") >= max_attempts, "attempts_exhausted")
        .when(F.col("elapsed_ms") >= max_runtime_ms, "timeout")
        .when(F.col("streak") >= max_zero_streak, "consecutive_zero_yield")
    )
    run = run.withColumn("stop", stop)
    stopped_before = F.max(F.col("stop").isNotNull()).over(
        by_sweep.rowsBetween(Window.unboundedPreceding, -1)
    )
    run = run.withColumn("over", F.coalesce(stopped_before, F.lit(False)))
    return run.where(~F.col("over")).groupBy("sweep_id").agg(
        F.count("*").alias("attempts"),
        F.max("total_new").alias("total_new"),
        F.count_if("skipped").alias("skipped"),
        F.max("elapsed_ms").alias("elapsed_ms"),
        F.coalesce(F.max("stop"), F.lit("plan_exhausted")).alias("stop_reason"),
    )


def vat_status(leads: DataFrame, vat_register: DataFrame) -> DataFrame:
    """Registered true, false, or unknown for leads whose VAT number was not checked yet."""
    known = vat_register.select("vrn").distinct().withColumn("listed", F.lit(True))
    return (
        leads.where(F.col("vat_checked_on").isNull())
        .select("id", norm_vrn("vat_number").alias("vrn"))
        .join(known, "vrn", "left")
        .select(
            "id", "vrn",
            F.when(F.col("vrn").isNotNull(), F.coalesce("listed", F.lit(False))).alias("registered"),
        )
    )
