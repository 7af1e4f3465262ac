"""Event flows as streams; each has a batch twin in ``leadloom.operators``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.operators import mail
from leadloom.operators.events import KINDS, is_firing, transition_matrix
from leadloom.sources.buckets import BucketedTable, finished
from leadloom.sources.files import write_snapshot
from leadloom.streaming.replay import END, is_end, replay


def windowed_bounce_rate(
    log: DataFrame, threshold: float = 5.0, delay: str = "1 hour"
) -> DataFrame:
    """Bounces per send in each hour, every five minutes. Batch and stream alike."""
    rows = log.select(
        "ts", mail.is_bounce_code().alias("bounced"),
        F.col("error_code").isin(mail.DIRECTIONS).alias("sent"),
    ).where(F.col("bounced") | F.col("sent") | is_end())  # the end of a stream moves the watermark, its own hour never ends
    if log.isStreaming:
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp_ltz")).withWatermark("ts", delay)
    bounces, sends = F.count_if("bounced"), F.count_if("sent")
    rate: Column = F.when(sends > 0, bounces / sends).otherwise(0.0)
    return (
        rows.groupBy(F.window("ts", "1 hour", "5 minutes").alias("w"))
        .agg(bounces.alias("bounces"), sends.alias("sends"), rate.alias("rate"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "bounces", "sends", "rate", (F.col("rate") * 100 > threshold).alias("fires"),
        )
    )


def bounced_sends(log: DataFrame, within: str = "24 HOURS", delay: str = "1 hour") -> DataFrame:
    """``id, lead_id, sent_at, bounced`` as a stream: an interval join of the log's sends with its bounces.

    A send leaves with each bounce that follows it in time, or without one when the watermark has passed
    that time. State holds the sends and bounces of one interval. ``mail.cohort_bounce_rate`` makes rates of the rows.
    """
    timed = log.withColumn("ts", F.col("ts").cast("timestamp_ltz"))
    end = F.col("ts") == F.lit(END).cast("timestamp_ltz")
    lead = F.coalesce("lead_id", F.lit(""))  # the end marker has none, and a join drops null keys before the watermark
    sends = timed.where((F.col("error_code").isin(mail.DIRECTIONS) & F.col("lead_id").isNotNull()) | end).select("id", lead.alias("lead_id"), F.col("ts").alias("sent_at"))
    bounces = timed.where(mail.is_bounce_code() | end).select(lead.alias("bounced_lead"), F.col("ts").alias("bounced_at"))
    follows = F.expr(f"lead_id = bounced_lead AND bounced_at >= sent_at AND bounced_at <= sent_at + INTERVAL {within}")
    joined = sends.withWatermark("sent_at", delay).join(bounces.withWatermark("bounced_at", delay), follows, "left_outer")
    # A filter on the event time stays above the watermark, so the end marker gets there.
    return joined.where(F.col("sent_at") < F.lit(END).cast("timestamp_ltz")).select("id", "lead_id", "sent_at", F.col("bounced_at").isNotNull().alias("bounced"))


def lead_state_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A row with the new status of a lead after each of its events, in time order."""
    statuses, kinds, table = rules.LEAD_STATUSES, KINDS, transition_matrix()

    def step(memo, when: int, kind: str):
        state, applied, refused = memo or [0, 0, 0]
        nxt = table[kinds.index(kind) * len(statuses) + state] if kind in kinds else -1
        if nxt >= 0:
            state, applied = nxt, applied + 1
        else:
            refused += 1
        return [state, applied, refused], [(statuses[state], applied, refused, when)]

    return replay(
        events, "lead_id", step,
        "lead_id string, status string, applied long, refused long, at long", delay,
    )


def failure_breaker_stream(
    calls: DataFrame,
    threshold: int = 5,
    window_minutes: int = 5,
    cooldown_minutes: int = 10,
    delay: str = "1 hour",
) -> DataFrame:
    """A row each time the breaker of a label opens. At most ``threshold`` times are held."""
    window, cool = window_minutes * 60_000_000, cooldown_minutes * 60_000_000

    def step(memo, when: int, kind: str):
        failures, closes = memo or [[], 0]
        if when < closes:
            return [failures, closes], []
        if closes:
            failures, closes = [], 0
        if kind == "ok":
            return [[], 0], []
        failures = [t for t in failures if when - t < window] + [when]
        if len(failures) < threshold:
            return [failures, 0], []
        return [[], when + cool], [(when, when + cool)]

    events = calls.withColumn("kind", F.when(F.col("ok"), "ok").otherwise("failure"))
    return replay(events, "label", step, "label string, opened_at long, closes_at long", delay)


def trip_candidates_stream(calls: DataFrame, threshold: int = 5, window_minutes: int = 5, bucket_s: int = 3600, delay: str = "1 hour") -> DataFrame:
    """``part, at, started, event_id``: a row for each run of ``threshold`` failures inside the window.

    A run is found in a time bucket of its label that also sees the last window of the bucket before, so a
    busy label is many groups. ``own_candidates`` takes each run once and ``events.chained_trips`` finds those that open the breaker.
    ``event_id`` numbers the events of a bucket in order.
    """
    window, bucket = window_minutes * 60_000_000, bucket_s * 1_000_000

    def step(memo, when: int, kind: str):
        failures, n = memo or [[], 0]
        failures = [] if kind == "ok" else [*failures, when][-threshold:]
        trips = len(failures) == threshold and when - failures[0] < window
        return [failures, n + 1], [(when, failures[0], n)] if trips else []

    at = F.unix_micros(F.col("ts").cast("timestamp_ltz"))
    first, last = F.floor(at / bucket).cast("long"), F.floor((at + window) / bucket).cast("long")
    spread = calls.withColumn("seen_in", F.explode(F.sequence(first, F.least(last, first + 1))))
    parts = spread.withColumn("part", F.concat(F.col("seen_in").cast("string"), F.lit("|"), "label"))
    parts = parts.withColumn("kind", F.when(F.col("ok"), "ok").otherwise("failure"))
    return replay(parts, "part", step, "part string, at long, started long, event_id long", delay)


def own_candidates(found: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """``label, at, started, event_id`` of runs that end in the bucket that found them."""
    rows = found.withColumn("seen_in", F.substring_index("part", "|", 1).cast("long"))
    own = rows.where(F.floor(F.col("at") / (bucket_s * 1_000_000)) == F.col("seen_in"))
    return own.select(F.expr("substring(part, instr(part, '|') + 1)").alias("label"), "at", "started", "event_id")


def lock_expiry_stream(events: DataFrame, minutes: int = 30, delay: str = "1 hour") -> DataFrame:
    """A row when a lock outlives its time; ``kind`` is lock or unlock."""
    life = minutes * 60_000_000

    def step(memo, when: int, kind: str):
        rows = [(memo, memo + life)] if memo is not None and when > memo + life else []
        return (when if kind == "lock" else None), rows

    def due(memo, mark: int):
        if memo is not None and mark > memo + life:
            return None, [(memo, memo + life)], None
        return memo, [], None if memo is None else memo + life

    return replay(
        events, "lead_id", step, "lead_id string, locked_at long, expired_at long", delay, due
    )


def kill_switch_hours(event_log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first and last firing of each hour, once the hour is over. Batch and stream alike.

    Firings are reduced where they are read, so no task sees all of them. ``switch_intervals``
    makes intervals of the hours.
    """
    fires = event_log.where(is_firing() | is_end()).select("ts")
    if event_log.isStreaming:
        fires = fires.withColumn("ts", F.col("ts").cast("timestamp_ltz")).withWatermark("ts", delay)
    return (
        fires.groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        .select("first", "last")
    )


def reply_stream(messages: DataFrame, leads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Classified and matched replies. A message delivered again is dropped."""
    timed = messages.withColumn("received_at", F.col("received_at").cast("timestamp_ltz"))
    once = timed.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["message_id"])
    return mail.reply_flow(once, leads)


#: Schema of a suppression table.
SUPPRESSION = "email string, reason string, lead_id string, created_at timestamp_ntz"


def suppression_table(target: str, buckets: int = 256) -> BucketedTable:
    """The table that ``suppression_sink`` keeps; ``read`` gives its newest version."""
    return BucketedTable(target, "email", SUPPRESSION, buckets)


def suppression_sink(existing: str, target: str, buckets: int = 256):
    """A ``foreachBatch`` function that upserts each batch into a suppression table.

    The first batch takes over ``existing``; later ones rewrite only the buckets of their own addresses. A batch that is
    run again is skipped if it was committed; what a write that died has left is replaced.
    """
    table = suppression_table(target, buckets)

    def write(flow: DataFrame, batch_id: int) -> None:
        base = None if batch_id else flow.sparkSession.read.parquet(existing)
        fresh = flow.where(F.col("suppress_as").isNotNull() & F.col("inbox").isNotNull()).select(
            "message_id", F.col("received_at").cast("timestamp_ntz").alias("received_at"), "inbox", "suppress_as", "lead_id"
        )
        table.merge(batch_id, fresh, F.col("inbox"), mail.suppress, base)

    return write


def sent_items_sink(leads: str, followups: str, target: str, client_state: str, buckets: int = 256):
    """A ``foreachBatch`` function that writes the lead changes of each batch to ``target/batch=<id>``.

    Leads changed by an earlier batch are no longer waiting and do not change again. Their ids are kept in
    buckets, of which a batch reads those of the leads it has found.
    """
    done = BucketedTable(f"{target}/_changed", "lead_id", "lead_id string", buckets)

    def write(items: DataFrame, batch_id: int) -> None:
        spark, out = items.sparkSession, f"{target}/batch={batch_id}"
        if done.committed(spark, batch_id):
            return
        if not finished(spark, out):
            found = f"{target}/_found/v{batch_id}"
            changes = mail.reconcile_sent(items, spark.read.parquet(leads), spark.read.parquet(followups), client_state)
            write_snapshot(changes, found, unfinished=True)
            changes = spark.read.schema(changes.schema).parquet(found)
            known = done.beside(changes, F.col("lead_id"), batch_id - 1)
            write_snapshot(changes.join(known, "lead_id", "left_anti"), out, unfinished=True)
        new = spark.read.schema(done.schema).parquet(out)
        done.merge(batch_id, new, F.col("lead_id"), DataFrame.unionByName)

    return write
