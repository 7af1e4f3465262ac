"""Event replay: lead status, kill-switch intervals, failure breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.session import written

KINDS = list(dict.fromkeys(k for k, _, _ in rules.LEAD_TRANSITIONS))


def transition_matrix() -> list[int]:
    """Next status number for every (kind, status), row by row; -1 is a refusal."""
    number = {s: i for i, s in enumerate(rules.LEAD_STATUSES)}
    matrix = []
    for kind in KINDS:
        row = [-1] * len(number)
        for k, accepted, leads_to in rules.LEAD_TRANSITIONS:
            for status, i in number.items():
                if k == kind and accepted in ("*", status):
                    row[i] = i if leads_to == "=" else number[leads_to]
        matrix.extend(row)
    return matrix


def _after(state: Column, kind: Column) -> Column:
    """Next status number, or -1 when the event is not accepted."""
    table = F.array(*map(F.lit, transition_matrix()))
    at = (kind - 1) * len(rules.LEAD_STATUSES) + state
    return F.when(kind > 0, F.get(table, at)).otherwise(-1)


def _step(run: Column, kind: Column) -> Column:
    nxt = _after(run["state"], kind)
    return F.struct(
        F.when(nxt >= 0, nxt).otherwise(run["state"]).cast("int").alias("state"),
        (run["applied"] + (nxt >= 0).cast("long")).alias("applied"),
        (run["refused"] + (nxt < 0).cast("long")).alias("refused"),
    )


#: Events, or effects, that are put together in one row of an aggregate.
FOLD = 256


def lead_state(
    events: DataFrame, start: str = "new_lead", partitions: int | None = None, fold: int = FOLD
) -> DataFrame:
    """Status of each lead after all its events, oldest first.

    One lead may own a third of all events, so its history is not folded in one place. What a run of
    events does to every possible status is a small map, and maps compose in any grouping. Events are
    range-partitioned by (lead, time) and numbered within a partition; runs of ``fold`` events
    become maps, runs of ``fold`` maps become one, level by level, until a lead has one. No row
    ever gathers more than ``fold`` entries.
    """
    spark = events.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    placed = written(
        events.select("lead_id", "ts", "event_id", kind.alias("kind"))
        .repartitionByRange(n, "lead_id", "ts", "event_id")
        .withColumn("stretch", F.spark_partition_id().cast("long")),
        "lead-events",
    )
    count = len(rules.LEAD_STATUSES)
    fresh = F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda s: F.struct(
            s.cast("int").alias("state"),
            F.lit(0).cast("long").alias("applied"),
            F.lit(0).cast("long").alias("refused"),
        ),
    )
    in_order = Window.partitionBy("lead_id", "stretch").orderBy("ts", "event_id")
    maps = (
        placed.withColumn("pos", F.row_number().over(in_order) - 1)
        .groupBy("lead_id", "stretch", F.floor(F.col("pos") / fold).alias("run"))
        .agg(
            F.aggregate(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind"))), lambda e: e["kind"]),
                fresh,
                lambda runs, kind: F.transform(runs, lambda r: _step(r, kind)),
            ).alias("effect"),
            F.max("ts").alias("last_ts"),
        )
    )

    def chained(runs: Column, entry: Column) -> Column:
        def after(run: Column) -> Column:
            effect = F.get(entry["effect"], run["state"])
            return F.struct(
                effect["state"].alias("state"),
                (run["applied"] + effect["applied"]).alias("applied"),
                (run["refused"] + effect["refused"]).alias("refused"),
            )

        return F.transform(runs, after)

    def composed(maps: DataFrame, *keys: str | Column) -> DataFrame:
        """One map for all maps of the same keys, in the order of ``run``."""
        together = F.aggregate(F.array_sort(F.collect_list(F.struct("run", "effect"))), fresh, chained)
        return maps.groupBy(*keys).agg(together.alias("effect"), F.max("last_ts").alias("last_ts"))

    def levels(maps: DataFrame, *keys: str) -> DataFrame:
        """A tree over ``run``: its numbers are divided until one is left."""
        maps = written(maps, "effects")
        while maps.where("run > 0").limit(1).count():
            maps = composed(maps.withColumn("up", F.floor(F.col("run") / fold)), *keys, "up").withColumnRenamed("up", "run")
            maps = written(maps, "effects")
        return maps.drop("run")

    stretches = levels(maps, "lead_id", "stretch").withColumnRenamed("stretch", "run")
    whole = levels(stretches, "lead_id")
    names = F.array(*map(F.lit, rules.LEAD_STATUSES))
    r = F.get("effect", F.lit(rules.LEAD_STATUSES.index(start)))
    return whole.select(
        "lead_id", F.get(names, r["state"]).alias("status"), r["applied"].alias("applied"), r["refused"].alias("refused"),
        F.col("last_ts").alias("last_event_at"),
    )


# ---- kill switch -------------------------------------------------------------


def is_firing() -> Column:
    """Whether a row of the event log is a firing of the kill switch."""
    return (
        (F.col("scenario") == "S8_Kill_Switch")
        & (F.col("error_code") == "KILL_SWITCH_ACTIVE")
        & F.col("kill_switch")
    )


def kill_switch_intervals(event_log: DataFrame, hours: int = 24) -> DataFrame:
    """When the switch was on: each firing holds for a day, overlaps are merged.

    Firings of one hour always overlap, so they are first reduced to their ends.
    """
    hourly = event_log.where(is_firing()).groupBy(F.date_trunc("HOUR", "ts").alias("hour")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    return switch_intervals(hourly.select("first", "last"), hours)


def switch_intervals(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """Intervals from the first and last firing of each hour.

    What the single window sees is bounded by the hours the log spans.
    """
    span = F.expr(f"INTERVAL '{hours}' HOUR")
    w = Window.orderBy("first")
    starts = F.coalesce(F.col("first") > F.lag("last").over(w) + span, F.lit(True))
    return (
        hourly.withColumn("starts", starts)
        .withColumn("island", F.sum(F.col("starts").cast("int")).over(w))
        .groupBy("island")
        .agg(F.min("first").alias("on_from"), (F.max("last") + span).alias("on_until"))
        .drop("island")
    )


def while_switched_on(rows: DataFrame, intervals: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds ``switched_on``. Intervals meet rows by the days they touch.

    One row per day the log spans is broadcast, whatever the number of firings.
    """
    days = intervals.select(
        F.explode(F.sequence(F.to_date("on_from"), F.to_date("on_until"))).alias("day"),
        "on_from", "on_until",
    )
    per_day = days.groupBy("day").agg(F.collect_list(F.struct("on_from", "on_until")).alias("spans"))
    inside = F.exists("spans", lambda s: (F.col(ts) >= s.on_from) & (F.col(ts) <= s.on_until))
    return (
        rows.withColumn("day", F.to_date(ts))
        .join(F.broadcast(per_day), "day", "left")
        .withColumn("switched_on", F.coalesce(inside, F.lit(False)))
        .drop("day", "spans")
    )


# ---- failure breaker ----------------------------------------------------------


def _trip_candidates(
    calls: DataFrame, threshold: int, window_s: int, bucket_s: int
) -> DataFrame:
    """Failures that end a run of ``threshold`` failures inside the window.

    Such a run lies within one window length, so it is found inside a time bucket that
    also sees the last window of the bucket before. A busy label is thereby spread
    over many tasks.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp_ltz"))
    rows = calls.select("label", "event_id", "ok", micros.alias("at")).withColumn(
        "bucket", F.floor(F.col("at") / (bucket_s * 1_000_000)).cast("long")
    )
    late = F.col("at") >= (F.col("bucket") + 1) * (bucket_s * 1_000_000) - window_s * 1_000_000
    seen_in = F.when(late, F.array("bucket", F.col("bucket") + 1)).otherwise(F.array("bucket"))
    spread = rows.withColumn("seen_in", F.explode(seen_in))
    order = Window.partitionBy("label", "seen_in").orderBy("at", "event_id")
    run = order.rowsBetween(-(threshold - 1), 0)
    return (
        spread.withColumns(
            {
                "started": F.lag("at", threshold - 1).over(order) if threshold > 1 else F.col("at"),
                "any_ok": F.max("ok").over(run),
            }
        )
        .where(
            (F.col("bucket") == F.col("seen_in"))
            & ~F.col("any_ok")
            & (F.col("at") - F.col("started") < window_s * 1_000_000)
        )
        .select("label", "bucket", "at", "started", "event_id")
    )


def _next_trips(candidates: DataFrame, cool: int, bucket: int) -> DataFrame:
    """``label, at, event_id`` of each candidate and the candidate that trips next if this one does (``next``).

    That is the first one whose run begins when this one has cooled down. Both are put into time buckets; within
    a bucket a window looks ahead, and beyond it the first candidate of the next bucket that has one counts.
    """
    def row(time: Column, is_target: int) -> DataFrame:
        return candidates.select("label", "at", "event_id", time.alias("time"), F.lit(is_target).alias("target"))

    rows = row(F.col("at") + cool, 0).unionByName(row(F.col("started"), 1)).withColumn("slot", F.floor(F.col("time") / bucket))
    # Backwards in time: a frame that grows is kept up row by row, one that shrinks is read anew for each row.
    back = [F.col(c).desc() for c in ("time", "target", "at", "event_id")]
    ahead = Window.partitionBy("label", "slot").orderBy(*back).rowsBetween(Window.unboundedPreceding, 0)
    this = F.struct("at", "event_id")
    inside = rows.withColumn("inside", F.last(F.when(F.col("target") == 1, this), ignorenulls=True).over(ahead)).where("target = 0")
    firsts = rows.groupBy("label", "slot").agg(F.min(F.when(F.col("target") == 1, F.struct("time", "at", "event_id"))).alias("first"))
    later = Window.partitionBy("label").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("label", "slot", F.last("first", ignorenulls=True).over(later).alias("beyond"))
    beyond = F.when(F.col("beyond").isNotNull(), F.struct("beyond.at", "beyond.event_id"))
    return inside.join(firsts, ["label", "slot"]).select("label", "at", "event_id", F.coalesce("inside", beyond).alias("next"))


def failure_breaker(
    calls: DataFrame, threshold: int = 5, window_minutes: int = 5, cooldown_minutes: int = 10
) -> DataFrame:
    """Intervals during which the breaker of each label was open.

    Calls logged while it is open count for nothing, and it starts afresh afterwards. Each trip decides
    the next one, a chain as long as the label's history. It is followed by doubling: pointers to the next trip are joined
    with themselves, so after k rounds they reach 2^k trips ahead, and all trips are found in a logarithm of
    rounds, however many events one label holds.
    """
    window_s, cool = window_minutes * 60, cooldown_minutes * 60_000_000
    bucket_s = max(3600, window_s)
    return chained_trips(_trip_candidates(calls, threshold, window_s, bucket_s), cool, bucket_s * 1_000_000)


def chained_trips(candidates: DataFrame, cool: int, bucket: int) -> DataFrame:
    """The trips among ``label, at, started, event_id`` of all runs of failures, times in microseconds."""
    candidates = written(candidates.select("label", "at", "started", "event_id"), "candidates")
    jumps = written(_next_trips(candidates, cool, bucket).where("next IS NOT NULL"), "jumps")
    trips = candidates.groupBy("label").agg(F.min(F.struct("at", "event_id")).alias("t")).select("label", "t.at", "t.event_id")
    trips = written(trips, "trips")
    node = ["label", "at", "event_id"]
    while True:
        reached = trips.join(jumps, node).select("label", "next.at", "next.event_id")
        found = written(trips.unionByName(reached).distinct(), "trips")
        # What no jump leaves any more has been followed to its end.
        if found.count() == trips.count():
            break
        trips = found
        two = jumps.select("label", F.col("at").alias("from_at"), F.col("event_id").alias("from_id"), "next.at", "next.event_id")
        two = two.join(jumps, node).select("label", F.col("from_at").alias("at"), F.col("from_id").alias("event_id"), "next")
        jumps = written(two, "jumps")
    return trips.select(
        "label",
        F.timestamp_micros("at").cast("timestamp_ntz").alias("opened_at"),
        F.timestamp_micros(F.col("at") + cool).cast("timestamp_ntz").alias("closes_at"),
    )


def expired_locks(events: DataFrame, until: Column, minutes: int = 30, bucket: str = "HOUR") -> DataFrame:
    """Locks that no other event of the lead followed in time, up to a moment.

    The next event of a lead is looked for within its time bucket; the last one of a bucket takes the
    first moment of the next bucket that has one. So a lead may hold any share of the events.
    """
    life = F.expr(f"INTERVAL '{minutes}' MINUTE")
    placed = events.withColumn("bucket", F.date_trunc(bucket, "ts"))
    inside = F.lead("ts").over(Window.partitionBy("lead_id", "bucket").orderBy("ts", "event_id"))
    firsts = placed.groupBy("lead_id", "bucket").agg(F.min("ts").alias("first"))
    firsts = firsts.select("lead_id", "bucket", F.lead("first").over(Window.partitionBy("lead_id").orderBy("bucket")).alias("beyond"))
    return (
        placed.withColumn("inside", inside)
        .where(F.col("kind") == "lock")
        .join(firsts, ["lead_id", "bucket"])
        .withColumns({"next_ts": F.coalesce("inside", "beyond"), "expired_at": F.col("ts") + life})
        .where(
            (F.col("next_ts") > F.col("expired_at"))
            | (F.col("next_ts").isNull() & (F.col("expired_at") < until))
        )
        .select("lead_id", F.col("ts").alias("locked_at"), "expired_at")
    )
