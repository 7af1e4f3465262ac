"""Streams give what the batch operators give, whatever order events arrive in."""

import datetime
import random
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leadloom.operators import events, mail
from leadloom.sources.files import write_snapshot
from leadloom.streaming import flows
from leadloom.streaming.replay import late_events, replay, run_available, run_closed

BASE = datetime.datetime(2024, 1, 1)


def arrive(spark, rows, schema, files=4, last=None):
    """A file stream in which rows come shuffled within an hour, several files in turn."""
    folder = tempfile.mkdtemp(prefix="leadloom-in-")
    rnd = random.Random(0)
    order = sorted(rows, key=lambda r: r[1] + datetime.timedelta(minutes=rnd.randint(0, 50)))
    size = -(-len(order) // files)
    parts = [order[i : i + size] for i in range(0, len(order), size)]
    if last is not None:  # a late tail moves the watermark past every event
        parts.append([last])
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    files_ = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return files_.parquet(f"{folder}/*")


def lead_events(n=300):
    rnd = random.Random(7)
    return [
        (i, BASE + datetime.timedelta(minutes=rnd.randint(0, 2000)), f"L{rnd.randint(0, 5)}", rnd.choice([*events.KINDS, "junk"]))
        for i in range(n)
    ]


SCHEMA = "event_id long, ts timestamp_ntz, lead_id string, kind string"
TAIL = (10_000, BASE + datetime.timedelta(days=30), "tail", "junk")


def test_lead_state(spark):
    rows = lead_events()
    got = (
        run_available(flows.lead_state_stream(arrive(spark, rows, SCHEMA, last=TAIL)))
        .groupBy("lead_id")
        .agg(F.max_by(F.struct("status", "applied", "refused"), F.col("applied") + F.col("refused")).alias("r"))
        .select("lead_id", "r.*")
    )
    batch = events.lead_state(spark.createDataFrame(rows, SCHEMA), partitions=7)
    want = batch.select("lead_id", "status", "applied", "refused")
    assert {tuple(r) for r in got.collect() if r.lead_id != "tail"} == {tuple(r) for r in want.collect()}
    alone = events.lead_state(spark.createDataFrame(rows, SCHEMA), partitions=1)
    assert {tuple(r) for r in batch.collect()} == {tuple(r) for r in alone.collect()}


def breaker(calls, threshold, window, cool):
    """The breaker one call at a time."""
    out, failures, closes = set(), {}, {}
    for _, ts, label, ok in sorted(calls, key=lambda c: (c[1], c[0])):
        if ts < closes.get(label, BASE - datetime.timedelta(1)):
            continue
        if closes.pop(label, None):
            failures[label] = []
        if ok:
            failures[label] = []
            continue
        failures[label] = [t for t in failures.get(label, []) if ts - t < window] + [ts]
        if len(failures[label]) >= threshold:
            closes[label] = ts + cool
            out.add((label, ts))
    return out


@pytest.mark.parametrize("seed, fail", [(1, 0.7), (2, 0.95), (3, 1.0)])
def test_failure_breaker(spark, seed, fail):
    rnd = random.Random(seed)
    calls = [
        (i, BASE + datetime.timedelta(seconds=rnd.randint(0, 30_000)), rnd.choice("ab"), rnd.random() > fail)
        for i in range(1500)
    ]
    want = breaker(calls, 5, datetime.timedelta(minutes=5), datetime.timedelta(minutes=10))
    df = spark.createDataFrame(calls, "event_id long, ts timestamp_ntz, label string, ok boolean")
    got = {(r.label, r.opened_at) for r in events.failure_breaker(df).collect()}
    assert got == want and want


def test_failure_breaker_stream(spark):
    rnd = random.Random(4)
    schema = "event_id long, ts timestamp_ntz, label string, ok boolean"
    calls = [
        (i, BASE + datetime.timedelta(seconds=rnd.randint(0, 30_000)), rnd.choice("ab"), rnd.random() > 0.9)
        for i in range(600)
    ]
    tail = (10_000, BASE + datetime.timedelta(days=30), "tail", True)
    out = run_available(flows.failure_breaker_stream(arrive(spark, calls, schema, last=tail)))
    got = {(r.label, r.at) for r in out.select("label", F.timestamp_micros("opened_at").cast("timestamp_ntz").alias("at")).collect()}
    assert got == breaker(calls, 5, datetime.timedelta(minutes=5), datetime.timedelta(minutes=10))


def test_bounce_rate(spark):
    rnd = random.Random(5)
    schema = "id long, ts timestamp_ntz, error_code string"
    rows = [
        (i, BASE + datetime.timedelta(minutes=rnd.randint(0, 600)), rnd.choice(["SMTP_550", "OUTREACH", "FOLLOW_UP", "x"]))
        for i in range(200)
    ]
    tail = (10_000, BASE + datetime.timedelta(days=30), "OUTREACH")
    got = run_available(flows.windowed_bounce_rate(arrive(spark, rows, schema, last=tail)))
    want = flows.windowed_bounce_rate(spark.createDataFrame(rows, schema))
    day = lambda df: {tuple(r)[2:] + (str(r.window_start),) for r in df.collect()}
    assert day(got) == day(want)


def test_suppression_sink_is_idempotent(spark):
    folder = tempfile.mkdtemp(prefix="leadloom-sup-")
    old = "email string, reason string, lead_id string, created_at timestamp_ntz"
    write_snapshot(
        spark.createDataFrame([("A@x.com", "manual", None, BASE), ("b@x.com", "replied", None, BASE)], old), f"{folder}/old"
    )
    flow = spark.createDataFrame(
        [("m1", BASE, "a@x.com", "replied", None), ("m2", BASE, "b@x.com", "bounced", "L1"), ("m3", BASE, "c@x.com", "replied", "L2")],
        "message_id string, received_at timestamp_ntz, inbox string, suppress_as string, lead_id string",
    )
    sink = flows.suppression_sink(f"{folder}/old", folder)
    sink(flow, 0)
    sink(flow, 0)  # the same batch again
    got = {(r.email, r.reason, r.lead_id) for r in spark.read.parquet(f"{folder}/v0").collect()}
    assert got == {("a@x.com", "manual", None), ("b@x.com", "bounced", "L1"), ("c@x.com", "replied", "L2")}


def test_suppression_batches_equal_one(spark):
    folder = tempfile.mkdtemp(prefix="leadloom-sups-")
    old = spark.createDataFrame([("A@x.com", "manual", None, BASE)], flows.SUPPRESSION)
    write_snapshot(old, f"{folder}/old")
    rnd = random.Random(3)
    rows = [
        (f"m{i:03d}", BASE + datetime.timedelta(minutes=i), f"{rnd.choice('abcdefgh')}@x.com", rnd.choice(["replied", "bounced", None]), rnd.choice([None, "L1", "L2"]))
        for i in range(60)
    ]
    schema = "message_id string, received_at timestamp_ntz, inbox string, suppress_as string, lead_id string"
    sink = flows.suppression_sink(f"{folder}/old", f"{folder}/table", 4)
    for n in range(4):
        sink(spark.createDataFrame(rows[n * 15 : n * 15 + 15], schema), n)
    table = flows.suppression_table(f"{folder}/table", 4)
    want = {tuple(r) for r in mail.suppress(old, spark.createDataFrame(rows, schema)).collect()}
    assert table.latest(spark) == 3 and {tuple(r) for r in table.read(spark).collect()} == want


def test_sent_items_change_a_lead_once(spark, sf_dir):
    from leadloom.sources.views import view

    folder = tempfile.mkdtemp(prefix="leadloom-sent-")
    write_snapshot(view(spark, sf_dir, "leads_v"), f"{folder}/leads")
    write_snapshot(view(spark, sf_dir, "followups_v"), f"{folder}/followups")
    sent = view(spark, sf_dir, "sent_items_v")
    sink = flows.sent_items_sink(f"{folder}/leads", f"{folder}/followups", f"{folder}/out", "secret")
    early = sent.where("sent_at < TIMESTAMP '1998-06-01'")
    sink(early, 0)
    sink(sent.where("sent_at >= TIMESTAMP '1998-06-01'"), 1)
    got = [r.lead_id for r in spark.read.parquet(f"{folder}/out/batch=*").collect()]
    leads, queue = spark.read.parquet(f"{folder}/leads"), spark.read.parquet(f"{folder}/followups")
    want = [r.lead_id for r in mail.reconcile_sent(sent, leads, queue, "secret").collect()]
    assert len(got) == len(set(got)) and set(got) == set(want) and want


def test_closed_streams_equal_the_batch(spark):
    """No tail follows the events: the end marker fires the timers and closes the windows."""
    rows = lead_events(200)
    got = run_closed(flows.lead_state_stream, arrive(spark, rows, SCHEMA))
    last = got.groupBy("lead_id").agg(F.max_by(F.struct("status", "applied", "refused"), F.col("applied") + F.col("refused")).alias("r"))
    want = events.lead_state(spark.createDataFrame(rows, SCHEMA)).select("lead_id", "status", "applied", "refused")
    assert {tuple(r) for r in last.select("lead_id", "r.*").collect()} == {tuple(r) for r in want.collect()}

    locks = [(i, t, who, "lock" if i % 3 else "unlock") for i, t, who, _ in rows]
    out = run_closed(flows.lock_expiry_stream, arrive(spark, locks, SCHEMA))
    got = {(r.lead_id, r.at) for r in out.select("lead_id", F.timestamp_micros("locked_at").cast("timestamp_ntz").alias("at")).collect()}
    far = F.lit("2200-01-01").cast("timestamp_ntz")
    assert got == {(r.lead_id, r.locked_at) for r in events.expired_locks(spark.createDataFrame(locks, SCHEMA), far).collect()} and got


def test_late_events_are_set_aside(spark):
    early = [(i, BASE + datetime.timedelta(minutes=i), "a", "bounce") for i in range(20)]
    mid = [(100, BASE + datetime.timedelta(days=3), "a", "bounce"), (101, BASE + datetime.timedelta(days=4), "b", "bounce")]
    more = [(102, BASE + datetime.timedelta(days=5), "b", "bounce")]
    late = [(200, BASE + datetime.timedelta(days=1), "a", "reject_tier2")]
    folder = tempfile.mkdtemp(prefix="leadloom-late-")
    for i, part in enumerate((early, mid, more, late)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    applied = run_closed(flows.lead_state_stream, stream)
    whole = spark.read.schema(SCHEMA).parquet(f"{folder}/*").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp_ltz")))
    assert [r.event_id for r in late_events(whole, applied, "lead_id", "at").collect()] == [200]


def test_one_lead_with_all_events(spark):
    """Maps are composed over several levels, and every transition can happen."""
    rnd = random.Random(9)
    rows = [(i, BASE + datetime.timedelta(minutes=rnd.randint(0, 900)), "hot", rnd.choice([*events.KINDS, None])) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    deep = events.lead_state(df, partitions=3, fold=4).collect()
    assert [tuple(r) for r in deep] == [tuple(r) for r in events.lead_state(df, partitions=1, fold=10_000).collect()]
    state, applied = "new_lead", 0
    from leadloom.functions import rules

    for _, _, _, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        nxt = [b for k, a, b in rules.LEAD_TRANSITIONS if k == kind and a in ("*", state)]
        applied += bool(nxt)
        state = state if not nxt or nxt[0] == "=" else nxt[0]
    assert (deep[0].status, deep[0].applied, deep[0].refused) == (state, applied, len(rows) - applied)


@pytest.mark.parametrize("path, status", [
    (["subsidiary_found"], "needs_review"), (["start_enrichment", "research_failed"], "new_lead"),
    (["start_enrichment", "research_given_up"], "needs_review"), (["start_enrichment", "no_email"], "exclude"),
    (["start_enrichment", "scrape_failed"], "new_lead"),
    (["start_enrichment", "start_verification", "verification_passed", "low_tier"], "exclude"),
])
def test_ways_out_of_the_pipeline(spark, path, status):
    rows = [(i, BASE + datetime.timedelta(minutes=i), "L", k) for i, k in enumerate(path)]
    assert events.lead_state(spark.createDataFrame(rows, SCHEMA)).head().status == status


def test_breaker_of_one_label_that_always_fails(spark):
    calls = [(i, BASE + datetime.timedelta(seconds=7 * i), "svc", False) for i in range(6000)]
    df = spark.createDataFrame(calls, "event_id long, ts timestamp_ntz, label string, ok boolean")
    want = breaker(calls, 5, datetime.timedelta(minutes=5), datetime.timedelta(minutes=10))
    assert {(r.label, r.opened_at) for r in events.failure_breaker(df).collect()} == want and len(want) > 60


def test_locks_of_one_lead(spark):
    rnd = random.Random(11)
    rows = [(i, BASE + datetime.timedelta(minutes=rnd.randint(0, 20_000)), "hot", rnd.choice(["lock", "unlock"])) for i in range(500)]
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    until, life = BASE + datetime.timedelta(minutes=20_000), datetime.timedelta(minutes=30)
    want = [a[1] for a, b in zip(order, [*order[1:], None]) if a[3] == "lock" and (b[1] > a[1] + life if b else a[1] + life < until)]
    got = events.expired_locks(spark.createDataFrame(rows, SCHEMA), F.lit(str(until)).cast("timestamp_ntz")).collect()
    assert sorted(r.locked_at for r in got) == sorted(want)


def test_cohort_rates(spark):
    rnd = random.Random(12)
    rows = [
        (i, BASE + datetime.timedelta(minutes=rnd.randint(0, 6000)), rnd.choice(["hot", "hot", "a", "b", None]),
         rnd.choice(["OUTREACH", "FOLLOW_UP", "SMTP_550", "x"]))
        for i in range(400)
    ]
    schema = "id long, ts timestamp_ntz, lead_id string, error_code string"
    day = datetime.timedelta(hours=24)
    want = {
        r[0]: any(b[2] == r[2] and b[3] == "SMTP_550" and r[1] <= b[1] <= r[1] + day for b in rows)
        for r in rows if r[3] in ("OUTREACH", "FOLLOW_UP") and r[2]
    }
    batch = mail.next_bounces(spark.createDataFrame(rows, schema))
    assert {r.id: r.bounced for r in batch.collect()} == want
    stream = run_closed(flows.bounced_sends, arrive(spark, rows, schema))
    rates = [{tuple(r) for r in mail.cohort_bounce_rate(x).collect()} for x in (batch, stream)]
    assert {r[1:] for r in rates[0]} == {r[1:] for r in rates[1]} and sum(r[1] for r in rates[0]) == len(want)


def test_breaker_windows_do_not_read_the_rest_again(spark):
    """A frame that runs from each row to the end of a bucket costs the square of its rows."""
    rows = [("svc", BASE.replace(microsecond=i), i) for i in range(3)]
    found = spark.createDataFrame(rows, "label string, ts timestamp_ntz, event_id long").selectExpr("label", "event_id", "unix_micros(cast(ts AS timestamp_ltz)) AS at", "unix_micros(cast(ts AS timestamp_ltz)) AS started")
    plan = events._next_trips(found, 1, 1_000_000)._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in plan.replace(" ", "") and "unboundedfollowing" not in plan.replace(" ", "")


def test_stream_spreads_a_busy_label(spark):
    """A label whose calls fill many buckets is many groups, and the trips are those of one call at a time."""
    rnd = random.Random(12)
    calls = [(i, BASE + datetime.timedelta(seconds=rnd.randint(0, 40_000)), rnd.choice(["a|b", "b"]), rnd.random() > 0.9) for i in range(900)]
    schema = "event_id long, ts timestamp_ntz, label string, ok boolean"
    tail = (10_000, BASE + datetime.timedelta(days=30), "tail", True)
    found = run_available(flows.trip_candidates_stream(arrive(spark, calls, schema, last=tail)))
    assert found.select("part").distinct().count() > 10
    trips = events.chained_trips(flows.own_candidates(found), 600_000_000, 3_600_000_000)
    assert {(r.label, r.opened_at) for r in trips.collect()} == breaker(calls, 5, datetime.timedelta(minutes=5), datetime.timedelta(minutes=10))


def test_keys_share_groups(spark):
    """Many leads are few calls of Python, and each still has its own events, memo and timer."""
    rnd = random.Random(13)
    rows = [(i, BASE + datetime.timedelta(minutes=rnd.randint(0, 3000)), f"L{rnd.randint(0, 150)}", rnd.choice(["lock", "unlock"])) for i in range(900)]
    plan = flows.lock_expiry_stream(arrive(spark, rows, SCHEMA))._jdf.queryExecution().analyzed().toString()
    assert "pmod(xxhash64(" in plan
    step = lambda memo, when, kind: ((memo or 0) + 1, [((memo or 0) + 1, when)])
    for groups in (1, 7):
        flow = lambda x: replay(x, "lead_id", step, "lead_id string, n long, at long", groups=groups)  # noqa: B023, E731
        got = {(r.lead_id, r.n, r.at) for r in run_closed(flow, arrive(spark, rows, SCHEMA)).collect()}
        df = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp_ltz")))
        n = F.row_number().over(Window.partitionBy("lead_id").orderBy("at", "event_id"))
        assert got == {(r.lead_id, r.n, r.at) for r in df.withColumn("n", n).collect()}
    out = run_closed(flows.lock_expiry_stream, arrive(spark, rows, SCHEMA))
    far = F.lit("2200-01-01").cast("timestamp_ntz")
    want = events.expired_locks(spark.createDataFrame(rows, SCHEMA), far)
    got = out.select("lead_id", F.timestamp_micros("locked_at").cast("timestamp_ntz").alias("locked_at"))
    assert {tuple(r) for r in got.collect()} == {(r.lead_id, r.locked_at) for r in want.collect()}
