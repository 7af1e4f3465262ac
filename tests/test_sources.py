import tempfile
import time

import pytest
from pyspark.sql import functions as F

from leadloom.operators import accounts, qualify, queues, signals, tables
from leadloom.sources import files, ingest, schemas


def test_formats(spark):
    folder = tempfile.mkdtemp(prefix="leadloom-fmt-")
    rows = [("Acme, Ltd", "Leeds", None, None, None, "a@x.com", None, None, None)]
    df = spark.createDataFrame(rows, schemas.LEADS_IN)
    df.write.json(f"{folder}/j")
    df.write.option("header", True).option("escape", '"').csv(f"{folder}/c")
    files.write_snapshot(df, f"{folder}/p")
    for fmt, path in [("json", "j"), ("csv", "c"), ("parquet", "p")]:
        got = files.read(spark, f"{folder}/{path}", schemas.LEADS_IN, fmt).head()
        assert (got.business_name, got.email) == ("Acme, Ltd", "a@x.com")
    with pytest.raises(ValueError):
        files.read(spark, folder, None, "csv")


def test_profile_payload(spark):
    payload = """{"company_number": "sc 1", "company_name": "Acme", "company_status": "active",
      "date_of_creation": "2001-02-03", "registered_office_address": {"locality": "Leeds", "postal_code": "LS1 4AP"},
      "sic_codes": ["1", "2"], "accounts": {"accounts_category": "small", "overdue": false,
      "last_accounts": {"type": "FULL", "made_up_to": "2020-02-29"}}}"""
    df = spark.createDataFrame([("x", "profile", payload)], "company_number string, resource string, payload string")
    r = ingest.profile_rows(df).head()
    assert (r.company_number, r.locality, r.sic_csv, str(r.last_made_up_to)) == ("SC1", "Leeds", "1,2", "2020-02-29")
    assert r.confirmation_overdue is None


@pytest.mark.parametrize(
    "raw, expected",
    [
        ('[{"businessName":"A","city":"L"},{"businessName":"B"', ["A"]),
        ('```json\n[{"businessName":"A"},{"x":1}]\n```', ["A"]),
        ('text [{"businessName":"A ] } \\" {"},{"businessName":7}', ['A ] } " {']),
        ('{"businessName":"A"}', []),
        ("", []),
        ("[]", []),
        ('[{"businessName":"A","n":{"m":[{}]}},{"businessName":"B"},', ["A", "B"]),
    ],
)
def test_salvage(spark, raw, expected):
    df = spark.createDataFrame([(1, raw)], "response_id long, raw string")
    rows = ingest.salvage_json_rows(df).orderBy("place").collect()
    assert [r.business_name for r in rows] == expected


def test_manual_leads_reject_blank_names(spark):
    rows = [
        ("1", "2024-01-01", " Acme Ltd "), ("2", "2024-01-02", "  "), ("3", "2024-01-03", None), ("4", "2024-01-04", "ACME"),
    ]
    df = spark.createDataFrame(rows, "id string, at string, business_name string").withColumn(
        "created_at", F.col("at").cast("timestamp_ntz")
    )
    for c in ["place_id", "company_number", "email", "website_url", "phone", "outward_postcode", "address", "city"]:
        df = df.withColumn(c, F.lit(None).cast("string"))
    created, skipped = ingest.manual_leads(df)
    assert [r.id for r in created.collect()] == ["1"]
    assert {(r.id, r.reason) for r in skipped.collect()} == {
        ("2", "blank_name"), ("3", "blank_name"), ("4", "duplicate_exact_name"),
    }


@pytest.mark.parametrize(
    "raw, ok",
    [("53.8,-1.5,5000", True), ("91,0,500", False), ("1,181,500", False), ("1,1,99", False), ("1,1", False), ("a,b,c", False)],
)
def test_regions(value, raw, ok):
    got = value(ingest.parse_region, raw)
    assert (got is not None) == ok
    if ok:
        assert got.label == "53.80°N, 1.50°W (5km)"


def test_scan_plan_order_depends_on_the_seed_alone(spark):
    df = spark.createDataFrame([(f"{i},{i},500",) for i in range(10)], "region string")
    run = lambda seed: [tuple(r) for r in ingest.scan_plan(df.repartition(3), ["a", "b"], seed).collect()]
    assert run(1) == run(1) != run(2) and sorted(run(1)) == sorted(run(2))


def doc(body):
    return "<html>" + "x" * 1000 + body + "</html>"


def ctx(i, end):
    return f'<xbrli:context id="{i}"><xbrli:endDate>{end}</xbrli:endDate></xbrli:context>'


def fact(name, text, extra=""):
    return f'<ix:nonFraction name="c:{name}" {extra}>{text}</ix:nonFraction>'


@pytest.mark.parametrize(
    "html, expected",
    [
        ("short", dict(reason="empty-document")),
        (doc(""), dict(reason="no-ixbrl-tags")),
        (doc(fact("Other", "1")), dict(reason="no-matching-tags")),
        (doc(fact("Turnover", "(1,234)")), dict(turnover=-1234, prior_turnover=None)),
        (doc(fact("Turnover", "2.5", 'scale="3" sign="-"')), dict(turnover=-2500)),
        (doc(fact("AverageNumberEmployees", "-3") + fact("EmployeesTotal", "7")), dict(employees=7)),
        (
            doc(ctx("a", "2020-12-31") + ctx("b", "2019-12-31") + fact("Turnover", "5", 'contextRef="b"')
                + fact("Revenue", "£9", 'contextRef="a"')),
            dict(turnover=9, prior_turnover=5),
        ),
        # no prior-year context: the prior figures are unknown, not the current ones again
        (doc(ctx("a", "2020-12-31") + fact("Turnover", "5", 'contextRef="a"')), dict(turnover=5, prior_turnover=None)),
        # a fact without a context fits both years
        (doc(ctx("a", "2020-12-31") + ctx("b", "2020-01-01") + fact("ProfitLoss", "4")), dict(profit=4, prior_profit=4)),
    ],
)
def test_accounts(spark, html, expected):
    df = spark.createDataFrame([("1", "2021-01-01", "D", html)], "company_number string, filing_date string, document_id string, html string")
    row = accounts.parse_accounts(df).head().asDict()
    assert {k: row[k] for k in expected} == expected


def test_accounts_of_many_contexts(spark):
    """The last context of an id counts, and the work does not grow with contexts times facts."""
    n = 20_000
    many = "".join(ctx(f"c{i % (n // 2)}", f"{2000 + i % 19}-06-30" if i >= n // 2 else "2030-01-01") for i in range(n))
    html = doc(many + "".join(fact("Turnover", str(i), f'contextRef="c{i}"') for i in range(n // 2 - 1, -1, -1)))
    df = spark.createDataFrame([("1", "2021-01-01", "D", html)], "company_number string, filing_date string, document_id string, html string")
    started = time.perf_counter()
    row = accounts.parse_accounts(df).head()
    newest = [i for i in range(n // 2) if (i + n // 2) % 19 == 18]
    before = [i for i in range(n // 2) if (i + n // 2) % 19 == 17]
    assert (str(row.made_up_to), row.turnover, row.prior_turnover) == ("2018-06-30", newest[-1], before[-1])
    assert time.perf_counter() - started < 30


def test_send_window_rolls_leap_days(spark):
    df = spark.createDataFrame(
        [("2000-02-29",)], "d string"
    ).select(F.col("d").cast("date").alias("made"), F.lit(None).cast("date").alias("x"))
    w = signals.with_send_window(df, "2001-01-10", incorporated_on="x", made_up_to="made", next_due="x", appointed_on="x")
    r = w.head()
    assert (str(r.window_at), r.window_reason) == ("2001-04-05 00:00:00", "post-year-end")


def test_future_appointments_are_not_recent(spark):
    df = spark.createDataFrame([("2001-08-02",), ("2001-07-31",), ("2001-05-02",)], "d string").select(
        F.col("d").cast("date").alias("a"), F.lit(None).cast("date").alias("x")
    )
    w = signals.with_send_window(df, "2001-08-01", incorporated_on="x", made_up_to="x", next_due="x", appointed_on="a")
    assert [r.window_reason for r in w.collect()] == [None, "new-director-honeymoon", None]


def test_facts_need_more_than_a_name(spark, sf_dir):
    schema = schemas.COMPANIES + """, primary_director string, primary_role string, earliest_appointed_on date,
      director_count int, signals array<string>, latest_appointed_on date, turnover bigint, prior_turnover bigint,
      employees int, prior_employees int, made_up_to date, active_charges int, vat_registered boolean, vat_number string"""
    blank = {f.name: None for f in spark.createDataFrame([], schema).schema}
    rows = [
        {**blank, "company_number": "1", "company_name": "A"},
        {**blank, "company_number": "2", "company_name": "B", "turnover": 1500000, "prior_turnover": 1000000, "active_charges": 0,
         "vat_registered": True, "vat_number": "123456789", "signals": ["growing_yoy"]},
    ]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(signals.facts_block("2001-08-01")).collect()]
    assert got[0] is None
    assert got[1].split("\n") == [
        "Company: B (CRN 2)", "Turnover (latest filed): £1.50m, 50% YoY (prior £1.00m).", "No outstanding charges.",
        "VAT-registered (GB123456789).", "CH signals: growing_yoy.",
    ]


def test_policies():
    with pytest.raises(ValueError):
        queues.tier(tier1=50, tier2=50)


def test_subsidiary_policies(spark):
    df = spark.createDataFrame(
        [("a", None, "9", 50), ("b", None, "9", 10), ("c", "dormant", "9", 50), ("d", None, None, 50)],
        "company_number string, registry_reason string, parent_number string, pre_score int",
    )

    def run(policy):
        out = qualify.discovery_gate(df, policy).collect()
        return {r.company_number: (r.reject_reason, r.is_subsidiary) for r in out}

    assert run("flag") == {"a": (None, True), "b": ("pre-score", True), "c": ("dormant", False), "d": (None, False)}
    assert run("reject")["a"] == ("subsidiary", True)
    assert run("ignore")["b"] == ("pre-score", False)


def test_freshness_edges(spark):
    cache = spark.createDataFrame([("k", "2024-01-01 00:00:00")], "k string, t string").select(
        "k", F.col("t").cast("timestamp_ntz").alias("expires_at")
    )
    keys = spark.createDataFrame([("k",), ("new",)], "k string")
    due = lambda inclusive: {r.k for r in tables.refresh_due(keys, cache, "k", "2024-01-01", inclusive).collect()}
    assert due(True) == {"new"} and due(False) == {"k", "new"}


def test_whole_objects_of_broken_arrays():
    whole = ingest.complete_objects
    assert whole('x [{"a": "}{[\\""}, {"b": {"c": 1}}, {"d": "cut') == ['{"a": "}{[\\""}', '{"b": {"c": 1}}']
    assert whole('[{bad {"x": "}"} y}, {"ok": 1}]') == ['{"ok": 1}']
    assert whole('[{"outer": {"inner": 1}, ') == [] and whole(None) == whole("{}") == []
    assert len(whole("[" + '{"a": 1},' * 16)) == 16


def test_unfinished_snapshots_are_replaced(spark, tmp_path):
    from leadloom.sources.files import write_snapshot

    path = tmp_path / "v0"
    path.mkdir()
    (path / "part-00000.parquet").write_bytes(b"half")
    write_snapshot(spark.range(3).toDF("id"), str(path), unfinished=True)
    assert spark.read.parquet(str(path)).count() == 3


def test_stream_view_reads_folders(spark, sf_dir, tmp_path):
    from leadloom.sources.views import VIEWS, stream_view, table

    name = next(n for n, text in VIEWS.items() if "@events@" in text and text.count("@") == 2)
    table(spark, sf_dir, "events").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    query = stream_view(spark, str(tmp_path), name, "events").writeStream.format("memory").queryName("folder_rows")
    run = query.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination(120)
    assert spark.table("folder_rows").count() > 0
