"""Shapes of physical plans that decide whether a job scales."""

import pytest
from pyspark.sql import functions as F

from leadloom.plans import queries

PYTHON_ALLOWED = {
    "json_ld", "owner_pick", "email_validate", "contact_confidence", "salvage_json_rows",
    "failure_breaker",
}
# eager jobs: what is left of their plan is the reading of a written stage
EAGER = {"dedup_resolve", "dedup_check", "manual_ingest", "new_vs_known", "suppression_upsert", "page_assembly"}


def plan(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in queries() if "stream" not in n and n not in EAGER])
def test_no_all_pairs_and_little_python(spark, sf_dir, name):
    p = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p
    python = "ArrowEvalPython" in p or "MapInPandas" in p or "BatchEvalPython" in p
    assert not python or name in PYTHON_ALLOWED


@pytest.mark.parametrize("name", ["dup_email", "accounts_docs", "daily_digest", "send_history", "sweep_replay"])
def test_top_rows_are_cut_before_the_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan(spark, sf_dir, name)


def test_scans_read_only_what_is_needed(spark, sf_dir):
    p = plan(spark, sf_dir, "filing_signals")
    assert "o_totalprice" not in p and "o_orderstatus" not in p


@pytest.mark.parametrize(
    "name", ["company_queue", "rejection_funnel", "discovery_gate", "discovery_gate_reject", "parent_company", "director_overlap"]
)
def test_gate_is_planned_once(spark, sf_dir, name):
    """The register's rules are in a written stage, not in every branch that reads them."""
    whole = queries()[name](spark, sf_dir)._jdf.queryExecution()
    assert len(whole.executedPlan().toString()) < 100_000 and len(whole.optimizedPlan().toString()) < 100_000
    assert "AA02" not in whole.executedPlan().toString() and whole.executedPlan().toString().count("Scan parquet") <= 10


def test_a_small_register_is_dealt_before_its_rules(spark, sf_dir):
    """One file is one task; the rules, and those who read what they wrote, are not left to it."""
    from leadloom.operators import qualify
    from leadloom.sources.views import view

    plan = qualify.registry_gate(view(spark, sf_dir, "companies_v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "AS registry_reason" in plan.split("RepartitionByExpression")[0]


def test_seats_are_found_once(spark, sf_dir):
    plan = queries()["parent_company"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and "regexp_replace" not in plan


def test_a_nominee_address_is_read_once(spark):
    from leadloom.operators import qualify

    rows = [("Kemp House, 152-160 City Road",), ("kemp house. 152-160 city road",), (None,), ("9 Extra (Lane) +x",)]
    df = spark.createDataFrame(rows, "a string").select(qualify.is_nominee_address(F.trim("a"), [" extra (lane) +", " "]).alias("hit"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 1
    assert [r.hit for r in df.collect()] == [True, False, False, True]
