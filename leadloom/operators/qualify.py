"""Registry qualification: rules that reject a company, each with its reason."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.functions.keys import blank_to_null, col, full_address

ADDRESS_PARTS = [
    "address_line_1", "address_line_2", "locality", "region", "postal_code", "country",
]


def company_address() -> Column:
    return full_address(*ADDRESS_PARTS)


def accounts_category() -> Column:
    return blank_to_null(F.trim(F.lower(F.col("accounts_category"))))


def standing_reason(allowed: Sequence[str] = rules.ACCOUNTS_ALLOWED) -> Column:
    """The first financial-standing rule a company fails, null if it passes."""
    category = accounts_category()
    return (
        F.when(
            ~F.col("company_status").eqNullSafe("active"),
            F.concat(F.lit("status="), F.coalesce("company_status", F.lit("unknown"))),
        )
        .when(F.col("has_been_liquidated") | F.col("has_insolvency_history"), "insolvency-history")
        .when(F.col("accounts_overdue"), "accounts-overdue")
        .when(F.col("confirmation_overdue"), "confirmation-statement-overdue")
        .when(
            F.col("last_accounts_type").rlike("(?i)DORMANT|AA02"),
            F.concat(F.lit("last-accounts-type="), F.col("last_accounts_type")),
        )
        .when(category.isNull(), "no-accounts-category")
        .when(~category.isin(list(allowed)), F.concat(F.lit("accounts-category="), category))
    )


def financial_standing(companies: DataFrame, **kw) -> DataFrame:
    return companies.withColumns(
        {"accounts_category": accounts_category(), "standing_reason": standing_reason(**kw)}
    )


def is_dormant_filer() -> Column:
    return F.coalesce(F.upper("last_accounts_type").isin(rules.DORMANT_TYPES), F.lit(False))


def is_nominee_address(address: Column | str, extra: Sequence[str] = ()) -> Column:
    """Whether a known formation-agent address occurs in the text."""
    text = F.lower(col(address))
    fragments = [*rules.NOMINEE_FRAGMENTS, *(e.strip().lower() for e in extra if e.strip())]
    # One pattern, so the address is not worked out again for each fragment.
    return F.coalesce(text.rlike("|".join(map(re.escape, fragments))), F.lit(False))


def hard_exclude_reason(sic_prefixes: Sequence[str] = ()) -> Column:
    reason = (
        F.when(F.col("has_been_liquidated"), "liquidated")
        .when(F.col("has_insolvency_history"), "insolvency-history")
        .when(
            ~F.col("company_status").eqNullSafe("active"),
            F.concat(F.lit("status="), F.coalesce("company_status", F.lit("unknown"))),
        )
    )
    if sic_prefixes:
        codes = F.split(F.col("sic_csv"), ",")
        blocked = F.get(
            F.filter(codes, lambda c: c.rlike("^(?:" + "|".join(sic_prefixes) + ")")), F.lit(0)
        )
        reason = reason.when(blocked.isNotNull(), F.concat(F.lit("sic-blocked="), blocked))
    return reason


# fixed values: standing rule -> funnel bucket
STANDING_BUCKETS = [
    ("status=", "status-inactive"),
    ("insolvency-history", "insolvency"),
    ("accounts-overdue", "overdue"),
    ("confirmation-statement-overdue", "overdue"),
    ("last-accounts-type", "dormant"),
    ("no-accounts-category", "no-accounts-category"),
    ("accounts-category=", "accounts-category"),
]
STANDING_REASONS = [
    "profile-missing", "dormant", "insolvency", "overdue", "accounts-category",
    "no-accounts-category", "status-inactive", "hard-exclude",
]
GATE_REASONS = [*STANDING_REASONS, "nominee-address", "subsidiary", "pre-score"]


def standing_bucket(reason: Column) -> Column:
    bucket = F.when(F.lit(False), "")
    for prefix, name in STANDING_BUCKETS:
        bucket = bucket.when(reason.startswith(prefix), name)
    return bucket


def registry_gate(
    companies: DataFrame, sic_prefixes: Sequence[str] = (), reject_nominee: bool = True
) -> DataFrame:
    """Adds ``registry_reason``, from the company's own row only: it runs before any join.

    Companies are dealt out by number first, or one task judges all of a small file, and whoever reads what it wrote is
    one task again.
    """
    gate = (
        F.when(F.col("company_name").isNull(), "profile-missing")
        .when(is_dormant_filer(), "dormant")
        .when(F.col("_standing").isNotNull(), standing_bucket(F.col("_standing")))
        .when(F.col("_hard").isNotNull(), "hard-exclude")
    )
    if reject_nominee:
        gate = gate.when(is_nominee_address("_address"), "nominee-address")
    return (
        companies.repartition("company_number").withColumns(
            {
                "_standing": standing_reason(),
                "_hard": hard_exclude_reason(sic_prefixes),
                "_address": company_address(),
            }
        )
        .withColumn("registry_reason", gate)
        .drop("_standing", "_hard", "_address")
    )


def discovery_gate(
    scored: DataFrame, subsidiary_policy: str = "flag", floor: int = rules.PRE_SCORE_FLOOR
) -> DataFrame:
    """Adds ``reject_reason`` and ``is_subsidiary`` to scored companies.

    Expects ``registry_reason``, ``pre_score`` and ``parent_number``.
    """
    if subsidiary_policy not in ("reject", "flag", "ignore"):
        raise ValueError(subsidiary_policy)
    own = F.col("registry_reason")
    subsidiary = F.lit(False)
    if subsidiary_policy != "ignore":
        subsidiary = own.isNull() & F.col("parent_number").isNotNull()
    reason = F.when(own.isNotNull(), own)
    if subsidiary_policy == "reject":
        reason = reason.when(subsidiary, "subsidiary")
    reason = reason.when(F.col("pre_score") < floor, "pre-score")
    return scored.withColumns({"reject_reason": reason, "is_subsidiary": subsidiary})


def rejection_funnel(gated: DataFrame, location: str = "locality") -> DataFrame:
    """Counts by reason for each location, and a row of totals.

    A flagged subsidiary is counted even when it is then rejected for its score.
    """
    count_of = {
        "rejected_" + r.replace("-", "_"): F.count_if(F.col("reject_reason") == r)
        for r in GATE_REASONS
    }
    return gated.rollup(location).agg(
        F.count("*").alias("searched"),
        F.count_if(F.col("reject_reason").isNull()).alias("kept"),
        *(c.alias(n) for n, c in count_of.items()),
        F.count_if(F.col("reject_reason").isin(STANDING_REASONS)).alias("rejected_standing"),
        F.count_if(F.col("is_subsidiary")).alias("flagged_subsidiary"),
        F.grouping(location).cast("int").alias("is_total"),
    )
