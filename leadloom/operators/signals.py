"""Signals, composite score and send window of registered companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.functions.keys import col, format_gbp, norm_person
from leadloom.operators.qualify import company_address, is_nominee_address
from leadloom.session import written

KEY = "company_number"


def as_date(as_of: str) -> Column:
    return F.lit(as_of[:10]).cast("date")


def as_moment(as_of: str) -> Column:
    return F.lit(as_of if len(as_of) > 10 else as_of + " 00:00:00").cast("timestamp_ntz")


def is_board_member() -> Column:
    return F.col("resigned_on").isNull() & F.col("officer_role").isin(rules.BOARD_ROLES)


def officer_signals(officers: DataFrame) -> DataFrame:
    """Active directors per company; a company without any has no row (unknown)."""
    return (
        officers.where(is_board_member())
        .groupBy(KEY)
        .agg(
            F.count("*").cast("int").alias("director_count"),
            F.min("appointed_on").alias("earliest_appointed_on"),
            F.max("appointed_on").alias("latest_appointed_on"),
            _primary_director().alias("primary"),
        )
        .select("*", "primary.name", "primary.role")
        .withColumnsRenamed({"name": "primary_director", "role": "primary_role"})
        .drop("primary")
    )


def _primary_director() -> Column:
    """Longest-serving officer; ties by role, then name."""
    rank = (  # fixed values: order of roles on a tie
        F.when(F.col("officer_role") == "director", 0)
        .when(F.col("officer_role") == "llp-member", 1)
        .when(F.col("officer_role") == "secretary", 2)
        .otherwise(3)
    )
    served = F.coalesce("appointed_on", F.lit("9999-12-31").cast("date"))
    return F.min_by(
        F.struct(F.col("name").alias("name"), F.col("officer_role").alias("role")),
        F.struct(served, rank, F.col("name")),
    )


def primary_director(officers: DataFrame) -> DataFrame:
    return officer_signals(officers).select(KEY, "primary_director", "primary_role")


def filing_signals(filings: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """Latest office move and capital event in the year, and name changes in five."""
    recent = F.datediff(as_date(as_of), "filing_date") <= days
    text = F.coalesce("description", F.lit(""))
    moved = recent & (
        (F.col("category") == "address") | text.rlike(rules.OFFICE_MOVE_PATTERN)
    )
    capital = recent & (
        (F.col("category") == "capital") | text.rlike(rules.CAPITAL_EVENT_PATTERN)
    )
    renamed = (F.col("category") == "change-of-name") & (
        F.datediff(as_date(as_of), "filing_date") <= 5 * 365
    )
    return filings.groupBy(KEY).agg(
        F.max(F.when(moved, F.col("filing_date"))).alias("office_moved_on"),
        F.max(F.when(capital, F.col("filing_date"))).alias("capital_event_on"),
        F.count_if(renamed).cast("int").alias("name_changes"),
    )


def charges_summary(charges: DataFrame) -> DataFrame:
    """0 means charges exist and none is active; no row means nothing is known."""
    active = F.col("status").isin(rules.ACTIVE_CHARGE_STATUSES)
    return charges.groupBy(KEY).agg(
        F.count_if(active).cast("int").alias("active_charges"),
        F.max(F.when(active, F.col("created_on"))).alias("latest_charge_on"),
    )


def psc_breakdown(psc: DataFrame) -> DataFrame:
    active = F.col("ceased_on").isNull()
    kind = F.lower(F.coalesce("kind", F.lit("")))
    corporate = kind.contains("corporate") | kind.contains("legal-person")
    return psc.groupBy(KEY).agg(
        F.count_if(active).cast("int").alias("active_psc"),
        F.count_if(active & corporate).cast("int").alias("corporate_psc"),
        F.count_if(active & ~corporate & kind.contains("individual"))
        .cast("int")
        .alias("individual_psc"),
    )


def psc_dominance(corporate: Column | str, individual: Column | str) -> Column:
    c = F.coalesce(col(corporate), F.lit(0))
    i = F.coalesce(col(individual), F.lit(0))
    return F.when((c > 0) & (c >= i), "corporate_psc_dominant").when(c > 0, "corporate_psc_present")


def growth(current: Column | str, prior: Column | str) -> Column:
    c, p = col(current), col(prior)
    return F.when(p > 0, (c - p) / p)


def yearly_growth(history: DataFrame) -> DataFrame:
    """Growth on the year before, from a table of one row per company and year."""
    w = Window.partitionBy(KEY).orderBy("period_year")
    previous = F.lag(F.struct("period_year", "turnover", "employees")).over(w)
    adjacent = F.col("p.period_year") == F.col("period_year") - 1
    return history.withColumn("p", previous).select(
        KEY,
        "period_year",
        F.when(adjacent, growth("turnover", "p.turnover")).alias("turnover_growth"),
        F.when(adjacent, growth("employees", "p.employees")).alias("employee_growth"),
    )


def company_signals(
    companies: DataFrame,
    officers: DataFrame,
    filings: DataFrame,
    charges: DataFrame,
    psc: DataFrame,
    accounts: DataFrame,
    as_of: str,
) -> DataFrame:
    """One wide row per company. Every child is reduced to one row before its join."""
    return (
        companies.join(officer_signals(officers), KEY, "left")
        .join(filing_signals(filings, as_of), KEY, "left")
        .join(charges_summary(charges), KEY, "left")
        .join(psc_breakdown(psc), KEY, "left")
        .join(accounts, KEY, "left")
    )


def _score_rules(as_of: str) -> list[tuple[Column, int, str, Column]]:
    """(condition, points, signal, reason text) in the order reasons are listed."""
    today = as_date(as_of)
    n = F.col("director_count")
    appointed_days = F.datediff(today, "latest_appointed_on")
    charge_days = F.datediff(today, "latest_charge_on")
    dominance = psc_dominance("corporate_psc", "individual_psc")
    turnover = F.col("turnover")
    staff = F.col("employees")
    rate = growth("turnover", "prior_turnover")
    percent = F.format_string("%.0f", rate * 100)
    money = F.concat(F.lit("£"), format_gbp(turnover))

    def says(template: str, *parts: Column) -> Column:
        return F.format_string(template, *parts) if parts else F.lit(template)

    parsed = turnover.isNotNull() | staff.isNotNull()
    # fixed values: bands, points, signal names and reason texts
    return [
        (appointed_days.between(0, 90), 12, "new_director_recent",
         says("+12 new director appointed %sd ago", appointed_days.cast("string"))),
        (n.between(1, 3), 8, "founder_led",
         says("+8 %s-director company (founder-led)", n.cast("string"))),
        (n >= 7, -12, "board_run",
         says("-12 %s-director company (board-run, weak ICP fit)", n.cast("string"))),
        (F.col("office_moved_on").isNotNull(), 5, "registered_office_moved_recently",
         says("+5 moved registered office in last 12m (likely scaling)")),
        (F.col("capital_event_on").isNotNull(), 8, "recent_capital_event",
         says("+8 recent capital allotment / share event")),
        (charge_days <= 90, 4, "recent_charge_created",
         says("+4 charge created in last 90d (often debt-funded growth)")),
        (dominance == "corporate_psc_dominant", -12, "corporate_psc_dominant",
         says("-12 dominant corporate PSC (%s corporate vs %s individual) — likely subsidiary",
              F.col("corporate_psc").cast("string"), F.col("individual_psc").cast("string"))),
        (dominance == "corporate_psc_present", 0, "corporate_psc_present", None),
        (F.col("name_changes") >= 2, -8, "frequent_name_changes",
         says("-8 %s name changes in last 5 years (rebrand churn / shell pattern)",
              F.col("name_changes").cast("string"))),
        (F.col("accounts_overdue"), -25, "accounts_overdue", says("-25 accounts overdue")),
        (F.col("confirmation_overdue"), -10, "confirmation_statement_overdue",
         says("-10 confirmation statement overdue")),
        (turnover.between(1_000_000, 20_000_000), 15, "turnover_in_icp_band",
         says("+15 turnover %s (in £1m-£20m ICP band)", money)),
        (turnover > 20_000_000, -8, "turnover_above_icp",
         says("-8 turnover %s (above ICP — too big)", money)),
        ((turnover > 0) & (turnover < 250_000), -15, "turnover_below_icp",
         says("-15 turnover %s (sub-£250k — too small to buy a real fix)", money)),
        (staff.between(10, 100), 8, "headcount_in_icp_band",
         says("+8 %s employees (in 10-100 ICP band)", staff.cast("string"))),
        (staff > 200, -8, "headcount_above_icp",
         says("-8 %s employees (above ICP)", staff.cast("string"))),
        ((staff > 0) & (staff < 5), -10, "headcount_below_icp",
         says("-10 %s employees (sub-5, too small)", staff.cast("string"))),
        (rate >= 0.1, 10, "growing_yoy", says("+10 %s%% YoY turnover growth", percent)),
        (rate <= -0.15, -5, "contracting_yoy",
         says("-5 %s%% YoY turnover (contracting)", percent)),
        (~parsed, 0, "no_parseable_accounts", None),
    ]


def pre_score(signals: DataFrame, as_of: str) -> DataFrame:
    """Adds ``pre_score`` (0-100 around 50), ``signals`` and ``score_reasons``."""
    rules_ = _score_rules(as_of)
    points = F.lit(50)
    for condition, delta, _, _ in rules_:
        if delta:
            points = points + F.when(condition, delta).otherwise(0)

    def kept(items: list[Column]) -> Column:
        return F.filter(F.array(*items), lambda x: x.isNotNull())

    return signals.withColumns(
        {
            "pre_score": F.greatest(F.lit(0), F.least(F.lit(100), points)),
            "signals": kept([F.when(c, F.lit(s)) for c, _, s, _ in rules_]),
            "score_reasons": kept([F.when(c, r) for c, _, _, r in rules_ if r is not None]),
        }
    )


def _same_day(year: Column, of: Column) -> Column:
    """That month and day in another year; 29 February becomes 1 March if need be."""
    return F.date_add(F.make_date(year, F.month(of), F.lit(1)), F.dayofmonth(of) - 1)


def send_window(
    as_of: str,
    incorporated_on: str = "date_of_creation",
    made_up_to: str = "last_made_up_to",
    next_due: str = "accounts_next_due",
    appointed_on: str = "latest_appointed_on",
) -> Column:
    """struct(at, reason) of the earliest moment worth contacting, or null."""
    now, today = as_moment(as_of), as_date(as_of)
    made, due, inc = F.col(made_up_to), F.col(next_due), F.col(incorporated_on)

    def at(day: Column) -> Column:
        return day.cast("timestamp_ntz")

    appointed_age = F.timestamp_diff("SECOND", at(F.col(appointed_on)), now)
    this_year_end = _same_day(F.year(today), made)
    year_end = F.when(at(this_year_end) > now, this_year_end).otherwise(
        _same_day(F.year(today) + 1, made)
    )
    before_due = F.date_sub(due, 35)
    years_old = F.timestamp_diff("SECOND", at(inc), now) / (365.25 * 86400)
    milestone = F.when(F.lit(False), 0)
    for m in rules.ANNIVERSARY_YEARS:
        milestone = milestone.when(years_old < m, m)
    anniversary = F.date_sub(_same_day(F.year(inc) + milestone, inc), 14)
    options = [
        (F.when(appointed_age.between(0, 90 * 86400), now), F.lit("new-director-honeymoon")),
        (at(F.date_add(year_end, 35)), F.lit("post-year-end")),
        (F.when(at(before_due) > now, at(before_due)), F.lit("pre-accounts-deadline")),
        (at(anniversary), F.concat(milestone.cast("string"), F.lit("-year-anniversary"))),
    ]
    structs = [
        F.when(
            moment.isNotNull(),
            F.struct(moment.alias("at"), F.lit(i).alias("rank"), reason.alias("reason")),
        )
        for i, (moment, reason) in enumerate(options)
    ]
    return F.array_min(F.filter(F.array(*structs), lambda s: s.isNotNull()))


def with_send_window(df: DataFrame, as_of: str, **columns: str) -> DataFrame:
    return df.withColumn("_w", send_window(as_of, **columns)).select(
        *df.columns, F.col("_w.at").alias("window_at"), F.col("_w.reason").alias("window_reason")
    )


def send_window_refresh(leads: DataFrame, as_of: str) -> DataFrame:
    """New leads whose send window differs from the stored one."""
    inputs = ["incorporated_on", "accounts_last_made_up_to", "latest_director_appointed_on"]
    due = leads.where(
        (F.col("status") == "new_lead") & F.coalesce(*inputs).isNotNull()
    )
    fresh = with_send_window(
        due,
        as_of,
        incorporated_on="incorporated_on",
        made_up_to="accounts_last_made_up_to",
        next_due="accounts_next_due",
        appointed_on="latest_director_appointed_on",
    )
    same = F.col("window_at").eqNullSafe(F.col("next_outreach_window")) & F.col(
        "window_reason"
    ).eqNullSafe(F.col("next_outreach_window_reason"))
    return fresh.where(~same).select("id", "window_at", "window_reason")


def facts_block(as_of: str) -> Column:
    """Text lines known about a scored company; null if only its name is known."""

    def day(c: str) -> Column:
        return F.date_format(c, "yyyy-MM-dd")

    def line(template: str, *parts: Column) -> Column:
        return F.concat(*[
            x for pair in zip(map(F.lit, template.split("%s")), (*parts, F.lit("")))
            for x in pair
        ])

    years = F.floor(F.datediff(as_date(as_of), "date_of_creation") / 365.25).cast("string")
    rate = F.format_string("%.0f", growth("turnover", "prior_turnover") * 100)
    prior = F.when(
        F.col("prior_turnover") > 0,
        line(", %s%% YoY (prior £%s)".replace("%%", "%"), rate, format_gbp("prior_turnover")),
    ).otherwise("")
    since = F.coalesce(line(", in role since %s", day("earliest_appointed_on")), F.lit(""))
    staff_prior = F.coalesce(
        line(" (prior year %s)", F.col("prior_employees").cast("string")), F.lit("")
    )
    # fixed values: the text of each line, in order
    head = line("Company: %s (CRN %s)", F.col("company_name"), F.col(KEY))
    rest = [
        line("Founded: %s (%s years).", day("date_of_creation"), years),
        line("Accounts category: %s.", F.col("accounts_category")),
        F.when(
            F.col("sic_csv") != "",
            line("SIC codes: %s.", F.replace(F.col("sic_csv"), F.lit(","), F.lit(", "))),
        ),
        line("Primary director: %s (%s)%s.", F.col("primary_director"), F.col("primary_role"), since),
        line("Active directors: %s.", F.col("director_count").cast("string")),
        F.when(
            F.array_contains("signals", "new_director_recent"),
            line("Most recent appointment: %s — in mandate-honeymoon window.",
                 day("latest_appointed_on")),
        ),
        line("Turnover (latest filed): £%s%s.", format_gbp("turnover"), prior),
        line("Average employees: %s%s.", F.col("employees").cast("string"), staff_prior),
        line("Accounts made up to: %s.", day("made_up_to")),
        line("Next accounts due: %s.", day("accounts_next_due")),
        F.when(
            F.col("active_charges") > 0,
            line("Outstanding charges: %s.", F.col("active_charges").cast("string")),
        ).when(F.col("active_charges") == 0, "No outstanding charges."),
        F.when(
            F.col("vat_registered"),
            line("VAT-registered%s.",
                 F.coalesce(line(" (GB%s)", F.col("vat_number")), F.lit(""))),
        ).when(~F.col("vat_registered"), "Not VAT-registered."),
        F.when(
            F.size("signals") > 0,
            line("CH signals: %s.", F.array_join("signals", ", ")),
        ),
    ]
    known = F.filter(F.array(*rest), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.array_join(F.concat(F.array(head), known), "\n"))


def director_graph(officers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(directors, edges): the latest attributes of each person, and who sits where."""
    version = F.struct(
        F.coalesce("appointed_on", F.lit("0001-01-01").cast("date")), KEY, "officer_role",
        F.coalesce("resigned_on", F.lit("9999-12-31").cast("date")),
    )
    people = (
        officers.where(F.col("officer_role").isin(rules.BOARD_ROLES))
        .withColumns(
            {
                "director": norm_person("name"),
                "dob_month": F.coalesce("dob_month", F.lit(0)),
                "dob_year": F.coalesce("dob_year", F.lit(0)),
            }
        )
        .where(F.col("director") != "")
    )
    who = ["director", "dob_month", "dob_year"]
    attributes = ["name", "nationality", "occupation", "country_of_residence"]
    directors = (
        people.groupBy(*who)
        .agg(F.max_by(F.struct(*attributes), version).alias("a"))
        .select(*who, "a.*")
        .withColumnRenamed("name", "full_name")
    )
    edges = (
        people.groupBy(KEY, *who, F.col("officer_role").alias("role"))
        .agg(F.max_by(F.struct("appointed_on", "resigned_on"), version).alias("e"))
        .select(KEY, *who, "role", "e.*", F.col("e.resigned_on").isNull().alias("is_active"))
    )
    return directors, edges


def parent_company(
    companies: DataFrame, officers: DataFrame, accepted: DataFrame | None = None
) -> DataFrame:
    """The earliest other accepted company at the same office that shares an active director.

    ``accepted`` holds the company numbers that may be a parent; all may if it is left out.
    One building may hold a third of the register. So no pair of companies is formed
    inside a group: each (office, director) keeps its earliest company only, and every
    later company looks up that one row. The seats of directors are asked twice, so they are written once.
    """
    seat = F.trim(F.regexp_replace(F.lower(company_address()), r"\s+", " "))
    homes = companies.select(
        KEY, "company_name", "date_of_creation", seat.alias("seat"),
        is_nominee_address(company_address()).alias("nominee"),
    ).where(F.col("seat").isNotNull() & ~F.col("nominee"))
    seats = (
        officers.where(is_board_member())
        .select(KEY, norm_person("name").alias("director"))
        .where(F.col("director") != "")
        .distinct()
        .join(homes, KEY)
    )
    seats = written(seats, "seats")
    age = F.struct("date_of_creation", KEY)
    heads = seats if accepted is None else seats.join(accepted.select(KEY).distinct(), KEY, "left_semi")
    first = heads.groupBy("seat", "director").agg(
        F.min(F.struct(age.alias("age"), F.col("company_name").alias("name"))).alias("first")
    )
    # The parent is the earliest of these firsts, so a director it shares with the company
    # has that same parent as its first: no second look at the parent's directors.
    found = (
        seats.join(first, ["seat", "director"])
        .where(F.col("first.age") < age)
        .groupBy(KEY)
        .agg(
            F.min("first").alias("parent"),
            F.collect_list(F.struct("first.age", "director")).alias("links"),
        )
    )
    shared = F.transform(
        F.filter("links", lambda x: x.age == F.col("parent.age")), lambda x: x.director
    )
    return found.select(
        KEY,
        F.col(f"parent.age.{KEY}").alias("parent_number"),
        F.col("parent.name").alias("parent_name"),
        F.array_sort(F.array_distinct(shared)).alias("shared_directors"),
    )
