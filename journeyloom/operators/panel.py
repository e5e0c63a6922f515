"""Balanced region-week panels, pre-period profiles and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from journeyloom.config import EligibilityThresholds, ExperimentWindow, GeoConfig
from journeyloom.functions.calendar import sunday_week, weekly_dates
from journeyloom.functions.numeric import ratio, rows_where, sum_where
from journeyloom.functions.text import blank_to_null
from journeyloom.operators.skew import numbered

# Names that stand for "no geography", in lower case.
NO_GEOGRAPHY = ("(not set)", "not set", "unknown", "(null)")

# Session measure -> value of a missing entry.
SESSION_MEASURES = {
    "is_engaged_session": False,
    "is_new_user_session": False,
    "view_item_event_count": 0,
    "add_to_cart_event_count": 0,
    "begin_checkout_event_count": 0,
    "canonical_transaction_count": 0,
    "canonical_revenue_usd": 0.0,
    "canonical_item_quantity": 0,
}


def _place(c: str) -> Column:
    return F.coalesce(blank_to_null(F.col(c)), F.lit("(not set)"))


def valid_geography(*names: Column) -> Column:
    ok = F.lit(True)
    for name in names:
        ok = ok & ~F.lower(name).isin(*NO_GEOGRAPHY)
    return ok


def normalize_geo_sessions(sessions: DataFrame, window: ExperimentWindow) -> DataFrame:
    """Sessions of the window with trimmed geography, validity flag and Sunday week."""
    present = {c: v for c, v in SESSION_MEASURES.items() if c in sessions.columns}
    return (
        sessions.where(F.col("session_date").between(F.lit(window.start), F.lit(window.end)))
        .select(
            "session_key",
            "user_pseudo_id",
            "session_date",
            sunday_week(F.col("session_date")).alias("week_start_date"),
            _place("geo_country").alias("geo_country"),
            _place("geo_region").alias("geo_region"),
            *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in present.items()],
        )
        .withColumn("is_valid_geography", valid_geography(F.col("geo_country"), F.col("geo_region")))
    )


def profile_measures() -> dict[str, Column]:
    """Panel measure -> aggregate over the sessions of a region-week."""
    return {
        "session_count": F.count(F.lit(1)),
        "weekly_unique_users": F.count_distinct("user_pseudo_id"),
        "canonical_transaction_count": F.sum("canonical_transaction_count"),
        "canonical_revenue_usd": F.sum("canonical_revenue_usd"),
    }


def outcome_measures() -> dict[str, Column]:
    return {
        "observed_session_count": F.count(F.lit(1)),
        "observed_unique_users": F.count_distinct("user_pseudo_id"),
        "observed_engaged_sessions": rows_where(F.col("is_engaged_session")),
        "observed_new_user_sessions": rows_where(F.col("is_new_user_session")),
        "observed_view_item_events": F.sum("view_item_event_count"),
        "observed_add_to_cart_events": F.sum("add_to_cart_event_count"),
        "observed_begin_checkout_events": F.sum("begin_checkout_event_count"),
        "observed_transaction_count": F.sum("canonical_transaction_count"),
        "observed_revenue_usd": F.sum("canonical_revenue_usd"),
        "observed_item_quantity": F.sum("canonical_item_quantity"),
    }


def balanced_panel(
    sessions: DataFrame, keys: list[str], window: ExperimentWindow, measures: dict[str, Column]
) -> DataFrame:
    """One row per geography and week of the window; weeks without sessions hold zeros.

    The sessions are read once.  A geography gathers its observed weeks (never more than the
    window has) in a map and is exploded over the calendar, so neither a second pass for the list
    of geographies nor a product with the weeks is needed.
    """
    observed = sessions.groupBy(*keys, "week_start_date").agg(
        *[agg.alias(name) for name, agg in measures.items()]
    )
    zero = {f.name: F.lit(0).cast(f.dataType) for f in observed.schema.fields if f.name in measures}
    weeks = observed.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("week_start_date", F.struct(*measures)))).alias("_seen")
    )
    return (
        weeks.select(*keys, "_seen", F.explode(weekly_dates(window.start, window.end)).alias("week_start_date"))
        .withColumn("_week", F.try_element_at("_seen", F.col("week_start_date")))
        .select(
            *keys,
            "week_start_date",
            F.when(F.col("week_start_date") <= F.lit(window.pre_end), "PRE").otherwise("TEST").alias("period_name"),
            *[F.coalesce(F.col(f"_week.{m}"), zero[m]).alias(m) for m in measures],
        )
    )


def week_numbers(panel: DataFrame, window: ExperimentWindow) -> DataFrame:
    """Last day of the week and its ordinals, in the analysis and in its own period."""
    nth_since = lambda day: 1 + F.floor(F.datediff("week_start_date", F.lit(day)) / 7).cast("int")
    overall = nth_since(window.start)
    return panel.withColumns(
        {
            "week_end_date": F.date_add("week_start_date", 6),
            "analysis_week_number": overall,
            "period_week_number": F.when(F.col("period_name") == "PRE", overall).otherwise(
                nth_since(window.test_start)
            ),
        }
    )


def _pre_measures(sessions: str, transactions: str, revenue: str, names: dict[str, str]) -> dict[str, Column]:
    """Aggregates over the weeks of a geography; usable per group or over a window."""
    pre = F.col("period_name") == "PRE"
    s, t, r = F.col(sessions), F.col(transactions), F.col(revenue)
    return {
        "pre_active_session_weeks": rows_where(pre & (s > 0)),
        "pre_transaction_active_weeks": rows_where(pre & (t > 0)),
        names["sessions"]: sum_where(pre, s),
        names["transactions"]: sum_where(pre, t),
        "pre_revenue_usd": sum_where(pre, r, 0.0),
        "pre_average_weekly_revenue_usd": F.avg(F.when(pre, r)),
        "pre_weekly_revenue_stddev_usd": F.stddev_samp(F.when(pre, r)),
        "pre_zero_revenue_weeks": rows_where(pre & (r == 0)),
    }


def _pre_rates(names: dict[str, str]) -> dict[str, Column]:
    visits = F.col(names["sessions"])
    return {
        "pre_transaction_rate": ratio(F.col(names["transactions"]), visits),
        "pre_revenue_per_session_usd": ratio(F.col("pre_revenue_usd"), visits),
        "pre_revenue_coefficient_of_variation": ratio(
            F.col("pre_weekly_revenue_stddev_usd"), F.col("pre_average_weekly_revenue_usd")
        ),
    }


CANDIDATE_NAMES = {"sessions": "pre_sessions", "transactions": "pre_transactions"}
OUTCOME_NAMES = {"sessions": "pre_session_count", "transactions": "pre_transaction_count"}


def eligibility(
    profile: DataFrame,
    thresholds: EligibilityThresholds = EligibilityThresholds(),
    names: dict[str, str] = CANDIDATE_NAMES,
) -> DataFrame:
    """Screen geographies by pre-period figures; the first reason that applies is reported."""
    cv = F.col("pre_revenue_coefficient_of_variation")
    reasons = {
        "INSUFFICIENT_ACTIVE_WEEKS": F.col("pre_active_session_weeks") < thresholds.min_active_weeks,
        "INSUFFICIENT_PRE_SESSIONS": F.col(names["sessions"]) < thresholds.min_sessions,
        "INSUFFICIENT_PRE_TRANSACTIONS": F.col(names["transactions"]) < thresholds.min_transactions,
        "INSUFFICIENT_PRE_REVENUE": F.col("pre_revenue_usd") < thresholds.min_revenue_usd,
        "UNDEFINED_PRE_REVENUE_VARIATION": cv.isNull(),
        "UNSTABLE_PRE_REVENUE": cv > thresholds.max_revenue_cv,
    }
    first_reason = F.coalesce(*[F.when(bad, F.lit(reason)) for reason, bad in reasons.items()])
    return profile.withColumns(
        {
            "meets_initial_eligibility": first_reason.isNull(),
            "eligibility_status": F.coalesce(first_reason, F.lit("ELIGIBLE")),
        }
    )


GEO_KEYS = ["geo_country", "geo_region"]


def geo_key(country: Column, region: Column) -> Column:
    return F.concat(country, F.lit(" | "), region)


def geo_profile(geo_sessions: DataFrame, config: GeoConfig = GeoConfig()) -> DataFrame:
    """Pre- and test-period figures of every valid geography, with its eligibility.

    Input: the output of ``normalize_geo_sessions``.
    """
    usable = geo_sessions.where("is_valid_geography")
    panel = balanced_panel(usable, GEO_KEYS, config.window, profile_measures())
    test = F.col("period_name") == "TEST"
    pre = _pre_measures(
        "session_count", "canonical_transaction_count", "canonical_revenue_usd", CANDIDATE_NAMES
    )
    test_side = {
        "test_active_session_weeks": rows_where(test & (F.col("session_count") > 0)),
        "test_sessions": sum_where(test, F.col("session_count")),
        "test_transactions": sum_where(test, F.col("canonical_transaction_count")),
        "test_revenue_usd": sum_where(test, F.col("canonical_revenue_usd"), 0.0),
    }
    figures = panel.groupBy(*GEO_KEYS).agg(
        F.count(F.lit(1)).alias("total_panel_weeks"),
        *[c.alias(name) for name, c in {**pre, **test_side}.items()],
    )
    users = usable.groupBy(*GEO_KEYS).agg(F.count_distinct("user_pseudo_id").alias("distinct_users"))
    profile = (
        figures.join(users, GEO_KEYS, "left")
        .withColumn("geo_key", geo_key(F.col("geo_country"), F.col("geo_region")))
        .withColumns(_pre_rates(CANDIDATE_NAMES))
    )
    return eligibility(profile, config.thresholds)


def geo_coverage(geo_sessions: DataFrame) -> DataFrame:
    """Share of sessions, transactions and revenue with a usable geography, one row."""
    usable = F.col("is_valid_geography")
    t, r = F.col("canonical_transaction_count"), F.col("canonical_revenue_usd")
    share = lambda a, b: F.round(ratio(F.col(a), F.col(b)), 4)
    sums = geo_sessions.agg(
        F.count(F.lit(1)).alias("sessions_in_analysis_window"),
        rows_where(usable).alias("sessions_with_valid_geography"),
        F.sum(t).alias("total_transactions"),
        sum_where(usable, t).alias("transactions_with_valid_geography"),
        F.sum(r).alias("_revenue"),
        sum_where(usable, r, 0.0).alias("_valid_revenue"),
    )
    return sums.select(
        "sessions_in_analysis_window",
        "sessions_with_valid_geography",
        share("sessions_with_valid_geography", "sessions_in_analysis_window").alias(
            "valid_geography_session_share"
        ),
        "total_transactions",
        "transactions_with_valid_geography",
        share("transactions_with_valid_geography", "total_transactions").alias(
            "valid_geography_transaction_share"
        ),
        F.round("_revenue", 2).alias("total_revenue_usd"),
        F.round("_valid_revenue", 2).alias("revenue_with_valid_geography_usd"),
        share("_valid_revenue", "_revenue").alias("valid_geography_revenue_share"),
    )


def country_feasibility(profile: DataFrame) -> DataFrame:
    renamed = {
        "test_sessions": "historical_test_window_sessions",
        "test_transactions": "historical_test_window_transactions",
    }
    return (
        profile.groupBy("geo_country")
        .agg(
            F.count(F.lit(1)).alias("profiled_regions"),
            rows_where(F.col("meets_initial_eligibility")).alias("eligible_regions"),
            F.sum("pre_sessions").alias("pre_sessions"),
            F.sum("pre_transactions").alias("pre_transactions"),
            F.round(F.sum("pre_revenue_usd"), 2).alias("pre_revenue_usd"),
            F.round(ratio(F.sum("pre_transactions"), F.sum("pre_sessions")), 4).alias("pre_transaction_rate"),
            *[F.sum(c).alias(name) for c, name in renamed.items()],
            F.round(F.sum("test_revenue_usd"), 2).alias("historical_test_window_revenue_usd"),
        )
        .orderBy(F.desc("eligible_regions"), F.desc("pre_revenue_usd"))
    )


# Column of the candidate list -> digits, None for columns shown as they are.
CANDIDATE_COLUMNS = {
    "geo_country": None,
    "geo_region": None,
    "geo_key": None,
    "total_panel_weeks": None,
    "distinct_users": None,
    "pre_active_session_weeks": None,
    "pre_transaction_active_weeks": None,
    "pre_sessions": None,
    "pre_transactions": None,
    "pre_revenue_usd": 2,
    "pre_average_weekly_revenue_usd": 2,
    "pre_weekly_revenue_stddev_usd": 2,
    "pre_revenue_coefficient_of_variation": 4,
    "pre_zero_revenue_weeks": None,
    "pre_transaction_rate": 4,
    "pre_revenue_per_session_usd": 4,
    "test_active_session_weeks": None,
    "test_sessions": None,
    "test_transactions": None,
    "test_revenue_usd": 2,
    "meets_initial_eligibility": None,
    "eligibility_status": None,
}


def region_candidates(profile: DataFrame) -> DataFrame:
    """Ranked list of geographies, eligible ones first, then by pre-period revenue."""
    order = [
        F.desc("meets_initial_eligibility"),
        F.desc("pre_revenue_usd"),
        F.col("geo_country"),
        F.col("geo_region"),
    ]
    in_country = Window.partitionBy("geo_country").orderBy(F.desc("pre_revenue_usd"))
    listed = numbered(profile, order, "display_order")
    return (
        listed.withColumn("country_pre_revenue_rank", F.dense_rank().over(in_country))
        .select(
            "display_order",
            "country_pre_revenue_rank",
            *[
                F.col(c) if digits is None else F.round(c, digits).alias(c)
                for c, digits in CANDIDATE_COLUMNS.items()
            ],
        )
        .orderBy("display_order")
    )


def target_sessions(sessions: DataFrame, config: GeoConfig) -> DataFrame:
    """Sessions of the target country with a usable region."""
    return normalize_geo_sessions(sessions, config.window).where(
        (F.col("geo_country") == config.target_country) & valid_geography(F.col("geo_region"))
    )


def geo_weekly_outcomes(sessions: DataFrame, config: GeoConfig = GeoConfig()) -> DataFrame:
    """Region-week outcome fact of the target country.

    The pre-period profile of a region is a window over its own few weeks, on the partitioning
    the panel already has; no join back is needed.
    """
    panel = week_numbers(
        balanced_panel(target_sessions(sessions, config), ["geo_region"], config.window, outcome_measures()),
        config.window,
    )
    own_weeks = Window.partitionBy("geo_region")
    pre = _pre_measures(
        "observed_session_count", "observed_transaction_count", "observed_revenue_usd", OUTCOME_NAMES
    )
    profiled = panel.withColumns({name: c.over(own_weeks) for name, c in pre.items()}).withColumns(
        _pre_rates(OUTCOME_NAMES)
    )
    per = lambda a, b: ratio(F.col(f"observed_{a}"), F.col(f"observed_{b}"))
    return eligibility(profiled, config.thresholds, OUTCOME_NAMES).select(
        geo_key(F.lit(config.target_country), F.col("geo_region")).alias("geo_key"),
        F.lit(config.target_country).alias("geo_country"),
        "geo_region",
        "week_start_date",
        "week_end_date",
        "analysis_week_number",
        "period_name",
        "period_week_number",
        *outcome_measures(),
        per("engaged_sessions", "session_count").alias("observed_engagement_rate"),
        per("transaction_count", "session_count").alias("observed_transaction_rate"),
        per("revenue_usd", "session_count").alias("observed_revenue_per_session_usd"),
        per("revenue_usd", "transaction_count").alias("observed_average_order_value_usd"),
        *pre,
        *_pre_rates(OUTCOME_NAMES),
        "meets_initial_eligibility",
        "eligibility_status",
        F.lit("PUBLIC_GA4_OBSERVED").alias("data_origin"),
        F.lit("UNASSIGNED").alias("treatment_assignment_status"),
        F.lit(False).alias("is_synthetic_outcome"),
    )


PRE_PANEL_COLUMNS = [
    "geo_key",
    "geo_country",
    "geo_region",
    "week_start_date",
    "week_end_date",
    "analysis_week_number",
    "period_week_number",
    "observed_session_count",
    "observed_unique_users",
    "observed_engaged_sessions",
    "observed_new_user_sessions",
    "observed_transaction_count",
    "observed_revenue_usd",
    "observed_item_quantity",
    "observed_transaction_rate",
    "observed_revenue_per_session_usd",
    "observed_average_order_value_usd",
    "pre_session_count",
    "pre_transaction_count",
    "pre_revenue_usd",
    "pre_revenue_coefficient_of_variation",
    "data_origin",
    "treatment_assignment_status",
    "is_synthetic_outcome",
]


def eligible_pre_panel(outcomes: DataFrame) -> DataFrame:
    """PRE weeks of the eligible regions: all that matching may look at."""
    return (
        outcomes.where(F.col("meets_initial_eligibility") & (F.col("period_name") == "PRE"))
        .select(*PRE_PANEL_COLUMNS)
        .orderBy("geo_region", "week_start_date")
    )


def outcome_matrix(panel: DataFrame, measure: str, regions: list[str]) -> DataFrame:
    """Week x region matrix of one measure for the named regions, for output."""
    return (
        panel.groupBy("week_start_date")
        .pivot("geo_region", regions)
        .agg(F.first(measure))
        .orderBy("week_start_date")
    )
