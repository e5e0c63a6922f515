"""Session fact: one shuffle chain on the session key for counters, timing and first/last records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from journeyloom.functions.calendar import whole_seconds
from journeyloom.functions.numeric import ratio, rows_where
from journeyloom.functions.text import blank_to_null

# Counter column -> event name.
EVENT_COUNTERS = {
    "session_start_event_count": "session_start",
    "first_visit_event_count": "first_visit",
    "page_view_count": "page_view",
    "scroll_event_count": "scroll",
    "user_engagement_event_count": "user_engagement",
    "view_item_event_count": "view_item",
    "view_item_list_event_count": "view_item_list",
    "select_item_event_count": "select_item",
    "add_to_cart_event_count": "add_to_cart",
    "begin_checkout_event_count": "begin_checkout",
    "add_shipping_info_event_count": "add_shipping_info",
    "add_payment_info_event_count": "add_payment_info",
    "raw_purchase_measurement_event_count": "purchase",
}

FIRST_EVENT_FIELDS = [
    "first_user_source",
    "first_user_medium",
    "first_user_campaign",
    "geo_country",
    "geo_region",
    "geo_city",
    "device_category",
    "device_operating_system",
    "device_browser",
    "analytics_storage",
    "ads_storage",
    "uses_transient_token",
]

# Time first; the other two settle ties, which the source leaves open.
EVENT_ORDER = ["event_timestamp_micros", "event_bundle_sequence_id", "event_name"]

DIRECT_SOURCE, DIRECT_MEDIUM, UNSET = "(direct)", "(none)", "(not set)"

# Channel labels in the order in which they are tried, after Direct.
# "is" compares whole words, "has" looks for a part, "re" is a regular expression.
CHANNEL_RULES = (
    ("Paid Search", "is", ("cpc", "ppc", "paid search", "paid_search", "paidsearch")),
    ("Organic Search", "has", ("organic",)),
    ("Paid Social", "re", ("paid.*social|social.*paid",)),
    ("Organic Social", "has", ("social",)),
    ("Display", "has", ("display", "banner", "cpm")),
    ("Email", "has", ("email",)),
    ("Affiliate", "has", ("affiliate",)),
    ("Referral", "has", ("referral",)),
)
DIRECT_CHANNEL, OTHER_CHANNEL = "Direct", "Other"
CHANNEL_LABELS = (DIRECT_CHANNEL, *(label for label, _, _ in CHANNEL_RULES), OTHER_CHANNEL)


def _matches(word: Column, how: str, wanted: tuple[str, ...]) -> Column:
    if how == "is":
        return word.isin(*wanted)
    test = word.rlike if how == "re" else word.contains
    hit = test(wanted[0])
    for w in wanted[1:]:
        hit = hit | test(w)
    return hit


def _first_rule(source: Column, medium: Column, direct: str, values: dict[str, str], other: str) -> Column:
    """The value of the first rule that applies."""
    word = F.lower(medium)
    out = F.when((source == DIRECT_SOURCE) & (medium == DIRECT_MEDIUM), direct)
    for name, how, wanted in CHANNEL_RULES:
        out = out.when(_matches(word, how, wanted), values[name])
    return out.otherwise(other)


def channel_group(source: Column, medium: Column) -> Column:
    """Channel label of a session; the first rule that applies wins."""
    return _first_rule(source, medium, DIRECT_CHANNEL, {name: name for name, _, _ in CHANNEL_RULES}, OTHER_CHANNEL)


def channel_rule(source: Column, medium: Column) -> Column:
    """The rule behind ``channel_group``, in words."""
    verbs = {"is": "medium is", "has": "medium has", "re": "medium matches"}
    told = {name: f"{verbs[how]} {', '.join(wanted)}" for name, how, wanted in CHANNEL_RULES}
    return _first_rule(source, medium, f"{DIRECT_SOURCE} / {DIRECT_MEDIUM}", told, "no rule")


def session_source_medium(source: Column, medium: Column, campaign: Column) -> dict[str, Column]:
    """Session source, medium and campaign with the direct rule and the fill for single gaps."""
    direct = source.isNull() & medium.isNull()
    return {
        "session_source": F.when(direct, DIRECT_SOURCE).otherwise(F.coalesce(source, F.lit(UNSET))),
        "session_medium": F.when(direct, DIRECT_MEDIUM).otherwise(F.coalesce(medium, F.lit(UNSET))),
        "session_campaign": F.coalesce(campaign, F.lit(UNSET)),
    }


def sessionize(staged: DataFrame) -> DataFrame:
    """Aggregate events to sessions.

    First and last records are the smallest and largest structs led by the event order, so they
    combine on the map side like the counters do.  Event names are a set of a few names per
    session, so one exchange by session does; a distinct count would aggregate twice.
    """
    source, medium, campaign = (
        blank_to_null(F.col(c)) for c in ("event_source", "event_medium", "event_campaign")
    )
    acquired = F.coalesce(source, medium, campaign).isNotNull()
    landed = blank_to_null(F.col("page_location")).isNotNull()
    page = F.when(landed, F.struct(*EVENT_ORDER, "page_location", "page_title"))
    ts = F.col("event_timestamp_utc")
    return (
        staged.where(F.col("session_key").isNotNull())
        .groupBy("session_key")
        .agg(
            F.max("user_pseudo_id").alias("user_pseudo_id"),
            F.max("ga_session_id").alias("ga_session_id"),
            F.max("ga_session_number").alias("ga_session_number"),
            F.min("event_date").alias("session_date"),
            F.min(ts).alias("session_start_timestamp_utc"),
            F.max(ts).alias("session_end_timestamp_utc"),
            F.count(F.lit(1)).alias("event_count"),
            F.size(F.collect_set("event_name")).cast("bigint").alias("distinct_event_name_count"),
            *[rows_where(F.col("event_name") == name).alias(out) for out, name in EVENT_COUNTERS.items()],
            F.sum(F.coalesce("engagement_time_msec", F.lit(0.0))).alias("total_engagement_time_msec"),
            (rows_where(F.col("session_engaged")) > 0).alias("is_engaged_session"),
            F.sum("item_record_count").alias("item_interaction_record_count"),
            F.min(
                F.when(
                    acquired,
                    F.struct(
                        *EVENT_ORDER,
                        ts.alias("at"),
                        source.alias("source"),
                        medium.alias("medium"),
                        campaign.alias("campaign"),
                    ),
                )
            ).alias("acquisition"),
            F.min(F.struct(*EVENT_ORDER, *FIRST_EVENT_FIELDS)).alias("first_event"),
            F.min(page).alias("entry_page"),
            F.max(page).alias("exit_page"),
        )
        .withColumn(
            "session_duration_seconds",
            whole_seconds(F.col("session_end_timestamp_utc"), F.col("session_start_timestamp_utc")),
        )
    )


def transactions_by_session(transactions: DataFrame) -> DataFrame:
    return (
        transactions.where(F.col("session_key").isNotNull())
        .groupBy("session_key")
        .agg(
            F.count(F.lit(1)).alias("canonical_transaction_count"),
            F.sum("transaction_revenue_usd").alias("canonical_revenue_usd"),
            F.sum(F.coalesce("transaction_item_quantity", F.lit(0))).alias("canonical_item_quantity"),
            rows_where(F.col("uses_fallback_transaction_key")).alias("fallback_transaction_count"),
            F.min("transaction_timestamp_utc").alias("first_transaction_timestamp_utc"),
            F.max("transaction_timestamp_utc").alias("last_transaction_timestamp_utc"),
        )
    )


def fct_sessions(staged: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row per session.

    Both inputs of the join are aggregates by session key and stay partitioned by it, so the
    join itself moves nothing.
    """
    joined = (
        sessionize(staged)
        .join(transactions_by_session(transactions), "session_key", "left")
        .fillna(0, ["canonical_transaction_count", "canonical_item_quantity", "fallback_transaction_count"])
        .fillna(0.0, ["canonical_revenue_usd"])
        .withColumns(
            session_source_medium(
                F.col("acquisition.source"), F.col("acquisition.medium"), F.col("acquisition.campaign")
            )
        )
    )
    msec, orders = F.col("total_engagement_time_msec"), F.col("canonical_transaction_count")
    return joined.select(
        "session_key",
        "user_pseudo_id",
        "ga_session_id",
        "ga_session_number",
        "session_date",
        "session_start_timestamp_utc",
        "session_end_timestamp_utc",
        "session_duration_seconds",
        "event_count",
        "distinct_event_name_count",
        *EVENT_COUNTERS,
        "total_engagement_time_msec",
        (msec / 1000.0).alias("total_engagement_time_seconds"),
        ratio(msec, F.col("event_count") * 1000.0).alias("average_engagement_seconds_per_event"),
        "is_engaged_session",
        (F.col("first_visit_event_count") > 0).alias("is_new_user_session"),
        "item_interaction_record_count",
        F.col("acquisition.at").alias("attribution_timestamp_utc"),
        "session_source",
        "session_medium",
        "session_campaign",
        channel_group(F.col("session_source"), F.col("session_medium")).alias("session_channel_group"),
        *[F.col(f"first_event.{c}").alias(c) for c in FIRST_EVENT_FIELDS if c.startswith("first_user")],
        F.col("entry_page.page_location").alias("entry_page_location"),
        F.col("entry_page.page_title").alias("entry_page_title"),
        F.col("exit_page.page_location").alias("exit_page_location"),
        F.col("exit_page.page_title").alias("exit_page_title"),
        "canonical_transaction_count",
        "canonical_revenue_usd",
        "canonical_item_quantity",
        ratio(F.col("canonical_revenue_usd"), orders).alias("average_order_value_usd"),
        "fallback_transaction_count",
        F.greatest(F.col("raw_purchase_measurement_event_count") - orders, F.lit(0)).alias(
            "duplicate_purchase_measurement_rows"
        ),
        (orders > 0).alias("is_converting_session"),
        "first_transaction_timestamp_utc",
        "last_transaction_timestamp_utc",
        *[F.col(f"first_event.{c}").alias(c) for c in FIRST_EVENT_FIELDS if not c.startswith("first_user")],
    )


def session_build_summary(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count(F.lit(1)).alias("session_rows"),
        F.count_distinct("user_pseudo_id").alias("unique_users"),
        F.sum("event_count").alias("represented_event_rows"),
        rows_where(F.col("is_converting_session")).alias("converting_sessions"),
        F.sum("canonical_transaction_count").alias("canonical_transactions"),
        F.sum("canonical_revenue_usd").alias("canonical_revenue_usd"),
        F.sum("duplicate_purchase_measurement_rows").alias("duplicate_purchase_measurement_rows"),
    )
