"""Conflict-aware, deduplicated transactions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from journeyloom.config import SkewConfig
from journeyloom.functions.calendar import whole_seconds
from journeyloom.operators.skew import lookup_join
from journeyloom.sources.workspace import settle

RELIABLE = "RELIABLE_TRANSACTION_ID"
CONFLICTING = "FALLBACK_CONFLICTING_TRANSACTION_ID"
NOT_SET = "FALLBACK_NOT_SET"
MISSING = "FALLBACK_MISSING_ID"

# Key method -> prefix of the transaction key.
KEY_PREFIX = {
    RELIABLE: "TRANSACTION_ID|",
    CONFLICTING: "CONFLICTING_ID|",
    NOT_SET: "NOT_SET|",
    MISSING: "MISSING_ID|",
}

CONTEXT = [
    "event_source",
    "event_medium",
    "event_campaign",
    "first_user_source",
    "first_user_medium",
    "first_user_campaign",
    "page_location",
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

PURCHASE_COLUMNS = [
    "source_event_fingerprint",
    "event_date",
    "event_timestamp_utc",
    "event_timestamp_micros",
    "user_pseudo_id",
    "ga_session_id",
    "ga_session_number",
    "session_key",
    "transaction_id_raw",
    "transaction_id_normalized",
    "transaction_id_status",
    "ecommerce_purchase_revenue_in_usd",
    "ecommerce_total_item_quantity",
    "item_record_count",
    "currency",
] + CONTEXT

PROFILE_COLUMNS = [
    "transaction_id_purchase_event_rows",
    "transaction_id_distinct_users",
    "transaction_id_distinct_revenue_values",
]


def purchase_events(staged: DataFrame) -> DataFrame:
    return staged.where("is_purchase_event").select(*PURCHASE_COLUMNS)


def transaction_id_profile(purchases: DataFrame) -> DataFrame:
    """Rows, users and revenue values behind every valid ID; NULLs are not counted as values."""
    return (
        purchases.where(F.col("transaction_id_status") == "VALID")
        .groupBy("transaction_id_normalized")
        .agg(
            F.count(F.lit(1)).alias("transaction_id_purchase_event_rows"),
            F.count_distinct("user_pseudo_id").alias("transaction_id_distinct_users"),
            F.count_distinct(F.round("ecommerce_purchase_revenue_in_usd", 6)).alias(
                "transaction_id_distinct_revenue_values"
            ),
        )
    )


def classify_key_method(
    purchases: DataFrame, profile: DataFrame, skew: SkewConfig = SkewConfig()
) -> DataFrame:
    """Say per purchase row whether its ID can be trusted."""
    profiled = lookup_join(
        purchases,
        profile,
        key="transaction_id_normalized",
        weight="transaction_id_purchase_event_rows",
        spread=F.col("source_event_fingerprint"),
        skew=skew,
    )
    valid = F.col("transaction_id_status") == "VALID"
    one_story = (F.col("transaction_id_distinct_users") == 1) & (
        F.col("transaction_id_distinct_revenue_values") < 2
    )
    return profiled.withColumn(
        "transaction_key_method",
        F.when(valid & one_story, RELIABLE)
        .when(valid, CONFLICTING)
        .when(F.col("transaction_id_status") == "NOT_SET", NOT_SET)
        .otherwise(MISSING),
    )


def assign_transaction_key(classified: DataFrame) -> DataFrame:
    """The ID itself where it is reliable, the event fingerprint otherwise, with a prefix each."""
    method = F.col("transaction_key_method")
    prefix = F.create_map(*[F.lit(x) for pair in KEY_PREFIX.items() for x in pair])[method]
    identity = F.when(method == RELIABLE, F.col("transaction_id_normalized")).otherwise(
        F.col("source_event_fingerprint")
    )
    return classified.withColumn("transaction_key", F.concat(prefix, identity))


def _keep(df: DataFrame) -> DataFrame:
    return settle(df, "purchases")


def fct_transactions(
    staged: DataFrame,
    skew: SkewConfig = SkewConfig(),
    hold: Callable[[DataFrame], DataFrame] = _keep,
) -> DataFrame:
    """One row per canonical transaction: the earliest measurement of every key.

    Purchases are a small part of the events but lie in every file, so they are read out of the
    events once and held (written to the shared folder by default) for the profile and the join;
    so is the profile, which serves hot and ordinary IDs separately.

    The choice is an aggregate (smallest struct), not a window.  It combines before the shuffle,
    so a transaction repeated a million times is one row per map task by then, and the struct
    carries all columns, which makes the result independent of the input order.
    """
    purchases = hold(purchase_events(staged))
    profile = hold(transaction_id_profile(purchases))
    keyed = assign_transaction_key(classify_key_method(purchases, profile, skew))
    order = ["event_timestamp_utc", "event_timestamp_micros", "source_event_fingerprint"]
    rest = [c for c in keyed.columns if c not in order and c != "transaction_key"]
    collapsed = keyed.groupBy("transaction_key").agg(
        F.count(F.lit(1)).alias("measurement_event_rows"),
        F.min("event_timestamp_utc").alias("first_measurement_timestamp_utc"),
        F.max("event_timestamp_utc").alias("last_measurement_timestamp_utc"),
        F.min(F.struct(*order, *rest)).alias("_first"),
    )
    kept = collapsed.select("*", "_first.*")
    return kept.select(
        "transaction_key",
        "transaction_key_method",
        F.col("event_date").alias("transaction_date"),
        F.col("event_timestamp_utc").alias("transaction_timestamp_utc"),
        F.col("event_timestamp_micros").alias("transaction_timestamp_micros"),
        F.col("source_event_fingerprint").alias("canonical_source_event_fingerprint"),
        "user_pseudo_id",
        "ga_session_id",
        "ga_session_number",
        "session_key",
        "transaction_id_raw",
        "transaction_id_normalized",
        "transaction_id_status",
        F.col("ecommerce_purchase_revenue_in_usd").alias("transaction_revenue_usd"),
        F.col("currency").alias("transaction_currency"),
        F.col("ecommerce_total_item_quantity").alias("transaction_item_quantity"),
        "item_record_count",
        "measurement_event_rows",
        (F.col("measurement_event_rows") - 1).alias("duplicate_measurement_rows"),
        "first_measurement_timestamp_utc",
        "last_measurement_timestamp_utc",
        whole_seconds(
            F.col("last_measurement_timestamp_utc"), F.col("first_measurement_timestamp_utc")
        ).alias("measurement_span_seconds"),
        *PROFILE_COLUMNS,
        (F.coalesce("transaction_id_distinct_users", F.lit(0)) > 1).alias(
            "transaction_id_cross_user_conflict"
        ),
        (F.coalesce("transaction_id_distinct_revenue_values", F.lit(0)) > 1).alias(
            "transaction_id_revenue_conflict"
        ),
        (F.col("transaction_key_method") != RELIABLE).alias("uses_fallback_transaction_key"),
        *CONTEXT,
    )
