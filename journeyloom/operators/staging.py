"""Staging views: nested events to one row per event and one row per item.

Both are narrow projections.  Nothing is shuffled, and a consumer that reads five columns of the
event contract makes the scan read only the leaves behind those five.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from journeyloom.functions.calendar import day_from_suffix
from journeyloom.functions.params import EVENT_PARAMS, Param, largest_value
from journeyloom.functions.text import blank_to_null, pipe_join, sha256_hex, strip, tag

# Spellings of an unset transaction ID and of the engagement flag.
NOT_SET_SPELLINGS = ("(not set)", "not set", "not_set")
TRUE_SPELLINGS = ("1", "true", "yes")
FALSE_SPELLINGS = ("0", "false", "no")

# Output column -> path in the nested event.
GEO_DEVICE = {
    "geo_country": "geo.country",
    "geo_region": "geo.region",
    "geo_city": "geo.city",
    "device_category": "device.category",
    "device_operating_system": "device.operating_system",
    "device_browser": "device.web_info.browser",
}
FIRST_USER = {
    "first_user_source": "traffic_source.source",
    "first_user_medium": "traffic_source.medium",
    "first_user_campaign": "traffic_source.name",
}
PRIVACY = {
    "analytics_storage": "privacy_info.analytics_storage",
    "ads_storage": "privacy_info.ads_storage",
    "uses_transient_token": "privacy_info.uses_transient_token",
}
ITEM_PARAMS = tuple(
    p
    for p in EVENT_PARAMS
    if p.column
    in {"ga_session_id", "ga_session_number", "event_source", "event_medium", "event_campaign", "currency"}
)


def event_fingerprint(
    suffix: Column, user: Column, micros: Column, name: Column, bundle: Column, offset: Column
) -> Column:
    """Audit hash of an event; not promised to be unique."""
    or_null = lambda c: F.coalesce(c.cast("string"), F.lit("NULL"))
    return sha256_hex(
        pipe_join(suffix, or_null(user), micros.cast("string"), or_null(name), or_null(bundle), or_null(offset))
    )


def session_key(user: Column, session_id: Column) -> Column:
    """``user|session``; NULL as soon as either part is missing."""
    return pipe_join(blank_to_null(user), session_id.cast("string"))


def transaction_id_status(raw: Column) -> Column:
    clean = blank_to_null(raw)
    return (
        F.when(clean.isNull(), "MISSING")
        .when(F.lower(clean).isin(*NOT_SET_SPELLINGS), "NOT_SET")
        .otherwise("VALID")
    )


def transaction_id_normalized(raw: Column) -> Column:
    clean = blank_to_null(raw)
    return F.when(~F.lower(clean).isin(*NOT_SET_SPELLINGS), clean)


def engagement_flag(raw: Column) -> Column:
    word = F.lower(strip(raw))
    return F.when(word.isin(*TRUE_SPELLINGS), True).when(word.isin(*FALSE_SPELLINGS), False)


def extract_params(
    events: DataFrame, specs: tuple[Param, ...] = EVENT_PARAMS, params: str = "event_params"
) -> DataFrame:
    """Add one typed column per parameter and drop nothing."""
    return events.withColumns({s.column: largest_value(F.col(params), s.key, s.kind) for s in specs})


def _paths(mapping: dict[str, str]) -> list[Column]:
    return [F.col(path).alias(name) for name, path in mapping.items()]


def _event_identity() -> list[Column]:
    return [
        F.col("event_date").alias("source_table_suffix"),
        day_from_suffix(F.col("event_date")).alias("event_date"),
        F.timestamp_micros("event_timestamp").alias("event_timestamp_utc"),
        F.col("event_timestamp").alias("event_timestamp_micros"),
        F.col("event_name"),
        F.col("user_pseudo_id"),
        F.col("event_bundle_sequence_id"),
        F.col("event_server_timestamp_offset"),
        F.col("platform"),
    ]


def _fingerprint_of_row() -> Column:
    return event_fingerprint(
        F.col("source_table_suffix"),
        F.col("user_pseudo_id"),
        F.col("event_timestamp_micros"),
        F.col("event_name"),
        F.col("event_bundle_sequence_id"),
        F.col("event_server_timestamp_offset"),
    )


EVENT_COLUMNS = [
    "source_event_fingerprint",
    "source_table_suffix",
    "event_date",
    "event_timestamp_utc",
    "event_timestamp_micros",
    "event_name",
    "user_pseudo_id",
    "event_bundle_sequence_id",
    "event_server_timestamp_offset",
    "platform",
    "ga_session_id",
    "ga_session_number",
    "session_key",
    "session_engaged",
    "engagement_time_msec",
    "engaged_session_event",
    "debug_mode",
    "event_source",
    "event_medium",
    "event_campaign",
    "first_user_source",
    "first_user_medium",
    "first_user_campaign",
    "page_location",
    "page_title",
    "page_referrer",
    "geo_country",
    "geo_region",
    "geo_city",
    "device_category",
    "device_operating_system",
    "device_browser",
    "transaction_id_raw",
    "transaction_id_normalized",
    "transaction_id_status",
    "ecommerce_purchase_revenue",
    "ecommerce_purchase_revenue_in_usd",
    "ecommerce_total_item_quantity",
    "currency",
    "event_value",
    "item_record_count",
    "items_json",
    "gclid",
    "gclsrc",
    "dclid",
    "analytics_storage",
    "ads_storage",
    "uses_transient_token",
    "is_purchase_event",
    "has_user_pseudo_id",
    "has_session_id",
    "has_item_records",
    "has_click_identifier",
]


def items_json(items: Column) -> Column:
    """The repeated field as JSON; an absent array is an empty one, NULL fields are kept."""
    return F.coalesce(F.to_json(items, {"ignoreNullFields": "false"}), F.lit("[]"))


def stage_events(events: DataFrame) -> DataFrame:
    """The event contract: 53 columns, one row per source event."""
    flat = events.select(
        *_event_identity(),
        *_paths(GEO_DEVICE),
        *_paths(FIRST_USER),
        F.col("ecommerce.transaction_id").alias("transaction_id_raw"),
        F.col("ecommerce.purchase_revenue").alias("ecommerce_purchase_revenue"),
        F.col("ecommerce.purchase_revenue_in_usd").alias("ecommerce_purchase_revenue_in_usd"),
        F.col("ecommerce.total_item_quantity").alias("ecommerce_total_item_quantity"),
        # Of one leaf, as long as the array itself: a consumer that only counts items reads no others.
        F.coalesce(F.array_size("items.quantity"), F.lit(0)).alias("item_record_count"),
        items_json(F.col("items")).alias("items_json"),
        *_paths(PRIVACY),
        F.col("event_params"),
    )
    raw_id = F.col("transaction_id_raw")
    return (
        extract_params(flat)
        .withColumns(
            {
                "source_event_fingerprint": _fingerprint_of_row(),
                "session_key": session_key(F.col("user_pseudo_id"), F.col("ga_session_id")),
                "session_engaged": engagement_flag(F.col("session_engaged_raw")),
                "transaction_id_normalized": transaction_id_normalized(raw_id),
                "transaction_id_status": transaction_id_status(raw_id),
                "is_purchase_event": F.col("event_name") == "purchase",
                "has_user_pseudo_id": blank_to_null(F.col("user_pseudo_id")).isNotNull(),
                "has_session_id": F.col("ga_session_id").isNotNull(),
                "has_item_records": F.col("item_record_count") > 0,
                "has_click_identifier": F.coalesce("gclid", "gclsrc", "dclid").isNotNull(),
            }
        )
        .select(*EVENT_COLUMNS)
    )


ITEM_FIELDS = {
    "item_id": "item_id",
    "item_name": "item_name",
    "item_brand": "item_brand",
    "item_variant": "item_variant",
    "item_category": "item_category",
    "item_price": "price",
    "item_price_in_usd": "price_in_usd",
    "item_quantity": "quantity",
    "item_revenue": "item_revenue",
    "item_revenue_in_usd": "item_revenue_in_usd",
}

ITEM_COLUMNS = [
    "item_record_fingerprint",
    "source_event_fingerprint",
    "item_offset",
    "source_table_suffix",
    "event_date",
    "event_timestamp_utc",
    "event_timestamp_micros",
    "event_name",
    "event_bundle_sequence_id",
    "event_server_timestamp_offset",
    "platform",
    "user_pseudo_id",
    "ga_session_id",
    "ga_session_number",
    "session_key",
    "transaction_id_raw",
    "transaction_id_normalized",
    "transaction_id_status",
    "is_purchase_event",
    "event_purchase_revenue_in_usd",
    "event_total_item_quantity",
    "currency",
    "item_id",
    "item_id_normalized",
    "item_name",
    "item_name_normalized",
    "item_identity",
    "item_brand",
    "item_variant",
    "item_category",
    "item_price",
    "item_price_in_usd",
    "item_quantity",
    "item_revenue",
    "item_revenue_in_usd",
    "calculated_item_value_in_usd",
    "event_source",
    "event_medium",
    "event_campaign",
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
    "has_item_id",
    "has_item_name",
    "has_session_id",
]


def stage_items(events: DataFrame) -> DataFrame:
    """One row per item of an event; the position in the array is kept, counted from 0."""
    base = extract_params(
        events.select(
            *_event_identity(),
            *_paths(GEO_DEVICE),
            *_paths(FIRST_USER),
            *_paths(PRIVACY),
            F.col("ecommerce.transaction_id").alias("transaction_id_raw"),
            F.col("ecommerce.purchase_revenue_in_usd").alias("event_purchase_revenue_in_usd"),
            F.col("ecommerce.total_item_quantity").alias("event_total_item_quantity"),
            F.col("items"),
            F.col("event_params"),
        ),
        ITEM_PARAMS,
    ).drop("event_params")
    hashed = base.withColumn("source_event_fingerprint", _fingerprint_of_row())
    exploded = hashed.select(
        *[c for c in hashed.columns if c != "items"],
        F.posexplode("items").alias("item_offset", "_item"),
    )
    item_id = blank_to_null(F.col("item_id"))
    item_name = blank_to_null(F.col("item_name"))
    raw_id = F.col("transaction_id_raw")
    return (
        exploded.withColumns({name: F.col(f"_item.{leaf}") for name, leaf in ITEM_FIELDS.items()})
        .withColumns(
            {
                "item_record_fingerprint": sha256_hex(
                    pipe_join(F.col("source_event_fingerprint"), F.col("item_offset").cast("string"))
                ),
                "session_key": session_key(F.col("user_pseudo_id"), F.col("ga_session_id")),
                "transaction_id_normalized": transaction_id_normalized(raw_id),
                "transaction_id_status": transaction_id_status(raw_id),
                "is_purchase_event": F.col("event_name") == "purchase",
                "item_id_normalized": item_id,
                "item_name_normalized": item_name,
                "item_identity": F.coalesce(tag("ID:", item_id), tag("NAME:", item_name)),
                "calculated_item_value_in_usd": F.col("item_price_in_usd") * F.col("item_quantity"),
                "has_item_id": item_id.isNotNull(),
                "has_item_name": item_name.isNotNull(),
                "has_session_id": F.col("ga_session_id").isNotNull(),
            }
        )
        .select(*ITEM_COLUMNS)
    )
