"""Hand-made nested events and facts."""

from __future__ import annotations

import datetime as dt

EVENT_SCHEMA = """
event_date string, event_timestamp bigint, event_name string, user_pseudo_id string,
event_bundle_sequence_id bigint, event_server_timestamp_offset bigint, platform string,
event_params array<struct<key:string,value:struct<string_value:string,int_value:bigint,float_value:double,double_value:double>>>,
traffic_source struct<name:string,medium:string,source:string>,
ecommerce struct<transaction_id:string,purchase_revenue:double,purchase_revenue_in_usd:double,total_item_quantity:bigint>,
items array<struct<item_id:string,item_name:string,item_brand:string,item_variant:string,item_category:string,
  price:double,price_in_usd:double,quantity:bigint,item_revenue:double,item_revenue_in_usd:double>>,
geo struct<country:string,region:string,city:string>,
device struct<category:string,operating_system:string,web_info:struct<browser:string>>,
privacy_info struct<analytics_storage:string,ads_storage:string,uses_transient_token:string>
"""


def text(v):
    return (v, None, None, None)


def whole(v):
    return (None, v, None, None)


def floating(v):
    return (None, None, v, None)


def double(v):
    return (None, None, None, v)


def micros(day: int, second: int = 0) -> int:
    moment = dt.datetime(2020, 11, day, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=second)
    return int(moment.timestamp()) * 1_000_000


def event(
    seq, name="page_view", user="u1", day=1, second=0, params=(), tx=None, revenue=None, items=(), source=None
):
    return (
        f"202011{day:02d}",
        micros(day, second),
        name,
        user,
        seq,
        None,
        "WEB",
        list(params),
        ("c", "m", source),
        (tx, revenue, revenue, None),
        items if items is None else list(items),
        ("United States", "Ohio", "X"),
        ("desktop", "Linux", ("Chrome",)),
        ("Yes", "Yes", "No"),
    )


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def session(n):
    return ("ga_session_id", whole(n))


TX_SCHEMA = """
transaction_key string, transaction_key_method string, transaction_id_status string, transaction_date date,
transaction_timestamp_utc timestamp, user_pseudo_id string, session_key string, ga_session_id bigint,
ga_session_number bigint, transaction_revenue_usd double, transaction_currency string,
transaction_item_quantity bigint, item_record_count int, measurement_event_rows bigint,
duplicate_measurement_rows bigint, uses_fallback_transaction_key boolean
"""
SESSION_SCHEMA = """
session_key string, user_pseudo_id string, ga_session_id bigint, ga_session_number bigint, session_date date,
session_start_timestamp_utc timestamp, session_end_timestamp_utc timestamp, attribution_timestamp_utc timestamp,
session_duration_seconds bigint, session_source string, session_medium string, session_campaign string,
session_channel_group string, first_user_source string, first_user_medium string, first_user_campaign string,
event_count bigint, page_view_count bigint, view_item_event_count bigint, add_to_cart_event_count bigint,
begin_checkout_event_count bigint, raw_purchase_measurement_event_count bigint,
total_engagement_time_seconds double, is_engaged_session boolean, is_new_user_session boolean,
entry_page_location string, entry_page_title string, geo_country string, geo_region string, geo_city string,
device_category string, device_operating_system string, device_browser string, analytics_storage string,
ads_storage string, uses_transient_token string
"""


def transaction(key, user, at: dt.datetime, session_key, revenue=100.0):
    return (
        key, "RELIABLE_TRANSACTION_ID", "VALID", at.date(), at, user, session_key, 1, 1, revenue, "USD", 1, 1, 1, 0, False,
    )


def visit(key, user, at: dt.datetime, channel="Email", source="news", medium="email"):
    return (
        key, user, 1, 1, at.date(), at, at, at, 0, source, medium, "(not set)", channel, None, None, None,
        1, 1, 0, 0, 0, 0, 1.0, True, False, None, None, None, None, None, None, None, None, None, None, None,
    )
