"""Shape the given tables into the inputs of the library: nested events and geo sessions.

Deterministic and built from integers and strings, so that the SQL side can repeat every rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from journeyloom.sources.workspace import freed_shuffles, settle

# Event type of the given table -> event name.
EVENT_NAMES = {
    "purchase": "purchase",
    "view": "view_item",
    "click": "add_to_cart",
    "signup": "first_visit",
    "error": "page_view",
}

# K % 10 -> (source, medium, campaign); 0 and 1 have none.
ACQUISITION = {
    2: ("google", "organic", None),
    3: ("google", "organic", "brand"),
    4: ("google", "cpc", "spring"),
    5: ("partner", "referral", None),
    6: ("partner", "referral", "deal"),
    7: ("news", "email", "weekly"),
    8: ("aff", "affiliate", None),
    9: ("x", "other", None),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _value(text: Column | None = None, whole: Column | None = None, double: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        (null if text is None else text).cast("string").alias("string_value"),
        (null if whole is None else whole).cast("bigint").alias("int_value"),
        null.cast("double").alias("float_value"),
        (null if double is None else double).cast("double").alias("double_value"),
    )


def _param(key: str, value: Column, present: Column | None = None) -> Column:
    entry = F.struct(F.lit(key).alias("key"), value.alias("value"))
    return entry if present is None else F.when(present, entry)


def _acquisition(place: int) -> Column:
    out = None
    for residue, values in ACQUISITION.items():
        hit = F.col("k") % 10 == residue
        out = F.when(hit, F.lit(values[place])) if out is None else out.when(hit, F.lit(values[place]))
    return out


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated item field of an event: the lines of the orders with its number.

    There are more orders than events, so order numbers count modulo the number of events.
    """
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    item = F.struct(
        F.when(F.col("l_partkey") % 13 != 0, F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("item_id"),
        F.when(F.col("l_partkey") % 11 != 0, F.concat(F.lit(" Part "), F.col("l_partkey").cast("string"))).alias(
            "item_name"
        ),
        F.concat(F.lit("B"), F.col("l_suppkey").cast("string")).alias("item_brand"),
        F.col("l_returnflag").alias("item_variant"),
        F.col("l_linestatus").alias("item_category"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_linenumber") != 7, F.floor("l_extendedprice").cast("double")).alias("price_in_usd"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_extendedprice").alias("item_revenue"),
        F.when(F.col("l_linenumber") < 5, F.floor("l_extendedprice").cast("double")).alias("item_revenue_in_usd"),
    )
    total = table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("_events"))  # one row
    # The lines of an event lie anywhere, so gathering them before the exchange would sort and spill nearly
    # all of them for nothing: plain columns are exchanged, items are made and gathered behind it.
    lines = (
        table(spark, sf_dir, "lineitem")
        .crossJoin(F.broadcast(total))
        .select(
            (F.col("l_orderkey") % F.col("_events")).alias("event_id"),
            *order,
            "l_quantity",
            "l_returnflag",
            "l_linestatus",
        )
        .repartition("event_id")
    )
    return (
        lines.groupBy("event_id")
        .agg(F.sort_array(F.collect_list(F.struct(*order, item.alias("item")))).alias("_lines"))
        .select("event_id", F.col("_lines.item").alias("items"))
    )


_written: dict[tuple[str, str], DataFrame] = {}


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested event export, written once per session as the table the library starts from."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        with freed_shuffles(spark):
            _written[key] = settle(shape_events(spark, sf_dir), "nested_events", "zstd")
    return _written[key]


def shape_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested events built from events, customer, nation, region and line items."""
    geo = (
        table(spark, sf_dir, "customer")
        .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("user_id"), "r_name", "n_name", "c_mktsegment")
    )
    events = (
        table(spark, sf_dir, "events")
        .join(geo, "user_id", "left")
        .join(line_items(spark, sf_dir), "event_id", "left")
    )
    names = F.create_map(*[F.lit(x) for pair in EVENT_NAMES.items() for x in pair])
    events = events.withColumns(
        {
            "k": F.regexp_extract("props", "[0-9]+", 0).cast("int"),
            "at": F.col("ts").cast("timestamp"),
            "event_name": names[F.col("event_type")],
            "uid": F.col("user_id").cast("string"),
        }
    )
    k, buys = F.col("k"), F.col("event_type") == "purchase"
    day = F.date_format("at", "yyyyMMdd")
    text = lambda c: c.cast("string")
    tail = k % 10
    transaction_id = F.when(
        buys,
        F.when(tail == 0, F.when(k % 20 == 0, "(not set)").otherwise("NOT SET\t"))
        .when(tail == 1, F.when(k % 20 == 1, F.lit(None).cast("string")).otherwise(" \t"))
        .when(tail == 2, F.concat(F.lit("X"), text(k)))
        .otherwise(F.concat(F.lit(" T"), F.col("uid"), F.lit("-"), text(k), F.lit("\n"))),
    )
    revenue = F.when(
        buys, F.when(tail == 2, (F.col("event_id") % 500).cast("double")).otherwise(k.cast("double"))
    )
    session_no = day.cast("bigint")
    params = F.array_compact(
        F.array(
            _param("ga_session_id", _value(text=text(session_no)), tail == 9),
            _param("ga_session_id", _value(whole=session_no), tail != 9),
            _param("ga_session_number", _value(whole=F.dayofmonth("at"))),
            # A repeated key: the largest value counts, the first one in profiles.
            _param("ga_session_number", _value(whole=F.lit(1)), k % 17 == 0),
            _param("session_engaged", _value(text=F.lit("1")), k % 3 == 0),
            _param("session_engaged", _value(whole=F.lit(0)), k % 3 == 1),
            _param("session_engaged", _value(double=F.lit(1.0)), k % 6 == 2),
            _param("engagement_time_msec", _value(whole=F.col("event_id") % 1000), k % 2 == 0),
            _param("source", _value(text=_acquisition(0)), tail > 1),
            _param("medium", _value(text=_acquisition(1)), tail > 1),
            _param("campaign", _value(text=_acquisition(2)), tail > 1),
            _param("page_location", _value(text=F.concat(F.lit("https://shop.example/p/"), text(k))), k % 7 != 0),
            _param("page_title", _value(text=F.concat(F.lit("Page "), text(k))), k % 7 != 0),
            _param("currency", _value(text=F.lit("USD")), buys & (k % 50 != 49)),
            _param("value", _value(double=revenue), buys & (k % 2 == 0)),
            _param("value", _value(text=text(k + 1)), buys & (k % 4 == 1)),
            _param("value", _value(whole=k), buys & (k % 4 == 3)),
            _param("transaction_id", _value(text=transaction_id), buys & (k % 4 != 3)),
            _param("transaction_id", _value(whole=k), buys & (k % 4 == 3)),
        )
    )
    user = F.col("user_id")
    known = user % 10 != 0
    return events.select(
        day.alias("event_date"),
        F.unix_micros("at").alias("event_timestamp"),
        "event_name",
        F.col("uid").alias("user_pseudo_id"),
        F.col("event_id").alias("event_bundle_sequence_id"),
        F.when(k % 5 != 0, (k % 5).cast("bigint")).alias("event_server_timestamp_offset"),
        F.lit("WEB").alias("platform"),
        params.alias("event_params"),
        F.struct(
            F.when(user % 4 == 1, "launch").alias("name"),
            F.when(user % 4 != 0, F.when(user % 4 == 1, "cpc").otherwise("organic")).alias("medium"),
            F.when(user % 4 != 0, "google").alias("source"),
        ).alias("traffic_source"),
        F.struct(
            transaction_id.alias("transaction_id"),
            revenue.alias("purchase_revenue"),
            revenue.alias("purchase_revenue_in_usd"),
            F.when(buys & (k % 9 != 0), F.coalesce(F.array_size("items"), F.lit(0)).cast("bigint")).alias(
                "total_item_quantity"
            ),
        ).alias("ecommerce"),
        "items",
        F.struct(
            F.when(known, F.col("r_name")).otherwise("(not set)").alias("country"),
            F.when(known, F.col("n_name")).otherwise(" ").alias("region"),
            F.col("c_mktsegment").alias("city"),
        ).alias("geo"),
        F.struct(
            F.when(user % 3 == 0, "mobile").otherwise("desktop").alias("category"),
            F.when(user % 3 == 0, "Android").otherwise("Windows").alias("operating_system"),
            F.struct(F.when(user % 2 == 0, "Chrome").otherwise("Firefox").alias("browser")).alias("web_info"),
        ).alias("device"),
        F.struct(
            F.lit("Yes").alias("analytics_storage"),
            F.when(k % 2 == 0, "Yes").otherwise("No").alias("ads_storage"),
            F.lit("No").alias("uses_transient_token"),
        ).alias("privacy_info"),
    )


def geo_sessions(spark: SparkSession, sf_dir: str, one_market: bool = True) -> DataFrame:
    """Every order as a session of its customer, with the customer's nation as region.

    ``one_market`` puts all nations into one country; otherwise the region name is the country.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    places = (
        table(spark, sf_dir, "customer")
        .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("o_custkey"), "r_name", "n_name")
    )
    sold = F.col("o_orderstatus") != "P"
    country = F.lit(" World ") if one_market else F.col("r_name")
    return (
        table(spark, sf_dir, "orders")
        .join(places, "o_custkey", "left")
        .select(
            key.cast("string").alias("session_key"),
            customer.cast("string").alias("user_pseudo_id"),
            F.to_date("o_orderdate").alias("session_date"),
            F.when(customer % 40 == 7, "").otherwise(country).alias("geo_country"),
            F.when(customer % 30 == 3, "Unknown").otherwise(F.col("n_name")).alias("geo_region"),
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_engaged_session"),
            (F.col("o_orderstatus") == "O").alias("is_new_user_session"),
            (key % 7).alias("view_item_event_count"),
            (key % 3).alias("add_to_cart_event_count"),
            (key % 2).alias("begin_checkout_event_count"),
            F.when(sold, 1).otherwise(0).cast("bigint").alias("canonical_transaction_count"),
            F.when(sold, F.floor("o_totalprice").cast("double")).otherwise(0.0).alias("canonical_revenue_usd"),
            F.when(sold, key % 5 + 1).alias("canonical_item_quantity"),
        )
    )
