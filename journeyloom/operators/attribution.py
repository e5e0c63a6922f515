"""Transaction-to-touchpoint bridge and attribution credits.

Credits split observed revenue by rule.  They describe journeys; they do not measure what a
channel caused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from journeyloom.config import AttributionConfig
from journeyloom.functions.calendar import DAY_MICROS, HOUR_MICROS, whole_seconds
from journeyloom.functions.numeric import ratio, rows_where
from journeyloom.operators.sessions import (
    DIRECT_CHANNEL,
    DIRECT_MEDIUM,
    DIRECT_SOURCE,
    OTHER_CHANNEL,
    UNSET,
)
from journeyloom.operators.skew import BROADCAST_ROWS, running_offsets
from journeyloom.sources.workspace import settle

# Bridge column -> column of the transaction fact.
FROM_TRANSACTION = {
    "transaction_key": "transaction_key",
    "transaction_key_method": "transaction_key_method",
    "transaction_id_status": "transaction_id_status",
    "transaction_date": "transaction_date",
    "transaction_timestamp_utc": "transaction_timestamp_utc",
    "user_pseudo_id": "user_pseudo_id",
    "transaction_session_key": "session_key",
    "transaction_ga_session_id": "ga_session_id",
    "transaction_ga_session_number": "ga_session_number",
    "transaction_revenue_usd": "transaction_revenue_usd",
    "transaction_currency": "transaction_currency",
    "transaction_item_quantity": "transaction_item_quantity",
    "transaction_item_record_count": "item_record_count",
    "measurement_event_rows": "measurement_event_rows",
    "duplicate_measurement_rows": "duplicate_measurement_rows",
    "uses_fallback_transaction_key": "uses_fallback_transaction_key",
}

# Bridge column -> column of the session fact.
FROM_SESSION = {
    "touchpoint_session_key": "session_key",
    "touchpoint_ga_session_id": "ga_session_id",
    "touchpoint_ga_session_number": "ga_session_number",
    "touchpoint_session_date": "session_date",
    "touchpoint_start_timestamp_utc": "session_start_timestamp_utc",
    "touchpoint_end_timestamp_utc": "session_end_timestamp_utc",
    "touchpoint_attribution_timestamp_utc": "attribution_timestamp_utc",
    "touchpoint_duration_seconds": "session_duration_seconds",
    "touchpoint_source": "session_source",
    "touchpoint_medium": "session_medium",
    "touchpoint_campaign": "session_campaign",
    "touchpoint_channel_group": "session_channel_group",
    "first_user_source": "first_user_source",
    "first_user_medium": "first_user_medium",
    "first_user_campaign": "first_user_campaign",
    "touchpoint_event_count": "event_count",
    "touchpoint_page_view_count": "page_view_count",
    "touchpoint_view_item_count": "view_item_event_count",
    "touchpoint_add_to_cart_count": "add_to_cart_event_count",
    "touchpoint_begin_checkout_count": "begin_checkout_event_count",
    "touchpoint_purchase_measurement_event_count": "raw_purchase_measurement_event_count",
    "touchpoint_engagement_seconds": "total_engagement_time_seconds",
    "is_engaged_touchpoint": "is_engaged_session",
    "is_new_user_touchpoint": "is_new_user_session",
    "touchpoint_entry_page_location": "entry_page_location",
    "touchpoint_entry_page_title": "entry_page_title",
    "touchpoint_geo_country": "geo_country",
    "touchpoint_geo_region": "geo_region",
    "touchpoint_geo_city": "geo_city",
    "touchpoint_device_category": "device_category",
    "touchpoint_operating_system": "device_operating_system",
    "touchpoint_browser": "device_browser",
    "touchpoint_analytics_storage": "analytics_storage",
    "touchpoint_ads_storage": "ads_storage",
    "touchpoint_uses_transient_token": "uses_transient_token",
}

TOUCHPOINT_FILL = {
    "touchpoint_source": UNSET,
    "touchpoint_medium": UNSET,
    "touchpoint_campaign": UNSET,
    "touchpoint_channel_group": OTHER_CHANNEL,
}


# Salts the rows of a crowded cell look their parts up by.
CELL_SALTS = 32


def data_bounds(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.min("session_date").alias("source_data_start_date"),
        F.max("session_date").alias("source_data_end_date"),
    )


def _time_cell(micros: Column, config: AttributionConfig) -> Column:
    return F.floor(micros / (config.cell_width_days * DAY_MICROS))


def _sides(transactions: DataFrame, sessions: DataFrame, config: AttributionConfig) -> tuple[DataFrame, DataFrame]:
    """Both sides with the user and time cell they meet in.

    A session lies in the one cell of its start, a transaction in every cell its lookback window touches.
    """
    reach = config.lookback_days * DAY_MICROS
    right = sessions.select(
        F.col("user_pseudo_id").alias("_user"),
        _time_cell(F.unix_micros("session_start_timestamp_utc"), config).alias("_cell"),
        *[F.col(c).alias(name) for name, c in FROM_SESSION.items()],
    ).where(F.col("_user").isNotNull())
    at = F.unix_micros("transaction_timestamp_utc")
    left = transactions.select(
        *[F.col(c).alias(name) for name, c in FROM_TRANSACTION.items()]
    ).where(F.col("user_pseudo_id").isNotNull()).withColumn(
        "_at_cell", F.explode(F.sequence(_time_cell(at - reach, config), _time_cell(at, config)))
    )
    return left, right


def _salt(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CELL_SALTS)).cast("int")


def crowded_cells(left: DataFrame, right: DataFrame, config: AttributionConfig) -> DataFrame:
    """All (user, cell) with more rows of a side than ``lane_rows``, and into how many parts it is cut.

    ``_lanes`` cuts the sessions, ``_slots`` the transactions; both are twice what the limit asks for, as
    rows find their part by a hash.  A cell stands there once per salt that its own rows have, so the
    result has no more rows than the crowded cells.  The counts are combined before the exchange.
    The result is written, so that the joins to it are planned by its real size; as files say little about
    rows that repeat one another, many rows are never broadcast.
    """
    one, none = F.lit(1), F.lit(0)
    counts = right.select(
        "_user", "_cell", _salt("touchpoint_session_key").alias("_salt"), one.alias("_s"), none.alias("_t")
    ).unionByName(
        left.select(
            F.col("user_pseudo_id").alias("_user"),
            F.col("_at_cell").alias("_cell"),
            _salt("transaction_key").alias("_salt"),
            none.alias("_s"),
            one.alias("_t"),
        )
    )
    parts = lambda n: F.when(n > config.lane_rows, F.ceil(2 * n / config.lane_rows)).otherwise(1).cast("int")
    bit = F.expr("shiftleft(1L, _salt)")
    cells = counts.groupBy("_user", "_cell").agg(
        F.sum("_s").alias("_s"), F.sum("_t").alias("_t"), F.bit_or(bit).alias("_salts")
    )
    has = lambda salt: F.getbit(F.col("_salts"), salt) == 1
    crowded = settle(
        cells.where((F.col("_s") > config.lane_rows) | (F.col("_t") > config.lane_rows)).select(
            "_user",
            "_cell",
            parts(F.col("_s")).alias("_lanes"),
            parts(F.col("_t")).alias("_slots"),
            F.explode(F.filter(F.sequence(F.lit(0), F.lit(CELL_SALTS - 1)), has)).alias("_salt"),
        ),
        "crowded_cells",
    )
    return crowded.hint("merge") if crowded.count() > BROADCAST_ROWS else crowded


def _cut(rows: DataFrame, user: str, cell: str, key: str, crowded: DataFrame) -> DataFrame:
    """``rows`` with the parts of their cell.  The join is salted, so a crowded cell does not crowd it."""
    spread = crowded.select(F.col("_user").alias("_cu"), F.col("_cell").alias("_cc"), "_lanes", "_slots", "_salt")
    met = (F.col(user) == F.col("_cu")) & (F.col(cell) == F.col("_cc")) & (F.col("_own") == F.col("_salt"))
    salted = rows.withColumn("_own", _salt(key))
    return (
        salted.join(spread, met, "left")
        .withColumns({"_lanes": F.coalesce("_lanes", F.lit(1)), "_slots": F.coalesce("_slots", F.lit(1))})
        .drop("_cu", "_cc", "_salt", "_own")
    )


def cut_into_lanes(left: DataFrame, right: DataFrame, config: AttributionConfig) -> tuple[DataFrame, DataFrame]:
    """Both sides with the parts of a crowded cell as further columns to meet on.

    A session takes one lane by its key and stands in every slot; a transaction takes one slot and
    stands in every lane.  Each pair still meets exactly once, and where a cell is crowded at most
    ``lane_rows`` rows of either side meet in one place.
    """
    crowded = crowded_cells(left, right, config)
    # Of its own for each side: seeds differ from the ones that deal out rows.
    part = lambda key, n: F.pmod(F.xxhash64(key, F.lit(17)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = (
        _cut(right, "_user", "_cell", "touchpoint_session_key", crowded)
        .withColumn("_lane", part("touchpoint_session_key", "_lanes"))
        .withColumn("_slot", every("_slots"))
        .drop("_lanes", "_slots")
    )
    left = (
        _cut(left, "user_pseudo_id", "_at_cell", "transaction_key", crowded)
        .withColumn("_at_slot", part("transaction_key", "_slots"))
        .withColumn("_at_lane", every("_lanes"))
        .drop("_lanes", "_slots")
    )
    return left, right


def eligible_touchpoints(
    transactions: DataFrame,
    sessions: DataFrame,
    config: AttributionConfig = AttributionConfig(),
) -> DataFrame:
    """All sessions of the buyer that start inside the lookback window, both ends included."""
    left, right = cut_into_lanes(*_sides(transactions, sessions, config), config)
    start, at = F.col("touchpoint_start_timestamp_utc"), F.col("transaction_timestamp_utc")
    window_start = F.timestamp_micros(F.unix_micros(at) - config.lookback_days * DAY_MICROS)
    met = left.join(
        right,
        (F.col("user_pseudo_id") == F.col("_user"))
        & (F.col("_at_cell") == F.col("_cell"))
        & (F.col("_at_lane") == F.col("_lane"))
        & (F.col("_at_slot") == F.col("_slot"))
        & start.between(window_start, at),
    ).drop("_user", "_at_cell", "_cell", "_at_lane", "_lane", "_at_slot", "_slot")
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    direct = (F.col("touchpoint_channel_group") == DIRECT_CHANNEL) | (
        (low("touchpoint_source") == DIRECT_SOURCE) & (low("touchpoint_medium") == DIRECT_MEDIUM)
    )
    return (
        met.crossJoin(F.broadcast(data_bounds(sessions)))
        .withColumns(
            {
                "lookback_window_start_utc": window_start,
                "lookback_window_end_utc": at,
                "seconds_before_transaction": whole_seconds(at, start),
                "calendar_days_before_transaction": F.datediff(
                    "transaction_date", "touchpoint_session_date"
                ),
                "is_conversion_session": F.col("touchpoint_session_key") == F.col("transaction_session_key"),
                "is_direct_touchpoint": direct,
                "is_lookback_left_censored": F.date_sub("transaction_date", config.lookback_days)
                < F.col("source_data_start_date"),
            }
        )
        .fillna(TOUCHPOINT_FILL)
    )


def rank_touchpoints(touchpoints: DataFrame) -> DataFrame:
    """Journey positions of every touchpoint, from the front and from the back.

    A journey is ranked hour by hour: the hour totals of a journey (at most one row per hour of
    the lookback) give the offset of each hour, and the sort runs inside an hour only.  A journey
    of millions of touchpoints is thereby spread over its hours, and the positions from the back
    follow from the totals without a second sort.  The touchpoints are read twice, three columns
    of them the first time, and should be a written frame.
    """
    non_direct = ~F.col("is_direct_touchpoint")
    timed = touchpoints.withColumn(
        "_hour", F.floor(F.unix_micros("touchpoint_start_timestamp_utc") / HOUR_MICROS)
    )
    hours = timed.groupBy("transaction_key", "_hour").agg(
        F.count(F.lit(1)).alias("_rows"), rows_where(non_direct).alias("_named")
    )
    journey = Window.partitionBy("transaction_key")
    offsets = (
        running_offsets(hours, ["transaction_key"], "_hour", {"_rows_before": "_rows", "_named_before": "_named"})
        .withColumns(
            {
                "touchpoint_count": F.sum("_rows").over(journey),
                "non_direct_touchpoint_count": F.sum("_named").over(journey),
            }
        )
        .drop("_rows", "_named")
    )
    inside = Window.partitionBy("transaction_key", "_hour").orderBy(
        "touchpoint_start_timestamp_utc", "touchpoint_session_key"
    )
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    front = F.col("touchpoint_position_asc")
    named_front = F.col("non_direct_touchpoint_position_asc")
    return (
        timed.join(offsets, ["transaction_key", "_hour"])
        .withColumns(
            {
                "touchpoint_position_asc": F.col("_rows_before") + F.row_number().over(inside),
                "non_direct_touchpoint_position_asc": F.when(
                    non_direct, F.col("_named_before") + rows_where(non_direct).over(so_far)
                ),
            }
        )
        .withColumns(
            {
                "touchpoint_position_desc": F.col("touchpoint_count") + 1 - front,
                "non_direct_touchpoint_position_desc": F.col("non_direct_touchpoint_count") + 1 - named_front,
            }
        )
        .drop("_hour", "_rows_before", "_named_before")
    )


def bridge_touchpoints(
    transactions: DataFrame,
    sessions: DataFrame,
    config: AttributionConfig = AttributionConfig(),
) -> DataFrame:
    """The bridge: one row per transaction and touchpoint with its role in the journey.

    The touchpoints in reach are written once, so the lookback join runs once.
    """
    return with_roles(rank_touchpoints(settle(eligible_touchpoints(transactions, sessions, config), "touchpoints")))


def day_slices(rows: DataFrame, day: str, most: int) -> list[Column]:
    """Conditions that cut ``rows`` into runs of whole days, earliest first; each row meets exactly one.

    A run has fewer than ``most`` rows besides those of its first day; rows without a day go with the first
    run.  Only the first days of the runs reach the driver, at most one per ``most`` rows.
    """
    days = rows.where(F.col(day).isNotNull()).groupBy(day).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per day; they share the constant group.
    so_far = F.sum("_rows").over(Window.partitionBy(F.lit(0)).orderBy(day))
    runs = days.withColumn("_run", F.floor((so_far - 1) / most)).groupBy("_run").agg(F.min(day).alias("_first"))
    at, starts = F.col(day), sorted(r["_first"] for r in runs.collect())[1:]
    if not starts:
        return [F.lit(True)]
    inner = [(at >= F.lit(a)) & (at < F.lit(b)) for a, b in zip(starts, starts[1:])]
    return [at.isNull() | (at < F.lit(starts[0])), *inner, at >= F.lit(starts[-1])]


def bridge_slices(
    transactions: DataFrame,
    sessions: DataFrame,
    config: AttributionConfig = AttributionConfig(),
) -> list[DataFrame]:
    """The rows of ``bridge_touchpoints`` in frames of whole transaction days, earliest first.

    A journey has one transaction and so lies in one of them.  The lookback join runs once.
    """
    touchpoints = settle(eligible_touchpoints(transactions, sessions, config), "touchpoints", "zstd")
    return [
        with_roles(rank_touchpoints(touchpoints.where(days)))
        for days in day_slices(touchpoints, "transaction_date", config.slice_rows)
    ]


def with_roles(ranked: DataFrame) -> DataFrame:
    """Ranked touchpoints with their role in the journey."""
    at_one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    last = at_one("touchpoint_position_desc")
    last_named = at_one("non_direct_touchpoint_position_desc")
    return ranked.withColumns(
        {
            "is_first_touchpoint": at_one("touchpoint_position_asc"),
            "is_last_touchpoint": last,
            "is_first_non_direct_touchpoint": at_one("non_direct_touchpoint_position_asc"),
            "is_last_non_direct_touchpoint": last_named,
            # A journey of direct visits only falls back to its last touchpoint.
            "is_last_non_direct_attribution_touchpoint": last_named
            | (last & (F.col("non_direct_touchpoint_count") == 0)),
        }
    )


def journeys(bridge: DataFrame) -> DataFrame:
    """Transaction-level view of the bridge, for summaries and reconciliation."""
    return bridge.groupBy("transaction_key").agg(
        F.max("user_pseudo_id").alias("user_pseudo_id"),
        F.max("transaction_revenue_usd").alias("transaction_revenue_usd"),
        F.bool_or("uses_fallback_transaction_key").alias("uses_fallback_transaction_key"),
        F.count(F.lit(1)).alias("touchpoint_count"),
        rows_where(~F.col("is_direct_touchpoint")).alias("non_direct_touchpoint_count"),
        rows_where(F.col("is_conversion_session")).alias("conversion_session_count"),
        rows_where(F.col("is_first_touchpoint")).alias("first_touchpoint_flag_count"),
        rows_where(F.col("is_last_touchpoint")).alias("last_touchpoint_flag_count"),
        rows_where(F.col("is_last_non_direct_attribution_touchpoint")).alias(
            "last_non_direct_attribution_flag_count"
        ),
        F.bool_or("is_lookback_left_censored").alias("is_lookback_left_censored"),
    )


def bridge_summary(bridge: DataFrame) -> DataFrame:
    return journeys(bridge).agg(
        F.sum("touchpoint_count").alias("bridge_row_count"),
        F.count(F.lit(1)).alias("represented_transactions"),
        F.count_distinct("user_pseudo_id").alias("represented_users"),
        F.round(F.avg("touchpoint_count"), 2).alias("average_touchpoints_per_transaction"),
        F.max("touchpoint_count").alias("maximum_touchpoints_for_one_transaction"),
        rows_where(F.col("touchpoint_count") > 1).alias("multi_touch_transactions"),
        rows_where(F.col("non_direct_touchpoint_count") == 0).alias("direct_only_transactions"),
        rows_where(F.col("is_lookback_left_censored")).alias("left_censored_transactions"),
        F.sum("transaction_revenue_usd").alias("represented_canonical_revenue_usd"),
    )


def _whole_credit(flag: str) -> Callable[[AttributionConfig], Column]:
    return lambda _: F.col(flag).cast("double")


def _linear(_: AttributionConfig) -> Column:
    return ratio(F.lit(1.0), F.col("touchpoint_count"))


def _position_based(config: AttributionConfig) -> Column:
    n = F.col("touchpoint_count")
    ends = F.col("is_first_touchpoint") | F.col("is_last_touchpoint")
    return (
        F.when(n == 1, F.lit(1.0))
        .when(n == 2, F.lit(config.pair_share))
        .when(ends, F.lit(config.end_share))
        .otherwise(ratio(F.lit(config.middle_share), n - 2))
    )


# Model name -> weight of a touchpoint; the order of the entries is the model order.
MODELS: dict[str, Callable[[AttributionConfig], Column]] = {
    "first_touch": _whole_credit("is_first_touchpoint"),
    "last_touch": _whole_credit("is_last_touchpoint"),
    "last_non_direct": _whole_credit("is_last_non_direct_attribution_touchpoint"),
    "linear": _linear,
    "position_based": _position_based,
}

# Bridge columns the credit fact does not carry.
NOT_CREDITED = {
    "touchpoint_attribution_timestamp_utc",
    "touchpoint_duration_seconds",
    "first_user_source",
    "first_user_medium",
    "first_user_campaign",
    "touchpoint_purchase_measurement_event_count",
    "non_direct_touchpoint_position_asc",
    "non_direct_touchpoint_position_desc",
}


def attribution_credits(
    bridge: DataFrame,
    config: AttributionConfig = AttributionConfig(),
    models: dict[str, Callable[[AttributionConfig], Column]] = MODELS,
) -> DataFrame:
    """Long table of credits: model x transaction x touchpoint, rows without credit left out."""
    offers = F.array(
        *[
            F.struct(
                F.lit(name).alias("attribution_model"),
                F.lit(place).alias("attribution_model_order"),
                weight(config).alias("attribution_weight"),
            )
            for place, (name, weight) in enumerate(models.items(), start=1)
        ]
    )
    kept = [c for c in bridge.columns if c not in NOT_CREDITED]
    credited = bridge.select(*kept, F.inline(offers)).where(F.col("attribution_weight") > 0)
    return credited.select(
        "attribution_model",
        "attribution_model_order",
        *kept,
        (~F.col("is_lookback_left_censored")).alias("is_complete_lookback_window"),
        "attribution_weight",
        F.col("attribution_weight").alias("attributed_conversion_credit"),
        (F.col("transaction_revenue_usd") * F.col("attribution_weight")).alias("attributed_revenue_usd"),
    )


def credit_summary(credits: DataFrame) -> DataFrame:
    """Totals per model.

    A transaction is complete or censored as a whole, so counting the transactions of the two
    kinds separately costs one distinct count instead of two; users need their own.
    """
    by_model = ["attribution_model_order", "attribution_model"]
    per_kind = credits.groupBy(*by_model, "is_complete_lookback_window").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_distinct("transaction_key").alias("_transactions"),
        F.sum("attributed_conversion_credit").alias("_conversions"),
        F.sum("attributed_revenue_usd").alias("_revenue"),
    )
    complete = F.col("is_complete_lookback_window")
    totals = per_kind.groupBy(*by_model).agg(
        F.sum("_rows").alias("credit_row_count"),
        F.sum("_transactions").alias("represented_transactions"),
        F.sum(F.when(complete, F.col("_transactions")).otherwise(0)).alias("complete_window_transactions"),
        F.round(F.sum("_conversions"), 6).alias("attributed_conversions"),
        F.round(F.sum("_revenue"), 2).alias("attributed_revenue_usd"),
        F.round(F.sum(F.when(complete, F.col("_revenue")).otherwise(0.0)), 2).alias(
            "complete_window_attributed_revenue_usd"
        ),
    )
    users = credits.groupBy(*by_model).agg(F.count_distinct("user_pseudo_id").alias("represented_users"))
    return (
        totals.join(users, by_model)
        .select(
            *by_model,
            "credit_row_count",
            "represented_transactions",
            "represented_users",
            "complete_window_transactions",
            "attributed_conversions",
            "attributed_revenue_usd",
            "complete_window_attributed_revenue_usd",
        )
        .orderBy("attribution_model_order")
    )
