"""Profiles of the raw nested events: coverage, parameters, purchase quality and key strategies.

Operators that need the purchase events more than once take ``hold``, a function that keeps a
frame for re-reading.  The default writes the few purchase columns to the shared folder: reading
the repeated parameter field of all events a second time would cost far more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from journeyloom.config import SkewConfig
from journeyloom.functions.calendar import day_from_suffix, whole_seconds
from journeyloom.functions.numeric import agrees, differs, percent, rows_where, sum_where
from journeyloom.functions.params import READERS, first_value
from journeyloom.functions.text import blank_to_null, double_text, pipe_join, sha256_hex
from journeyloom.operators.onepass import attach_row
from journeyloom.operators.skew import lookup_join
from journeyloom.operators.staging import items_json
from journeyloom.sources.workspace import settle

Hold = Callable[[DataFrame], DataFrame]


def _keep(df: DataFrame) -> DataFrame:
    return settle(df, "purchases")


def _listed_order(c: str, labels: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(c))


def dataset_overview(events: DataFrame) -> DataFrame:
    """Volume, users, dates and event names in one row.

    Dates and names are counted on the small (date, name) aggregate, users in a pass of their
    own: three distinct counts in one aggregate would multiply every event row by four.
    """
    by_day = events.groupBy("event_date", "event_name").agg(F.count(F.lit(1)).alias("_n"))
    shape = by_day.agg(
        F.sum("_n").alias("event_count"),
        F.count_distinct("event_date").alias("active_dates"),
        F.min(day_from_suffix(F.col("event_date"))).alias("first_event_date"),
        F.max(day_from_suffix(F.col("event_date"))).alias("last_event_date"),
        F.count_distinct("event_name").alias("distinct_event_names"),
        sum_where(F.col("event_name") == "purchase", F.col("_n")).alias("purchase_event_count"),
    )
    users = events.agg(F.count_distinct("user_pseudo_id").alias("unique_pseudo_users"))
    return attach_row(shape, users).select(
        "event_count",
        "unique_pseudo_users",
        "active_dates",
        "first_event_date",
        "last_event_date",
        "distinct_event_names",
        "purchase_event_count",
    )


def event_name_profile(events: DataFrame) -> DataFrame:
    measures = [
        F.count(F.lit(1)).alias("event_count"),
        F.count_distinct("user_pseudo_id").alias("unique_pseudo_users"),
    ]
    totals = events.agg(*measures).toDF("_events", "_users")
    profile = events.groupBy("event_name").agg(
        *measures,
        F.min(day_from_suffix(F.col("event_date"))).alias("first_event_date"),
        F.max(day_from_suffix(F.col("event_date"))).alias("last_event_date"),
    )
    return (
        attach_row(profile, totals)
        .select(
            "event_name",
            "event_count",
            "unique_pseudo_users",
            percent(F.col("event_count"), F.col("_events")).alias("event_share_pct"),
            percent(F.col("unique_pseudo_users"), F.col("_users")).alias("user_reach_pct"),
            "first_event_date",
            "last_event_date",
        )
        .orderBy(F.desc("event_count"))
    )


# Typed slot of a parameter value -> (row counter, observed type).
SLOTS = {
    "string_value": ("string_value_rows", "STRING"),
    "int_value": ("int_value_rows", "INTEGER"),
    "float_value": ("float_value_rows", "FLOAT"),
    "double_value": ("double_value_rows", "DOUBLE"),
}


def parameter_profile(events: DataFrame, samples: int = 3) -> DataFrame:
    """Data dictionary of the event parameters, one row per key.

    Counting goes by (key, event name) first, which is small before it is shuffled.  For the samples see
    ``leading_values``.
    """
    entries = events.select("event_name", F.explode("event_params").alias("p")).select(
        "event_name", F.col("p.key").alias("parameter_key"), F.col("p.value").alias("v")
    )
    counters = {
        **{rows: F.col(f"v.{slot}").isNotNull() for slot, (rows, _) in SLOTS.items()},
        "null_value_rows": F.coalesce(*[F.col(f"v.{s}").cast("string") for s in SLOTS]).isNull(),
    }
    per_name = entries.groupBy("parameter_key", "event_name").agg(
        F.count(F.lit(1)).alias("_n"), *[rows_where(c).alias(name) for name, c in counters.items()]
    )
    per_key = per_name.groupBy("parameter_key").agg(
        F.sum("_n").alias("parameter_occurrences"),
        F.count("event_name").alias("event_types_using_parameter"),
        F.array_sort(F.collect_list("event_name")).alias("event_names"),
        *[F.sum(name).alias(name) for name in counters],
    )
    told = entries.select("parameter_key", READERS["sample"](F.col("v")).alias("value"))
    leading = leading_values(told, "parameter_key", "value", samples, "sample_values")
    kinds = F.array_compact(
        F.array(*[F.when(F.col(rows) > 0, F.lit(label)) for rows, label in SLOTS.values()])
    )
    return (
        per_key.join(leading, "parameter_key", "left")
        .withColumn("_kinds", kinds)
        .select(
            "parameter_key",
            "parameter_occurrences",
            "event_types_using_parameter",
            "event_names",
            F.when(F.size("_kinds") == 0, "NULL_ONLY")
            .when(F.size("_kinds") == 1, F.get("_kinds", F.lit(0)))
            .otherwise("MIXED")
            .alias("observed_value_type"),
            *counters,
            "sample_values",
        )
        .orderBy(F.desc("parameter_occurrences"), "parameter_key")
    )


def leading_values(rows: DataFrame, key: str, value: str, k: int, name: str, buckets: int = 64) -> DataFrame:
    """Per key the ``k`` smallest distinct values as a sorted array; keys with NULLs only have no row.

    Two reads, neither of which shuffles the distinct values.  The first takes the smallest value of every
    hash bucket of a key, one row per task, key and bucket.  The k-th of these minima is no
    smaller than the k-th value asked for, as k distinct values lie up to it.  The second read keeps what lies
    up to that bound: k values and the few that shared a bucket with one of them.  The bounds, one row per
    key, are written first, so the join to them is planned by their size.
    """
    held = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    lows = held.groupBy("_key", F.pmod(F.xxhash64("_value"), F.lit(buckets)).alias("_bucket")).agg(F.min("_value").alias("_low"))
    # At most `buckets` minima per key.
    ordered = lows.groupBy("_key").agg(F.array_sort(F.collect_list("_low")).alias("_lows"))
    bounds = settle(
        ordered.select(
            F.col("_key").alias("_of"),
            F.element_at("_lows", F.least(F.lit(k), F.size("_lows"))).alias("_bound"),
            (F.size("_lows") < k).alias("_few"),
        ),
        "leading_bounds",
    )
    near = held.join(bounds, F.col("_key") == F.col("_of")).where(F.col("_few") | (F.col("_value") <= F.col("_bound")))
    found = near.groupBy("_key", "_value").agg(F.lit(1).alias("_one"))
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_value"))
    return (
        found.withColumn("_place", place)
        .where(F.col("_place") <= k)
        .groupBy(F.col("_key").alias(key))
        .agg(F.array_sort(F.collect_list("_value")).alias(name))
    )


def _purchases(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_name") == "purchase")


def purchase_quality(events: DataFrame, hold: Hold = _keep) -> DataFrame:
    """Completeness and agreement of purchase events, one row."""
    p = F.col("event_params")
    base = hold(
        _purchases(events).select(
            "user_pseudo_id",
            blank_to_null(F.col("ecommerce.transaction_id")).alias("own_id"),
            F.col("ecommerce.purchase_revenue").alias("revenue"),
            F.col("ecommerce.purchase_revenue_in_usd").alias("revenue_usd"),
            F.col("ecommerce.total_item_quantity").alias("quantity"),
            F.array_size("items").alias("items"),
            blank_to_null(first_value(p, "transaction_id", "sample")).alias("param_id"),
            first_value(p, "value", "double").alias("param_value"),
            first_value(p, "currency", "string").alias("currency"),
            first_value(p, "ga_session_id", "long").alias("session_id"),
        )
    )
    have = lambda c: rows_where(F.col(c).isNotNull())
    gap = F.abs(F.col("revenue") - F.col("param_value"))
    summary = base.agg(
        F.count(F.lit(1)).alias("purchase_event_count"),
        have("session_id").alias("purchase_events_with_session_id"),
        have("own_id").alias("purchase_events_with_ecommerce_transaction_id"),
        have("param_id").alias("purchase_events_with_parameter_transaction_id"),
        rows_where(F.col("own_id") == F.col("param_id")).alias("matching_transaction_id_events"),
        rows_where(F.col("own_id") != F.col("param_id")).alias("mismatched_transaction_id_events"),
        have("revenue").alias("purchase_events_with_ecommerce_revenue"),
        F.round(F.sum("revenue"), 2).alias("raw_ecommerce_purchase_revenue"),
        have("revenue_usd").alias("purchase_events_with_usd_revenue"),
        F.round(F.sum("revenue_usd"), 2).alias("raw_purchase_revenue_in_usd"),
        have("param_value").alias("purchase_events_with_parameter_value"),
        rows_where(gap <= 0.01).alias("matching_revenue_value_events"),
        rows_where(gap > 0.01).alias("mismatched_revenue_value_events"),
        have("currency").alias("purchase_events_with_currency"),
        F.array_sort(F.collect_set("currency")).alias("currencies_observed"),
        have("quantity").alias("purchase_events_with_item_quantity"),
        rows_where(F.col("items") > 0).alias("purchase_events_with_item_records"),
    )
    users = base.agg(F.count_distinct("user_pseudo_id").alias("unique_purchase_users"))
    param_ids = base.agg(F.count_distinct("param_id").alias("distinct_parameter_transaction_ids"))
    copies = (
        base.where(F.col("own_id").isNotNull())
        .groupBy("own_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.count(F.lit(1)).alias("distinct_ecommerce_transaction_ids"),
            rows_where(F.col("n") > 1).alias("duplicated_transaction_ids"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_purchase_event_rows"),
        )
    )
    wide = attach_row(attach_row(attach_row(summary, users), param_ids), copies)
    first = ["purchase_event_count", "unique_purchase_users"]
    last = ["duplicated_transaction_ids", "excess_purchase_event_rows"]
    return wide.select(*first, *[c for c in wide.columns if c not in first + last], *last)


# Duplicate patterns in the order of the report.
PATTERNS = (
    "UNIQUE_TRANSACTION_ID",
    "MISSING_TRANSACTION_ID",
    "ID_REUSED_ACROSS_USERS",
    "SAME_ID_DIFFERENT_REVENUE",
    "SAME_ID_SAME_TIMESTAMP",
    "SAME_ID_REPEATED_WITHIN_SESSION",
    "SAME_ID_REPEATED_ACROSS_SESSIONS",
)


def _visit_key() -> Column:
    return pipe_join(
        F.coalesce("user_pseudo_id", F.lit("[NULL_USER]")),
        F.coalesce(F.col("ga_session_id").cast("string"), F.lit("[NULL_SESSION]")),
    )


def duplicate_transaction_patterns(
    events: DataFrame, samples: int = 5, hold: Hold = _keep
) -> DataFrame:
    """Classify every transaction ID by how its purchase events repeat, and sum up per pattern.

    "More than one user" and its likes are answered by comparing smallest and largest value, so
    the group of rows without an ID stays an ordinary partial aggregate.
    """
    base = hold(
        _purchases(events).select(
            blank_to_null(F.col("ecommerce.transaction_id")).alias("transaction_id"),
            "user_pseudo_id",
            "event_timestamp",
            F.col("ecommerce.purchase_revenue_in_usd").alias("revenue_usd"),
            first_value(F.col("event_params"), "ga_session_id", "long").alias("ga_session_id"),
        )
    )
    at = F.timestamp_micros("event_timestamp")
    groups = (
        base.withColumn("visit", _visit_key())
        .groupBy("transaction_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            differs(F.col("user_pseudo_id")).alias("users_differ"),
            differs(F.col("revenue_usd")).alias("revenues_differ"),
            agrees(F.col("event_timestamp")).alias("one_moment"),
            agrees(F.col("visit")).alias("one_visit"),
            whole_seconds(F.max(at), F.min(at)).alias("span"),
        )
        .withColumn(
            "transaction_pattern",
            F.when(F.col("transaction_id").isNull(), "MISSING_TRANSACTION_ID")
            .when(F.col("n") == 1, "UNIQUE_TRANSACTION_ID")
            .when(F.col("users_differ"), "ID_REUSED_ACROSS_USERS")
            .when(F.col("revenues_differ"), "SAME_ID_DIFFERENT_REVENUE")
            .when(F.col("one_moment"), "SAME_ID_SAME_TIMESTAMP")
            .when(F.col("one_visit"), "SAME_ID_REPEATED_WITHIN_SESSION")
            .otherwise("SAME_ID_REPEATED_ACROSS_SESSIONS"),
        )
    )
    named = F.col("transaction_id").isNotNull()
    rows_of_named = F.when(named, F.col("n"))
    summary = groups.groupBy("transaction_pattern").agg(
        rows_where(named).alias("transaction_id_groups"),
        F.sum("n").alias("purchase_event_rows"),
        sum_where(named, F.col("n") - 1).alias("excess_purchase_event_rows"),
        F.round(F.avg(rows_of_named), 2).alias("average_event_rows_per_transaction_id"),
        F.max(rows_of_named).alias("maximum_event_rows_for_one_transaction_id"),
        F.max("span").alias("maximum_event_span_seconds"),
    )
    place = F.row_number().over(
        Window.partitionBy("transaction_pattern").orderBy(F.desc("n"), "transaction_id")
    )
    examples = (
        groups.where(named)
        .select("transaction_pattern", "transaction_id", "n")
        .withColumn("_place", place)
        .where(F.col("_place") <= samples)
        .groupBy("transaction_pattern")
        .agg(F.array_sort(F.collect_list(F.struct("_place", "transaction_id"))).alias("_best"))
        .select("transaction_pattern", F.col("_best.transaction_id").alias("sample_transaction_ids"))
    )
    return summary.join(examples, "transaction_pattern", "left").orderBy(
        _listed_order("transaction_pattern", PATTERNS)
    )


def _signed_purchases(events: DataFrame) -> DataFrame:
    """Purchases with ID status and the conservative signature of the whole event."""
    raw = blank_to_null(F.col("ecommerce.transaction_id"))
    unset = F.lower(raw) == "(not set)"
    base = _purchases(events).select(
        F.when(raw.isNull(), "MISSING").when(unset, "NOT_SET").otherwise("VALID").alias("id_status"),
        F.when(~unset, raw).alias("id"),
        "user_pseudo_id",
        "event_timestamp",
        F.col("ecommerce.purchase_revenue_in_usd").alias("revenue_usd"),
        items_json(F.col("items")).alias("items_json"),
        first_value(F.col("event_params"), "ga_session_id", "long").alias("ga_session_id"),
    )
    signature = sha256_hex(
        pipe_join(
            _visit_key(),
            F.col("event_timestamp").cast("string"),
            F.coalesce(double_text(F.col("revenue_usd")), F.lit("[NULL_REVENUE]")),
            F.col("items_json"),
        )
    )
    return base.withColumn("signature", signature).drop("items_json")


def _key_summary(
    keyed: DataFrame, method: str, keys_name: str, users: Column, revenues: Column, order: tuple[str, ...]
) -> DataFrame:
    per_key = keyed.groupBy(method, "_key").agg(
        F.count(F.lit(1)).alias("n"),
        differs(users).alias("users_differ"),
        revenues.alias("revenues_differ"),
    )
    per_method = per_key.groupBy(method).agg(
        F.count(F.lit(1)).alias(keys_name),
        F.sum("n").alias("purchase_event_rows"),
        rows_where(F.col("n") > 1).alias("duplicated_candidate_keys"),
        F.sum(F.col("n") - 1).alias("excess_purchase_event_rows"),
        rows_where(F.col("users_differ")).alias("cross_user_candidate_keys"),
        rows_where(F.col("revenues_differ")).alias("conflicting_revenue_candidate_keys"),
        F.max("n").alias("maximum_event_rows_for_one_candidate_key"),
    )
    # One row per method name, four at most: a window over all of them is no bottleneck.
    everything = F.sum("purchase_event_rows").over(Window.partitionBy())
    return (
        per_method.withColumn(
            "purchase_event_share_pct", percent(F.col("purchase_event_rows"), everything)
        )
        .select(
            method,
            keys_name,
            "purchase_event_rows",
            "purchase_event_share_pct",
            "duplicated_candidate_keys",
            "excess_purchase_event_rows",
            "cross_user_candidate_keys",
            "conflicting_revenue_candidate_keys",
            "maximum_event_rows_for_one_candidate_key",
        )
        .orderBy(_listed_order(method, order))
    )


CANDIDATE_METHODS = {
    "VALID": "VALID_TRANSACTION_ID",
    "MISSING": "FALLBACK_SIGNATURE_MISSING_ID",
    "NOT_SET": "FALLBACK_SIGNATURE_NOT_SET",
}


def candidate_key_profile(events: DataFrame) -> DataFrame:
    """First key strategy: the ID where there is one, the signature otherwise."""
    methods = F.create_map(*[F.lit(x) for pair in CANDIDATE_METHODS.items() for x in pair])
    keyed = _signed_purchases(events).withColumns(
        {
            "transaction_key_method": methods[F.col("id_status")],
            "_key": F.coalesce("id", "signature"),
        }
    )
    return _key_summary(
        keyed,
        "transaction_key_method",
        "candidate_transaction_keys",
        F.col("user_pseudo_id"),
        differs(F.col("revenue_usd")),
        tuple(CANDIDATE_METHODS.values()),
    )


FINAL_METHODS = (
    "RELIABLE_TRANSACTION_ID",
    "FALLBACK_CONFLICTING_TRANSACTION_ID",
    "FALLBACK_MISSING_ID",
    "FALLBACK_NOT_SET",
)


def _null_counts_as_value(c: str) -> Column:
    """Aggregate: does the group hold more than one value, NULL being one of them?"""
    return differs(F.col(c)) | (F.count_if(F.col(c).isNull()).between(1, F.count(F.lit(1)) - 1))


def final_key_profile(
    events: DataFrame, skew: SkewConfig = SkewConfig(), hold: Hold = _keep
) -> DataFrame:
    """Second key strategy: IDs with more than one user or revenue fall back as well."""
    base = hold(_signed_purchases(events))
    profile = (
        base.where(F.col("id_status") == "VALID")
        .groupBy("id")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            (_null_counts_as_value("user_pseudo_id") | _null_counts_as_value("revenue_usd")).alias(
                "_conflict"
            ),
        )
    )
    judged = lookup_join(base, profile, "id", "_rows", F.col("signature"), skew)
    reliable = (F.col("id_status") == "VALID") & ~F.col("_conflict")
    reliable_method, conflicting, missing, not_set = FINAL_METHODS
    keyed = judged.withColumns(
        {
            "final_key_method": F.when(reliable, reliable_method)
            .when(F.col("id_status") == "VALID", conflicting)
            .when(F.col("id_status") == "NOT_SET", not_set)
            .otherwise(missing),
            "_key": F.when(reliable, F.concat(F.lit("TXN|"), "id")).otherwise(
                F.concat(F.lit("SIG|"), "signature")
            ),
        }
    )
    return _key_summary(
        keyed,
        "final_key_method",
        "final_candidate_transaction_keys",
        F.coalesce("user_pseudo_id", F.lit("[NULL_USER]")),
        _null_counts_as_value("revenue_usd"),
        FINAL_METHODS,
    )
