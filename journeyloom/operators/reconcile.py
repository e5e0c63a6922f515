"""Reconciliation reports: source and target side by side, with one status per row.

A report is a set of measures, comparisons over them and the conditions of the good status.
Expected figures are optional: without them a report compares what the tables say about each
other, with them it also pins the figures.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from journeyloom.functions.numeric import rows_where, sum_where
from journeyloom.operators.attribution import MODELS, journeys
from journeyloom.operators.comparison import POPULATIONS
from journeyloom.operators.onepass import attach_row, distinct, one_pass
from journeyloom.functions.calendar import day_from_suffix
from journeyloom.operators.transactions import CONFLICTING, MISSING, NOT_SET, RELIABLE
from journeyloom.sources.tables import const_relation


def _measures(df: DataFrame, **aggregates: Column) -> DataFrame:
    return df.agg(*[c.alias(name) for name, c in aggregates.items()])


def _side_by_side(*one_rows: DataFrame) -> DataFrame:
    return reduce(attach_row, one_rows)


def _all(*conditions: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def _none(*counters: str) -> Column:
    return _all(*[F.col(c) == 0 for c in counters])


def _same(a: str, b: str) -> Column:
    return F.col(a) == F.col(b)


def _close(a: str, b: str, tolerance: float = 0.01) -> Column:
    return F.abs(F.col(a) - F.col(b)) < tolerance


def _expected(expected: dict[str, float] | None, tolerance: float = 1e-6) -> Column:
    """Pinned figures: report column -> value."""
    checks = [F.abs(F.col(c) - v) <= tolerance for c, v in (expected or {}).items()]
    return _all(*checks) if checks else F.lit(True)


def _status(good: Column, otherwise: str, name: str = "reconciliation_status") -> Column:
    return F.when(good, "PASS").otherwise(otherwise).alias(name)


def reconcile_events(
    source: DataFrame, staged: DataFrame, expected: dict[str, float] | None = None
) -> DataFrame:
    """Does staging keep grain and coverage of the source?"""
    day = day_from_suffix(F.col("event_date"))
    bought = F.col("is_purchase_event")
    missing = lambda c: F.col(c).isNull()
    src = one_pass(
        source,
        {
            "source_event_rows": F.count(F.lit(1)),
            "source_first_event_date": F.min(day),
            "source_last_event_date": F.max(day),
            "source_purchase_event_rows": rows_where(F.col("event_name") == "purchase"),
        },
        [distinct("source_unique_users", "user_pseudo_id"), distinct("source_distinct_event_names", "event_name")],
    )
    stg = one_pass(
        staged,
        {
            "staging_event_rows": F.count(F.lit(1)),
            "staging_first_event_date": F.min("event_date"),
            "staging_last_event_date": F.max("event_date"),
            "staging_purchase_event_rows": rows_where(bought),
            "staging_purchase_events_with_session_id": rows_where(bought & F.col("has_session_id")),
            "staging_purchase_events_with_currency": rows_where(bought & F.col("currency").isNotNull()),
            "null_event_date_rows": rows_where(missing("event_date")),
            "null_event_timestamp_rows": rows_where(missing("event_timestamp_utc")),
            "invalid_session_key_rows": rows_where(
                F.col("has_user_pseudo_id") & F.col("has_session_id") & missing("session_key")
            ),
            "invalid_transaction_normalization_rows": rows_where(
                (F.col("transaction_id_status") == "VALID") & missing("transaction_id_normalized")
            ),
        },
        [distinct("staging_unique_users", "user_pseudo_id"), distinct("staging_distinct_event_names", "event_name")],
    )
    m = _side_by_side(src, stg)
    dates = _same("source_first_event_date", "staging_first_event_date") & _same(
        "source_last_event_date", "staging_last_event_date"
    )
    rows = _same("source_event_rows", "staging_event_rows")
    users = _same("source_unique_users", "staging_unique_users")
    names = _same("source_distinct_event_names", "staging_distinct_event_names")
    purchases = _same("source_purchase_event_rows", "staging_purchase_event_rows")
    defects = [
        "null_event_date_rows",
        "null_event_timestamp_rows",
        "invalid_session_key_rows",
        "invalid_transaction_normalization_rows",
    ]
    good = _all(
        rows,
        users,
        names,
        dates,
        purchases,
        _same("staging_purchase_events_with_session_id", "staging_purchase_event_rows"),
        _same("staging_purchase_events_with_currency", "staging_purchase_event_rows"),
        _none(*defects),
        _expected(expected),
    )
    return m.select(
        "source_event_rows",
        "staging_event_rows",
        (F.col("staging_event_rows") - F.col("source_event_rows")).alias("event_row_difference"),
        rows.alias("event_rows_match"),
        "source_unique_users",
        "staging_unique_users",
        users.alias("unique_users_match"),
        "source_distinct_event_names",
        "staging_distinct_event_names",
        names.alias("event_name_counts_match"),
        "source_first_event_date",
        "staging_first_event_date",
        "source_last_event_date",
        "staging_last_event_date",
        dates.alias("date_range_matches"),
        "source_purchase_event_rows",
        "staging_purchase_event_rows",
        purchases.alias("purchase_event_rows_match"),
        "staging_purchase_events_with_session_id",
        "staging_purchase_events_with_currency",
        *defects,
        _status(good, "REVIEW"),
    )


def reconcile_items(source: DataFrame, staged_items: DataFrame) -> DataFrame:
    """Does every nested item become exactly one row, for every event name?"""
    length = F.coalesce(F.array_size("items"), F.lit(0))
    per_source = (
        source.groupBy("event_name").agg(F.sum(length).alias("nested")).where(F.col("nested") > 0)
    )
    per_staged = staged_items.groupBy("event_name").agg(F.count(F.lit(1)).alias("rows"))
    nested, rows = F.coalesce("nested", F.lit(0)), F.coalesce("rows", F.lit(0))
    compared = _measures(
        per_source.join(per_staged, "event_name", "full_outer"),
        compared_event_names=F.count(F.lit(1)),
        event_names_with_item_row_mismatch=rows_where(nested != rows),
        source_item_rows=F.sum(nested),
        staging_item_rows=F.sum(rows),
    )
    purchases = _measures(
        source, source_purchase_item_rows=sum_where(F.col("event_name") == "purchase", length)
    )
    bought = F.col("is_purchase_event")
    priced = F.col("item_revenue_in_usd").isNotNull()
    quality = _measures(
        staged_items,
        staging_purchase_item_rows=rows_where(bought),
        purchase_item_rows_with_item_revenue=rows_where(bought & priced),
        purchase_item_rows_without_item_revenue=rows_where(bought & ~priced),
        invalid_item_offset_rows=rows_where(F.coalesce(F.col("item_offset") < 0, F.lit(True))),
        null_item_fingerprint_rows=rows_where(F.col("item_record_fingerprint").isNull()),
        rows_without_item_identity=rows_where(F.col("item_identity").isNull()),
        invalid_session_key_rows=rows_where(F.col("has_session_id") & F.col("session_key").isNull()),
        invalid_transaction_normalization_rows=rows_where(
            (F.col("transaction_id_status") == "VALID") & F.col("transaction_id_normalized").isNull()
        ),
        duplicate_item_fingerprints=F.count(F.lit(1)) - F.count_distinct("item_record_fingerprint"),
    )
    items = _same("source_item_rows", "staging_item_rows")
    purchase_items = _same("source_purchase_item_rows", "staging_purchase_item_rows")
    good = _all(
        items,
        purchase_items,
        _none(
            "event_names_with_item_row_mismatch",
            "invalid_item_offset_rows",
            "null_item_fingerprint_rows",
            "invalid_session_key_rows",
            "invalid_transaction_normalization_rows",
        ),
    )
    return _side_by_side(compared, purchases, quality).select(
        "source_item_rows",
        "staging_item_rows",
        (F.col("staging_item_rows") - F.col("source_item_rows")).alias("item_row_difference"),
        items.alias("item_rows_match"),
        "compared_event_names",
        "event_names_with_item_row_mismatch",
        "source_purchase_item_rows",
        "staging_purchase_item_rows",
        purchase_items.alias("purchase_item_rows_match"),
        "purchase_item_rows_with_item_revenue",
        "purchase_item_rows_without_item_revenue",
        "invalid_item_offset_rows",
        "null_item_fingerprint_rows",
        "rows_without_item_identity",
        "invalid_session_key_rows",
        "invalid_transaction_normalization_rows",
        "duplicate_item_fingerprints",
        _status(good, "REVIEW"),
    )


def reconcile_transactions(
    staged: DataFrame, transactions: DataFrame, expected: dict[str, float] | None = None
) -> DataFrame:
    """Is every purchase event represented once, and is revenue kept?"""
    of = lambda method: rows_where(F.col("transaction_key_method") == method)
    reliable = F.col("transaction_key_method") == RELIABLE
    conflict = F.col("transaction_id_cross_user_conflict") | F.col("transaction_id_revenue_conflict")
    revenue = F.col("transaction_revenue_usd")
    src = _measures(
        staged.where("is_purchase_event"),
        source_purchase_event_rows=F.count(F.lit(1)),
        source_raw_purchase_revenue_usd=F.sum("ecommerce_purchase_revenue_in_usd"),
    )
    fact = _measures(
        transactions,
        fact_transaction_rows=F.count(F.lit(1)),
        distinct_transaction_keys=F.count_distinct("transaction_key"),
        represented_purchase_event_rows=F.sum("measurement_event_rows"),
        duplicate_measurement_rows_removed=F.sum("duplicate_measurement_rows"),
        canonical_transaction_revenue_usd=F.sum(revenue),
        represented_raw_purchase_revenue_usd=F.sum(revenue * F.col("measurement_event_rows")),
        reliable_transaction_id_rows=of(RELIABLE),
        conflicting_id_fallback_rows=of(CONFLICTING),
        missing_id_fallback_rows=of(MISSING),
        not_set_fallback_rows=of(NOT_SET),
        null_transaction_key_rows=rows_where(F.col("transaction_key").isNull()),
        null_transaction_revenue_rows=rows_where(revenue.isNull()),
        unreliable_rows_classified_as_reliable=rows_where(reliable & conflict),
        grouped_fallback_transaction_rows=rows_where(~reliable & (F.col("measurement_event_rows") != 1)),
    )
    represented = _same("source_purchase_event_rows", "represented_purchase_event_rows")
    raw_kept = F.round("source_raw_purchase_revenue_usd", 6) == F.round(
        "represented_raw_purchase_revenue_usd", 6
    )
    defects = [
        "null_transaction_key_rows",
        "null_transaction_revenue_rows",
        "unreliable_rows_classified_as_reliable",
        "grouped_fallback_transaction_rows",
    ]
    good = _all(
        represented,
        _same("fact_transaction_rows", "distinct_transaction_keys"),
        raw_kept,
        _none(*defects),
        _expected(expected),
    )
    return _side_by_side(src, fact).select(
        "source_purchase_event_rows",
        "represented_purchase_event_rows",
        represented.alias("all_purchase_events_represented"),
        "fact_transaction_rows",
        "distinct_transaction_keys",
        (F.col("fact_transaction_rows") - F.col("distinct_transaction_keys")).alias("duplicate_transaction_keys"),
        (F.col("source_purchase_event_rows") - F.col("fact_transaction_rows")).alias(
            "purchase_rows_removed_by_deduplication"
        ),
        "duplicate_measurement_rows_removed",
        "source_raw_purchase_revenue_usd",
        "represented_raw_purchase_revenue_usd",
        raw_kept.alias("raw_revenue_reconciles"),
        "canonical_transaction_revenue_usd",
        (F.col("source_raw_purchase_revenue_usd") - F.col("canonical_transaction_revenue_usd")).alias(
            "duplicate_measurement_revenue_removed_usd"
        ),
        "reliable_transaction_id_rows",
        "conflicting_id_fallback_rows",
        "missing_id_fallback_rows",
        "not_set_fallback_rows",
        *defects,
        _status(good, "REVIEW"),
    )


def reconcile_sessions(
    staged: DataFrame, transactions: DataFrame, sessions: DataFrame, expected: dict[str, float] | None = None
) -> DataFrame:
    """Do sessions represent all events, users, transactions and revenue?"""
    missing = lambda c: F.col(c).isNull()
    src = one_pass(
        staged,
        {
            "source_event_rows": F.count(F.lit(1)),
            "source_events_without_session_key": rows_where(missing("session_key")),
            "source_purchase_measurement_events": rows_where(F.col("event_name") == "purchase"),
        },
        [distinct("source_distinct_sessions", "session_key"), distinct("source_unique_users", "user_pseudo_id")],
    )
    tx = _measures(
        transactions,
        source_canonical_transactions=F.count(F.lit(1)),
        source_canonical_revenue_usd=F.sum("transaction_revenue_usd"),
        transactions_without_session_key=rows_where(missing("session_key")),
    )
    fact = one_pass(
        sessions,
        {
            "fact_session_rows": F.count(F.lit(1)),
            "represented_event_rows": F.sum("event_count"),
            "represented_purchase_measurement_events": F.sum("raw_purchase_measurement_event_count"),
            "represented_canonical_transactions": F.sum("canonical_transaction_count"),
            "represented_canonical_revenue_usd": F.sum("canonical_revenue_usd"),
            "duplicate_purchase_measurement_rows": F.sum("duplicate_purchase_measurement_rows"),
            "converting_sessions": rows_where(F.col("is_converting_session")),
            "sessions_with_multiple_transactions": rows_where(F.col("canonical_transaction_count") > 1),
            "sessions_without_session_start_event": rows_where(F.col("session_start_event_count") == 0),
            "negative_session_duration_rows": rows_where(F.col("session_duration_seconds") < 0),
            "null_session_source_rows": rows_where(missing("session_source")),
            "null_session_medium_rows": rows_where(missing("session_medium")),
            "null_session_channel_group_rows": rows_where(missing("session_channel_group")),
        },
        [distinct("distinct_fact_session_keys", "session_key"), distinct("fact_unique_users", "user_pseudo_id")],
    )
    pairs = {
        "all_events_represented": _same("source_event_rows", "represented_event_rows"),
        "session_counts_match": _same("source_distinct_sessions", "fact_session_rows"),
        "session_keys_are_unique": _same("fact_session_rows", "distinct_fact_session_keys"),
        "user_counts_match": _same("source_unique_users", "fact_unique_users"),
        "purchase_measurement_events_match": _same(
            "source_purchase_measurement_events", "represented_purchase_measurement_events"
        ),
        "canonical_transactions_match": _same(
            "source_canonical_transactions", "represented_canonical_transactions"
        ),
        "canonical_revenue_matches": F.round("source_canonical_revenue_usd", 6)
        == F.round("represented_canonical_revenue_usd", 6),
    }
    surplus = F.col("source_purchase_measurement_events") - F.col("source_canonical_transactions")
    good = _all(
        *[c for name, c in pairs.items()],
        F.col("duplicate_purchase_measurement_rows") == surplus,
        _none(
            "source_events_without_session_key",
            "transactions_without_session_key",
            "negative_session_duration_rows",
            "null_session_source_rows",
            "null_session_medium_rows",
            "null_session_channel_group_rows",
        ),
        _expected(expected),
    )
    shown = lambda name: pairs[name].alias(name)
    return _side_by_side(src, tx, fact).select(
        "source_event_rows",
        "represented_event_rows",
        shown("all_events_represented"),
        "source_distinct_sessions",
        "fact_session_rows",
        "distinct_fact_session_keys",
        shown("session_counts_match"),
        shown("session_keys_are_unique"),
        "source_unique_users",
        "fact_unique_users",
        shown("user_counts_match"),
        "source_events_without_session_key",
        "source_purchase_measurement_events",
        "represented_purchase_measurement_events",
        shown("purchase_measurement_events_match"),
        "source_canonical_transactions",
        "represented_canonical_transactions",
        shown("canonical_transactions_match"),
        "source_canonical_revenue_usd",
        "represented_canonical_revenue_usd",
        shown("canonical_revenue_matches"),
        surplus.alias("expected_duplicate_purchase_measurement_rows"),
        "duplicate_purchase_measurement_rows",
        "converting_sessions",
        "sessions_with_multiple_transactions",
        "sessions_without_session_start_event",
        "transactions_without_session_key",
        "negative_session_duration_rows",
        "null_session_source_rows",
        "null_session_medium_rows",
        "null_session_channel_group_rows",
        _status(good, "REVIEW"),
    )


def reconcile_bridge(
    transactions: DataFrame,
    bridge: DataFrame,
    lookback_days: int,
    expected: dict[str, float] | None = None,
) -> DataFrame:
    """Does the bridge represent every transaction, with one flag of each kind per journey?"""
    any_null = lambda *cs: reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cs])
    not_one = lambda c: rows_where(F.col(c) != 1)
    src = _measures(
        transactions,
        source_transaction_count=F.count(F.lit(1)),
        source_transaction_users=F.count_distinct("user_pseudo_id"),
        source_canonical_revenue_usd=F.sum("transaction_revenue_usd"),
        source_fallback_transactions=rows_where(F.col("uses_fallback_transaction_key")),
    )
    per_journey = _measures(
        journeys(bridge),
        represented_transaction_count=F.count(F.lit(1)),
        represented_transaction_users=F.count_distinct("user_pseudo_id"),
        represented_canonical_revenue_usd=F.sum("transaction_revenue_usd"),
        represented_fallback_transactions=rows_where(F.col("uses_fallback_transaction_key")),
        bridge_row_count=F.sum("touchpoint_count"),
        minimum_touchpoints_per_transaction=F.min("touchpoint_count"),
        average_touchpoints_per_transaction=F.round(F.avg("touchpoint_count"), 2),
        maximum_touchpoints_per_transaction=F.max("touchpoint_count"),
        multi_touch_transactions=rows_where(F.col("touchpoint_count") > 1),
        direct_only_transactions=rows_where(F.col("non_direct_touchpoint_count") == 0),
        left_censored_transactions=rows_where(F.col("is_lookback_left_censored")),
        conversion_session_errors=not_one("conversion_session_count"),
        first_touchpoint_flag_errors=not_one("first_touchpoint_flag_count"),
        last_touchpoint_flag_errors=not_one("last_touchpoint_flag_count"),
        last_non_direct_flag_errors=not_one("last_non_direct_attribution_flag_count"),
    )
    rows = _measures(
        bridge,
        future_touchpoint_rows=rows_where(F.col("seconds_before_transaction") < 0),
        outside_lookback_rows=rows_where(F.col("seconds_before_transaction") > lookback_days * 86400),
        null_required_identifier_rows=rows_where(
            any_null("transaction_key", "user_pseudo_id", "transaction_session_key", "touchpoint_session_key")
        ),
        null_attribution_dimension_rows=rows_where(
            any_null("touchpoint_source", "touchpoint_medium", "touchpoint_channel_group")
        ),
    )
    repeats = _measures(
        bridge.groupBy("transaction_key", "touchpoint_session_key").agg(F.count(F.lit(1)).alias("n")),
        duplicate_transaction_touchpoint_pairs=rows_where(F.col("n") > 1),
    )
    matches = {
        "transaction_counts_match": _same("source_transaction_count", "represented_transaction_count"),
        "transaction_user_counts_match": _same("source_transaction_users", "represented_transaction_users"),
        "canonical_revenue_matches": _close(
            "source_canonical_revenue_usd", "represented_canonical_revenue_usd"
        ),
        "fallback_transaction_counts_match": _same(
            "source_fallback_transactions", "represented_fallback_transactions"
        ),
    }
    defects = [c for c in per_journey.columns if c.endswith("_errors")] + rows.columns + repeats.columns
    good = _all(
        *matches.values(),
        F.col("minimum_touchpoints_per_transaction") >= 1,
        _none(*defects),
        _expected(expected, 0.01),
    )
    wide = _side_by_side(src, per_journey, rows, repeats)
    return wide.select("*", *[c.alias(name) for name, c in matches.items()], _status(good, "FAIL"))


def reconcile_credits(
    transactions: DataFrame, bridge: DataFrame, credits: DataFrame, expected: dict[str, float] | None = None
) -> DataFrame:
    """One row per model: does it hand out every transaction and all revenue exactly once?"""
    spark = credits.sparkSession
    single = {"first_touch", "last_touch", "last_non_direct"}
    listed = const_relation(
        spark,
        [(place, name, name in single) for place, name in enumerate(MODELS, start=1)],
        "attribution_model_order int, attribution_model string, _single boolean",
    )
    revenue, conversions = F.col("attributed_revenue_usd"), F.col("attributed_conversion_credit")
    complete, direct = F.col("is_complete_lookback_window"), F.col("is_direct_touchpoint")
    # A pass per transaction first: weights per transaction, and everything that sums up.
    per_transaction = credits.groupBy("attribution_model", "transaction_key").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("user_pseudo_id").alias("user"),
        F.bool_or("is_complete_lookback_window").alias("complete"),
        F.sum("attribution_weight").alias("weight"),
        F.sum(conversions).alias("conversions"),
        F.sum(revenue).alias("revenue"),
        sum_where(direct, conversions, 0.0).alias("direct_conversions"),
        sum_where(direct, revenue, 0.0).alias("direct_revenue"),
        rows_where(
            F.col("attribution_weight").isNull()
            | (F.col("attribution_weight") <= 0)
            | (F.col("attribution_weight") > 1)
        ).alias("bad_weights"),
        rows_where(
            F.col("transaction_key").isNull()
            | F.col("touchpoint_session_key").isNull()
            | F.col("touchpoint_channel_group").isNull()
            | revenue.isNull()
        ).alias("nulls"),
    )
    off_one = lambda c: rows_where(F.abs(F.col(c) - 1.0) > 1e-9)
    per_model = per_transaction.groupBy("attribution_model").agg(
        F.sum("rows").alias("model_credit_rows"),
        F.count(F.lit(1)).alias("represented_transactions"),
        F.count_distinct("user").alias("represented_users"),
        rows_where(F.col("complete")).alias("complete_window_transactions"),
        F.sum("weight").alias("_weight"),
        F.sum("conversions").alias("_conversions"),
        F.sum("revenue").alias("_revenue"),
        sum_where(F.col("complete"), F.col("revenue"), 0.0).alias("_complete"),
        sum_where(~F.col("complete"), F.col("revenue"), 0.0).alias("_censored"),
        F.sum("direct_conversions").alias("_direct_conversions"),
        F.sum("direct_revenue").alias("_direct_revenue"),
        off_one("weight").alias("transaction_weight_errors"),
        off_one("conversions").alias("transaction_conversion_credit_errors"),
        F.sum("bad_weights").alias("_bad_weights"),
        F.sum("nulls").alias("_nulls"),
    )
    channels = credits.groupBy("attribution_model").agg(
        F.count_distinct("touchpoint_channel_group").alias("credited_channel_count")
    )
    overall = _measures(
        per_model,
        total_credit_rows=F.sum("model_credit_rows"),
        distinct_attribution_models=F.count(F.lit(1)),
        invalid_weight_rows=F.sum("_bad_weights"),
        null_required_field_rows=F.sum("_nulls"),
    )
    repeats = _measures(
        credits.groupBy("attribution_model", "transaction_key", "touchpoint_session_key").agg(
            F.count(F.lit(1)).alias("n")
        ),
        duplicate_credit_pair_groups=rows_where(F.col("n") > 1),
    )
    src = _measures(
        transactions,
        source_transactions=F.count(F.lit(1)),
        source_users=F.count_distinct("user_pseudo_id"),
        source_revenue_usd=F.sum("transaction_revenue_usd"),
    )
    size = _measures(
        bridge,
        _bridge_rows=F.count(F.lit(1)),
        _journeys=rows_where(F.col("is_last_touchpoint")),
    )
    wide = _side_by_side(
        listed.join(per_model, "attribution_model").join(channels, "attribution_model"),
        src,
        size,
        overall,
        repeats,
    ).withColumn(
        "expected_model_credit_rows", F.when(F.col("_single"), F.col("_journeys")).otherwise(F.col("_bridge_rows"))
    )
    matches = {
        "model_credit_row_count_matches": _same("expected_model_credit_rows", "model_credit_rows"),
        "transaction_count_matches": _same("source_transactions", "represented_transactions"),
        "user_count_matches": _same("source_users", "represented_users"),
        "revenue_matches": _close("source_revenue_usd", "_revenue"),
    }
    near_count = lambda c: F.abs(F.col(c) - F.col("source_transactions")) < 1e-6
    good = _all(
        *matches.values(),
        near_count("_weight"),
        near_count("_conversions"),
        F.col("distinct_attribution_models") == len(MODELS),
        _none(
            "transaction_weight_errors",
            "transaction_conversion_credit_errors",
            "invalid_weight_rows",
            "null_required_field_rows",
            "duplicate_credit_pair_groups",
        ),
        _expected(expected, 0.01),
    )
    shown = lambda name: matches[name].alias(name)
    rounded = lambda c, digits, name: F.round(c, digits).alias(name)
    return wide.select(
        "attribution_model_order",
        "attribution_model",
        "expected_model_credit_rows",
        "model_credit_rows",
        shown("model_credit_row_count_matches"),
        "source_transactions",
        "represented_transactions",
        shown("transaction_count_matches"),
        "source_users",
        "represented_users",
        shown("user_count_matches"),
        "complete_window_transactions",
        rounded("_weight", 6, "total_attribution_weight"),
        rounded("_conversions", 6, "total_attributed_conversions"),
        "source_revenue_usd",
        rounded("_revenue", 2, "total_attributed_revenue_usd"),
        shown("revenue_matches"),
        rounded("_complete", 2, "complete_window_attributed_revenue_usd"),
        rounded("_censored", 2, "left_censored_attributed_revenue_usd"),
        rounded("_direct_conversions", 6, "direct_attributed_conversions"),
        rounded("_direct_revenue", 2, "direct_attributed_revenue_usd"),
        "credited_channel_count",
        "transaction_weight_errors",
        "transaction_conversion_credit_errors",
        "total_credit_rows",
        "distinct_attribution_models",
        "invalid_weight_rows",
        "null_required_field_rows",
        "duplicate_credit_pair_groups",
        _status(good, "FAIL", "model_reconciliation_status"),
    ).orderBy("attribution_model_order")


def population_totals(credits: DataFrame, model: str = "last_touch") -> DataFrame:
    """Conversions and revenue of each population, from a model that credits one touchpoint."""
    of_model = credits.where(F.col("attribution_model") == model).groupBy("is_complete_lookback_window").agg(
        F.sum("attributed_conversion_credit").alias("c"), F.sum("attributed_revenue_usd").alias("r")
    )
    complete = F.col("is_complete_lookback_window")
    all_of = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    part_of = lambda c: F.coalesce(F.sum(F.when(complete, F.col(c))), F.lit(0.0))
    one_row = of_model.agg(
        *[f(c).alias(f"{c}{i}") for i, f in ((1, all_of), (2, part_of)) for c in ("c", "r")]
    )
    return one_row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(order).alias("analysis_population_order"),
                        F.lit(name).alias("analysis_population"),
                        F.col(f"c{order}").alias("expected_conversions"),
                        F.col(f"r{order}").alias("expected_revenue_usd"),
                    )
                    for order, name, _ in POPULATIONS
                ]
            )
        )
    )


def reconcile_comparison(comparison: DataFrame, expectations: DataFrame, channels: int) -> DataFrame:
    """One row per population and model; ``expectations`` as given by ``population_totals``."""
    model = F.col("attribution_model")
    baseline_gap = lambda name, c: F.max(
        F.abs(F.when(model == name, F.col(c)).otherwise(F.lit(0.0)))
    )
    per = comparison.groupBy("analysis_population", "attribution_model").agg(
        F.min("attribution_model_order").alias("attribution_model_order"),
        F.count(F.lit(1)).alias("represented_channel_rows"),
        F.count_distinct("touchpoint_channel_group").alias("represented_channels"),
        F.sum("attributed_conversion_credit").alias("_conversions"),
        F.sum("attributed_revenue_usd").alias("_revenue"),
        F.sum("model_conversion_share").alias("_conversion_share"),
        F.sum("model_revenue_share").alias("_revenue_share"),
        F.sum("conversion_delta_vs_last_touch").alias("_conversion_delta"),
        F.sum("revenue_delta_vs_last_touch_usd").alias("_revenue_delta"),
        (F.sum(F.abs("revenue_delta_vs_last_touch_usd")) / 2).alias("_moved"),
        baseline_gap("last_touch", "revenue_delta_vs_last_touch_usd").alias("last_touch_baseline_error"),
        baseline_gap("last_non_direct", "revenue_delta_vs_last_non_direct_usd").alias(
            "last_non_direct_baseline_error"
        ),
        rows_where(
            (F.col("attributed_conversion_credit") < 0) | (F.col("attributed_revenue_usd") < 0)
        ).alias("negative_metric_rows"),
        rows_where(
            F.col("touchpoint_channel_group").isNull()
            | F.col("attributed_conversion_credit").isNull()
            | F.col("attributed_revenue_usd").isNull()
        ).alias("null_required_field_rows"),
    )
    overall = _measures(
        comparison,
        total_table_rows=F.count(F.lit(1)),
        model_population_combinations=F.count_distinct("analysis_population", "attribution_model"),
        represented_models=F.count_distinct("attribution_model"),
        represented_populations=F.count_distinct("analysis_population"),
    )
    repeats = _measures(
        comparison.groupBy("analysis_population", "attribution_model", "touchpoint_channel_group").agg(
            F.count(F.lit(1)).alias("n")
        ),
        duplicate_population_model_channel_groups=rows_where(F.col("n") > 1),
    )
    near = lambda c, target, tol: F.abs(F.col(c) - target) < tol
    good = _all(
        F.col("represented_channel_rows") == channels,
        F.col("represented_channels") == channels,
        near("_conversions", F.col("expected_conversions"), 1e-6),
        near("_revenue", F.col("expected_revenue_usd"), 0.01),
        near("_conversion_share", 1.0, 1e-9),
        near("_revenue_share", 1.0, 1e-9),
        near("_conversion_delta", 0.0, 1e-6),
        near("_revenue_delta", 0.0, 0.01),
        F.col("last_touch_baseline_error") < 0.01,
        F.col("last_non_direct_baseline_error") < 0.01,
        _none(
            "negative_metric_rows",
            "null_required_field_rows",
            "duplicate_population_model_channel_groups",
        ),
        F.col("represented_models") == len(MODELS),
        F.col("represented_populations") == len(POPULATIONS),
        F.col("total_table_rows") == channels * len(MODELS) * len(POPULATIONS),
        F.col("model_population_combinations") == len(MODELS) * len(POPULATIONS),
    )
    rounded = {
        "attributed_conversions": ("_conversions", 6),
        "attributed_revenue_usd": ("_revenue", 2),
        "conversion_share_sum": ("_conversion_share", 6),
        "revenue_share_sum": ("_revenue_share", 6),
        # Adding zero turns a rounded -0.0 into 0.0.
        "net_conversion_delta_vs_last_touch": ("_conversion_delta", 6),
        "net_revenue_delta_vs_last_touch_usd": ("_revenue_delta", 2),
        "revenue_reallocated_vs_last_touch_usd": ("_moved", 2),
    }
    wide = _side_by_side(per.join(F.broadcast(expectations), "analysis_population"), overall, repeats)
    return wide.select(
        "analysis_population_order",
        "analysis_population",
        "attribution_model_order",
        "attribution_model",
        "represented_channel_rows",
        "represented_channels",
        "expected_conversions",
        "expected_revenue_usd",
        *[(F.round(c, digits) + 0.0).alias(name) for name, (c, digits) in rounded.items()],
        "last_touch_baseline_error",
        "last_non_direct_baseline_error",
        "negative_metric_rows",
        "null_required_field_rows",
        *overall.columns,
        *repeats.columns,
        _status(good, "FAIL"),
    ).orderBy("analysis_population_order", "attribution_model_order")


def reconcile_geo(
    outcomes: DataFrame,
    target: DataFrame,
    weeks: int,
    pre_weeks: int,
    expected: dict[str, float] | None = None,
) -> DataFrame:
    """Does the region-week panel hold all sessions of the target market, for all weeks?"""
    s, t, r = (F.col(f"observed_{c}") for c in ("session_count", "transaction_count", "revenue_usd"))
    chosen = F.col("meets_initial_eligibility")
    early = chosen & (F.col("period_name") == "PRE")
    pre_rows = rows_where(F.col("period_name") == "PRE")
    # Per region first; what is left is one row per region.
    regions = outcomes.groupBy("geo_region").agg(
        F.count(F.lit(1)).alias("rows"),
        pre_rows.alias("pre"),
        F.bool_or("meets_initial_eligibility").alias("chosen"),
        F.min("week_start_date").alias("first"),
        F.max("week_end_date").alias("last"),
        *[F.sum(c).alias(n) for n, c in (("s", s), ("t", t), ("r", r))],
        *[sum_where(early, c, 0).alias(f"early_{n}") for n, c in (("s", s), ("t", t), ("r", r))],
        *[sum_where(chosen, c, 0).alias(f"chosen_{n}") for n, c in (("s", s), ("t", t), ("r", r))],
    )
    complete = F.col("rows") == weeks
    split = complete & (F.col("pre") == pre_weeks)
    table = _measures(
        regions,
        table_rows=F.sum("rows"),
        region_count=F.count(F.lit(1)),
        eligible_region_count=rows_where(F.col("chosen")),
        eligible_region_week_rows=sum_where(F.col("chosen"), F.col("rows")),
        first_week_start_date=F.min("first"),
        last_week_end_date=F.max("last"),
        table_session_count=F.sum("s"),
        table_transaction_count=F.sum("t"),
        _revenue=F.sum("r"),
        eligible_pre_session_count=F.sum("early_s"),
        eligible_pre_transaction_count=F.sum("early_t"),
        _early_revenue=F.sum("early_r"),
        eligible_total_session_count=F.sum("chosen_s"),
        eligible_total_transaction_count=F.sum("chosen_t"),
        _chosen_revenue=F.sum("chosen_r"),
        all_regions_have_all_weeks=F.bool_and(complete),
        all_regions_have_all_pre_and_test_weeks=F.bool_and(split),
    )
    calendar = _measures(outcomes, distinct_week_count=F.count_distinct("week_start_date"))
    source = _measures(
        target,
        source_session_count=F.count(F.lit(1)),
        source_transaction_count=F.sum("canonical_transaction_count"),
        _source_revenue=F.sum("canonical_revenue_usd"),
    )
    matches = {
        "sessions_reconcile": _same("table_session_count", "source_session_count"),
        "transactions_reconcile": _same("table_transaction_count", "source_transaction_count"),
        "revenue_reconciles": _close("_revenue", "_source_revenue"),
    }
    good = _all(
        *matches.values(),
        F.col("table_rows") == F.col("region_count") * weeks,
        F.col("distinct_week_count") == weeks,
        F.col("all_regions_have_all_weeks"),
        F.col("all_regions_have_all_pre_and_test_weeks"),
        _expected(expected, 0.01),
    )
    money = lambda c, name: F.round(c, 2).alias(name)
    return _side_by_side(table, calendar, source).select(
        "table_rows",
        "region_count",
        "distinct_week_count",
        "eligible_region_count",
        "eligible_region_week_rows",
        "first_week_start_date",
        "last_week_end_date",
        "table_session_count",
        "source_session_count",
        "table_transaction_count",
        "source_transaction_count",
        money("_revenue", "table_revenue_usd"),
        money("_source_revenue", "source_revenue_usd"),
        "eligible_pre_session_count",
        "eligible_pre_transaction_count",
        money("_early_revenue", "eligible_pre_revenue_usd"),
        "eligible_total_session_count",
        "eligible_total_transaction_count",
        money("_chosen_revenue", "eligible_total_revenue_usd"),
        "all_regions_have_all_weeks",
        "all_regions_have_all_pre_and_test_weeks",
        *[c.alias(name) for name, c in matches.items()],
        _status(good, "FAIL"),
    )
