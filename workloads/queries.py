"""The registered queries: every operator run over the whole given tables.

``plain`` is applied at the edge only: it turns dates, timestamps and arrays into text and
numbers, and rounds doubles, so that results can be compared with another engine value by value.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from journeyloom.config import (
    AttributionConfig,
    EligibilityThresholds,
    ExperimentWindow,
    GeoConfig,
    SkewConfig,
)
from journeyloom.operators import (
    attribution,
    comparison,
    contracts,
    entities,
    geo_design,
    panel,
    profiling,
    reconcile,
    sessions,
    staging,
    transactions,
)
from journeyloom.plans.warehouse import LAYOUT, AttributionChain, GeoChain, publish_attribution, publish_geo
from journeyloom.sources import tables
from journeyloom.sources.publish import layout_report
from journeyloom.sources.workspace import results_folder, settle
from workloads.adapter import geo_sessions, nested_events

LOOKBACK_DAYS = 7
# Whole span of the given orders: 1995-01-01 is a Sunday.
GEO = GeoConfig(
    window=ExperimentWindow(
        start=dt.date(1995, 1, 1),
        pre_end=dt.date(1999, 12, 25),
        test_start=dt.date(1999, 12, 26),
        end=dt.date(2001, 8, 4),
    ),
    thresholds=EligibilityThresholds(
        min_active_weeks=180, min_sessions=345, min_transactions=262, min_revenue_usd=66_500_000.0, max_revenue_cv=1.15
    ),
    target_country="World",
)

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c, t = F.col(f.name), f.dataType
        if isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(t, T.IntegralType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def _chain(spark: SparkSession, sf_dir: str) -> AttributionChain:
    return AttributionChain(nested_events(spark, sf_dir), AttributionConfig(lookback_days=LOOKBACK_DAYS))


def _geo(spark: SparkSession, sf_dir: str, one_market: bool = True) -> GeoChain:
    return GeoChain(geo_sessions(spark, sf_dir, one_market), GEO)


def _on_events(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: plain(op(nested_events(spark, sf)))


def _on_chain(op: Callable[[AttributionChain], DataFrame]) -> Query:
    return lambda spark, sf: plain(op(_chain(spark, sf)))


def _on_geo(op: Callable[[GeoChain], DataFrame], one_market: bool = True) -> Query:
    return lambda spark, sf: plain(op(_geo(spark, sf, one_market)))


# ---- sources ------------------------------------------------------------------------------------


def read_events_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Write the events by day, read two weeks of them back through the partition filter."""
    path = f"{results_folder(spark)}/events-by-day"
    tables.write_events(nested_events(spark, sf), path)
    back = tables.read_events(spark, path, "20240108", "20240121")
    return plain(
        back.groupBy("event_date").agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count_distinct("user_pseudo_id").alias("unique_pseudo_users"),
        )
    )


def verify_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Two shards that have different fields: the later one knows no device and no privacy settings."""
    wanted = [*tables.REQUIRED_PATHS, "app_info.version"]
    events = nested_events(spark, sf)
    early = events.where(F.col("event_date") < "20240116")
    late = events.where(F.col("event_date") >= "20240116").drop("device", "privacy_info")
    return plain(tables.verify_schema([early, late], wanted, count_rows=True))


def _published(spark: SparkSession, sf: str) -> tuple[str, list[str]]:
    root = f"{results_folder(spark)}/marts"
    names = list(publish_attribution(_chain(spark, sf), root, channels=7))
    publish_geo(_geo(spark, sf), root)
    return root, [*names, "fct_geo_weekly_outcomes"]


def published_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Publish all tables behind their contracts; count the rows that readers find."""
    root, names = _published(spark, sf)
    return plain(
        _union(
            [
                tables.read_mart(spark, root, name).agg(
                    F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count")
                )
                for name in names
            ]
        )
    )


def published_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of the clustering columns in the files of the published tables."""
    root, names = _published(spark, sf)
    reports = [
        layout_report(spark, tables.mart_path(root, name), LAYOUT[name][0]).select(
            F.lit(name).alias("table_name"), "row_count", "overlapping_files", "overlapping_blocks"
        )
        for name in names
    ]
    return plain(_union(reports))


def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """Export the region features as CSV and read them back."""
    path = f"{results_folder(spark)}/region_features.csv"
    tables.write_csv(plain(_geo(spark, sf).features), path)
    names = ["geo_region", "pre_weeks", "pre_sessions", "pre_revenue_usd", "revenue_cv"]
    back = spark.read.option("header", True).csv(path)
    return plain(
        back.select(
            "geo_region",
            F.col("pre_weeks").cast("bigint").alias("pre_weeks"),
            *[F.col(c).cast("double").alias(c) for c in names[2:]],
        )
    )


# ---- staging, transactions, sessions ------------------------------------------------------------


def extract_params(events: DataFrame) -> DataFrame:
    columns = [p.column for p in staging.EVENT_PARAMS]
    return staging.extract_params(events).select("event_bundle_sequence_id", *columns)


def _stage_view(*columns: str) -> Query:
    return _on_events(lambda ev: staging.stage_events(ev).select(*columns))


def register_views(spark: SparkSession, sf: str) -> DataFrame:
    """Staging registered as views and queried by name."""
    ev = nested_events(spark, sf)
    tables.register_view(staging.stage_events(ev), "stg_events")
    tables.register_view(staging.stage_items(ev), "stg_items")
    return plain(
        spark.sql(
            "SELECT event_name, count(*) AS event_rows, sum(item_record_count) AS nested_items, "
            "(SELECT count(*) FROM stg_items) AS all_item_rows FROM stg_events GROUP BY event_name"
        )
    )


def _purchases(chain: AttributionChain) -> DataFrame:
    return transactions.purchase_events(chain.staged)


def _classified(chain: AttributionChain, skew: SkewConfig = SkewConfig()) -> DataFrame:
    bought = settle(_purchases(chain), "purchase_events")
    return transactions.classify_key_method(bought, transactions.transaction_id_profile(bought), skew)


def classify_key_method(chain: AttributionChain, skew: SkewConfig = SkewConfig()) -> DataFrame:
    return _classified(chain, skew).select(
        "source_event_fingerprint", "transaction_key_method", *transactions.PROFILE_COLUMNS
    )


def assign_transaction_key(chain: AttributionChain) -> DataFrame:
    return transactions.assign_transaction_key(_classified(chain)).select(
        "source_event_fingerprint", "transaction_key_method", "transaction_key"
    )


def sessionize(chain: AttributionChain) -> DataFrame:
    flat = sessions.sessionize(chain.staged)
    keep = [f.name for f in flat.schema.fields if not isinstance(f.dataType, T.StructType)]
    return flat.select(
        *keep,
        F.col("acquisition.source").alias("acquisition_source"),
        F.col("acquisition.medium").alias("acquisition_medium"),
        F.col("acquisition.campaign").alias("acquisition_campaign"),
        F.col("entry_page.page_location").alias("entry_page_location"),
        F.col("exit_page.page_location").alias("exit_page_location"),
    )


# ---- contracts ----------------------------------------------------------------------------------


def _named(table: str, df: DataFrame, checks: list[contracts.Contract]) -> DataFrame:
    return contracts.check(df, checks).select(F.lit(table).alias("table_name"), "*")


def attribution_contracts(chain: AttributionChain) -> DataFrame:
    tx, se, br, cr = chain.transactions, chain.sessions, chain.settled_bridge, chain.settled_credits
    mart = settle(comparison.channel_comparison(cr), "comparison")
    days = chain.config.lookback_days
    reports = [
        _named("fct_transactions", tx, contracts.transaction_contracts(chain.staged)),
        _named("fct_sessions", se, contracts.session_contracts(chain.staged, tx)),
        _named("bridge_transaction_touchpoints", br, contracts.bridge_contracts(tx, days)),
        _named("fct_attribution_credits", cr, contracts.credit_contracts(br)),
        _named(
            "attribution_credit_totals",
            attribution.credit_summary(cr),
            contracts.credit_total_contracts(tx),
        ),
        _named("mart_attribution_channel_comparison", mart, contracts.comparison_contracts(7, br)),
        _named("channel_shift_analysis", comparison.shift_analysis(mart), contracts.shift_contracts(7)),
        _named("dim_pseudo_users", entities.dim_pseudo_users(se, tx), contracts.user_contracts(tx)),
        _named("fct_transaction_items", entities.fct_transaction_items(tx, chain.items), contracts.item_contracts(tx)),
        _named("mart_attribution_paths", entities.mart_attribution_paths(br), contracts.path_contracts(tx)),
        _named("dim_channel", entities.dim_channel(se), contracts.dimension_contracts(se, "channel_group")),
        _named("dim_geo", entities.dim_geo(se), contracts.dimension_contracts(se, "geo_country", "geo_region")),
    ]
    return _union(reports)


def geo_contracts(chain: GeoChain) -> DataFrame:
    window = chain.config.window
    target = panel.target_sessions(chain.sessions, chain.config)
    outcomes = settle(chain.outcomes, "outcomes")
    z = [c for c in chain.profiles.columns if c.startswith("z_")]
    ends = chain.matched.select("design_name", F.explode(F.array("region_a", "region_b")).alias("region"))
    return _union(
        [
            _named(
                "fct_geo_weekly_outcomes",
                outcomes,
                contracts.geo_contracts(target, window.week_count, window.pre_week_count),
            ),
            _named("region_features", chain.features, contracts.feature_contracts(window.pre_week_count)),
            _named("matching_profiles", chain.profiles, contracts.profile_contracts(z)),
            _named("pair_metrics", chain.pairs, contracts.pair_contracts(geo_design.PAIR_MEASURES)),
            _named("candidate_designs", ends, contracts.design_contracts()),
        ]
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def reconcile_comparison(chain: AttributionChain) -> DataFrame:
    credits = chain.settled_credits
    mart = settle(comparison.channel_comparison(credits), "comparison")
    return reconcile.reconcile_comparison(mart, reconcile.population_totals(credits), channels=7)


def reconcile_geo(chain: GeoChain) -> DataFrame:
    window = chain.config.window
    return reconcile.reconcile_geo(
        settle(chain.outcomes, "outcomes"),
        panel.target_sessions(chain.sessions, chain.config),
        window.week_count,
        window.pre_week_count,
    )


# ---- geo ----------------------------------------------------------------------------------------


def balanced_panel(chain: GeoChain) -> DataFrame:
    usable = chain.normalized.where("is_valid_geography")
    return panel.balanced_panel(usable, panel.GEO_KEYS, GEO.window, panel.profile_measures())


def week_numbers(chain: GeoChain) -> DataFrame:
    """Ordinals of every observed week, over the weeks all sessions fall into."""
    weeks = chain.normalized.groupBy("week_start_date").agg(F.count(F.lit(1)).alias("session_count"))
    period = F.when(F.col("week_start_date") <= F.lit(GEO.window.pre_end), "PRE").otherwise("TEST")
    return panel.week_numbers(weeks.withColumn("period_name", period), GEO.window)


def week_spine(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly calendar over the span of the orders, with the orders of every week."""
    chain = _geo(spark, sf)
    seen = chain.normalized.groupBy("week_start_date").agg(F.count(F.lit(1)).alias("session_count"))
    spine = tables.week_spine(spark, GEO.window.start, GEO.window.end)
    return plain(spine.join(seen, "week_start_date", "left").fillna(0, ["session_count"]))


def eligibility(chain: GeoChain) -> DataFrame:
    return chain.profile.select(
        "geo_key",
        "pre_active_session_weeks",
        "pre_sessions",
        "pre_transactions",
        "pre_revenue_usd",
        "pre_revenue_coefficient_of_variation",
        "meets_initial_eligibility",
        "eligibility_status",
    )


def outcome_matrix(chain: GeoChain) -> DataFrame:
    regions = [f"NATION_{i}" for i in range(25)]
    return panel.outcome_matrix(chain.outcomes, "observed_revenue_usd", regions)


def normalized_geo(chain: GeoChain) -> DataFrame:
    return chain.normalized


QUERIES: dict[str, Query] = {
    # sources and sinks
    "read_events_pruned": read_events_pruned,
    "verify_schema": verify_schema,
    "register_views": register_views,
    "published_tables": published_tables,
    "published_layout": published_layout,
    "csv_export": csv_export,
    "week_spine": week_spine,
    # profiling
    "dataset_overview": _on_events(profiling.dataset_overview),
    "event_name_profile": _on_events(profiling.event_name_profile),
    "parameter_profile": _on_events(profiling.parameter_profile),
    "purchase_quality": _on_events(profiling.purchase_quality),
    "duplicate_transaction_patterns": _on_events(profiling.duplicate_transaction_patterns),
    "candidate_key_profile": _on_events(profiling.candidate_key_profile),
    "final_key_profile": _on_events(profiling.final_key_profile),
    # staging
    "extract_params": _on_events(extract_params),
    "event_fingerprint": _stage_view("source_event_fingerprint", "event_bundle_sequence_id"),
    "session_key": _stage_view("event_bundle_sequence_id", "session_key", "has_user_pseudo_id", "has_session_id"),
    "transaction_id_status": _stage_view(
        "event_bundle_sequence_id", "transaction_id_raw", "transaction_id_normalized", "transaction_id_status"
    ),
    "stage_events": _on_events(staging.stage_events),
    "stage_items": _on_events(staging.stage_items),
    # transactions
    "transaction_id_profile": _on_chain(lambda c: transactions.transaction_id_profile(_purchases(c))),
    "classify_key_method": _on_chain(classify_key_method),
    # As above, with every ID of two purchases or more taken for a hot key.
    "classify_key_method_hot": _on_chain(lambda c: classify_key_method(c, SkewConfig(min_hot_rows=2))),
    "assign_transaction_key": _on_chain(assign_transaction_key),
    "fct_transactions": _on_chain(lambda c: transactions.fct_transactions(c.staged)),
    # sessions
    "sessionize": _on_chain(sessionize),
    "transactions_by_session": _on_chain(lambda c: sessions.transactions_by_session(c.transactions)),
    "session_source_medium": _on_chain(
        lambda c: c.sessions.select("session_key", "session_source", "session_medium", "session_campaign")
    ),
    "channel_group": _on_chain(
        lambda c: c.sessions.groupBy("session_source", "session_medium", "session_channel_group").agg(
            F.count(F.lit(1)).alias("session_rows")
        )
    ),
    "fct_sessions": _on_chain(lambda c: sessions.fct_sessions(c.staged, c.transactions)),
    "session_build_summary": _on_chain(lambda c: sessions.session_build_summary(c.sessions)),
    # attribution
    "eligible_touchpoints": _on_chain(
        lambda c: attribution.eligible_touchpoints(c.transactions, c.sessions, c.config)
    ),
    # As above, with every cell of more than two rows cut into lanes and slots.
    "eligible_touchpoints_cut": _on_chain(
        lambda c: attribution.eligible_touchpoints(c.transactions, c.sessions, replace(c.config, lane_rows=2))
    ),
    "rank_touchpoints": _on_chain(
        lambda c: c.bridge.select(
            "transaction_key",
            "touchpoint_session_key",
            "touchpoint_count",
            "non_direct_touchpoint_count",
            "touchpoint_position_asc",
            "touchpoint_position_desc",
            "non_direct_touchpoint_position_asc",
            "non_direct_touchpoint_position_desc",
        )
    ),
    "bridge_touchpoints": _on_chain(lambda c: c.bridge),
    "bridge_summary": _on_chain(lambda c: attribution.bridge_summary(c.bridge)),
    "attribution_credits": _on_chain(lambda c: c.credits),
    "credit_summary": _on_chain(lambda c: attribution.credit_summary(c.settled_credits)),
    "channel_comparison": _on_chain(lambda c: c.comparison),
    "comparison_summary": _on_chain(lambda c: comparison.comparison_summary(c.comparison)),
    "channel_shift": _on_chain(lambda c: comparison.channel_shift(c.comparison)),
    # geo panel
    "normalize_geo_sessions": _on_geo(normalized_geo, one_market=False),
    "balanced_panel": _on_geo(balanced_panel, one_market=False),
    "week_numbers": _on_geo(week_numbers),
    "geo_profile": _on_geo(lambda c: c.profile, one_market=False),
    "eligibility": _on_geo(eligibility, one_market=False),
    "geo_coverage": _on_geo(lambda c: panel.geo_coverage(c.normalized), one_market=False),
    "country_feasibility": _on_geo(lambda c: panel.country_feasibility(c.profile), one_market=False),
    "region_candidates": _on_geo(lambda c: panel.region_candidates(c.profile), one_market=False),
    "geo_weekly_outcomes": _on_geo(lambda c: c.outcomes),
    "eligible_pre_panel": _on_geo(lambda c: panel.eligible_pre_panel(c.outcomes)),
    "outcome_matrix": _on_geo(outcome_matrix),
    # geo design
    "region_summary": _on_geo(lambda c: geo_design.region_summary(c.pre_panel)),
    "region_features": _on_geo(lambda c: c.features),
    "feature_range_summary": _on_geo(lambda c: geo_design.feature_range_summary(c.features)),
    "feature_correlations": _on_geo(lambda c: geo_design.feature_correlations(c.features)),
    "standardize": _on_geo(lambda c: c.profiles),
    "pair_metrics": _on_geo(lambda c: c.pairs),
    "pair_metric_summary": _on_geo(lambda c: geo_design.pair_metric_summary(c.pairs)),
    "top_feature_pairs": _on_geo(lambda c: geo_design.top_pairs(c.pairs)),
    "composite_score": _on_geo(lambda c: c.scored),
    "pair_distance_sensitivity": _on_geo(lambda c: geo_design.pair_distance_sensitivity(c.pairs)),
    "threshold_summary": _on_geo(lambda c: c.thresholds),
    "candidate_edges": _on_geo(lambda c: c.edges),
    "match_pairs": _on_geo(lambda c: c.matched),
    "matching_sizes": _on_geo(lambda c: geo_design.matching_sizes(c.edges, c.matched)),
    "design_summary": _on_geo(lambda c: geo_design.design_summary(c.edges, c.matched)),
    "extended_pairs": _on_geo(lambda c: c.extended),
    "extended_design_summary": _on_geo(lambda c: geo_design.design_summary(c.edges, c.extended)),
    # contracts and reconciliation
    "attribution_contracts": _on_chain(attribution_contracts),
    "geo_contracts": _on_geo(geo_contracts),
    "reconcile_events": lambda spark, sf: plain(
        reconcile.reconcile_events(
            nested_events(spark, sf), staging.stage_events(nested_events(spark, sf))
        )
    ),
    "reconcile_items": _on_events(
        lambda ev: reconcile.reconcile_items(ev, staging.stage_items(ev))
    ),
    "reconcile_transactions": _on_chain(lambda c: reconcile.reconcile_transactions(c.staged, c.transactions)),
    "reconcile_sessions": _on_chain(
        lambda c: reconcile.reconcile_sessions(c.staged, c.transactions, c.sessions)
    ),
    "reconcile_bridge": _on_chain(
        lambda c: reconcile.reconcile_bridge(c.transactions, c.settled_bridge, LOOKBACK_DAYS)
    ),
    "reconcile_credits": _on_chain(
        lambda c: reconcile.reconcile_credits(c.transactions, c.settled_bridge, c.settled_credits)
    ),
    "reconcile_comparison": _on_chain(reconcile_comparison),
    "reconcile_geo": _on_geo(reconcile_geo),
    # entities the design names without SQL
    "fct_transaction_items": _on_chain(
        lambda c: entities.fct_transaction_items(c.transactions, c.items)
    ),
    "dim_pseudo_users": _on_chain(lambda c: entities.dim_pseudo_users(c.sessions, c.transactions)),
    "dim_date": _on_events(lambda ev: entities.dim_date(staging.stage_events(ev), "event_date")),
    "dim_channel": _on_chain(lambda c: entities.dim_channel(c.session_rows)),
    "dim_channel_mapping": _on_chain(lambda c: entities.dim_channel_mapping(c.sessions)),
    "dim_geo": _on_chain(lambda c: entities.dim_geo(c.sessions)),
    "attribution_path_steps": _on_chain(lambda c: entities.attribution_path_steps(c.settled_bridge)),
    "mart_attribution_paths": _on_chain(lambda c: entities.mart_attribution_paths(c.settled_bridge)),
}
