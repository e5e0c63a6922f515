"""The chains of the warehouse: what is built from what, and where frames are written down."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from journeyloom.config import AttributionConfig, GeoConfig, SkewConfig
from journeyloom.operators import (
    attribution,
    comparison,
    contracts,
    entities,
    geo_design,
    panel,
    sessions as session_ops,
    staging,
    transactions as transaction_ops,
)
from journeyloom.sources.publish import CODEC, publish
from journeyloom.sources.tables import mart_path
from journeyloom.sources.workspace import drop_frames, freed_shuffles, settle, watched_frames


@dataclass(frozen=True)
class AttributionChain:
    """Raw events to channel shifts.

    The staging views stay lazy.  Facts that later steps read more than once are written to the
    shared folder, as the warehouse does with its tables; everything else is one plan.
    """

    events: DataFrame
    config: AttributionConfig = AttributionConfig()
    skew: SkewConfig = SkewConfig()

    @cached_property
    def staged(self) -> DataFrame:
        return staging.stage_events(self.events)

    @cached_property
    def items(self) -> DataFrame:
        return staging.stage_items(self.events)

    @cached_property
    def transactions(self) -> DataFrame:
        return settle(transaction_ops.fct_transactions(self.staged, self.skew), "fct_transactions")

    @cached_property
    def session_rows(self) -> DataFrame:
        """The session fact for a step that reads it once: not written, so columns not asked for are not built."""
        return session_ops.fct_sessions(self.staged, self.transactions)

    @cached_property
    def sessions(self) -> DataFrame:
        return settle(self.session_rows, "fct_sessions")

    @cached_property
    def bridge(self) -> DataFrame:
        return attribution.bridge_touchpoints(self.transactions, self.sessions, self.config)

    @cached_property
    def settled_bridge(self) -> DataFrame:
        return settle(self.bridge, "bridge_transaction_touchpoints")

    @cached_property
    def credits(self) -> DataFrame:
        return attribution.attribution_credits(self.bridge, self.config)

    @cached_property
    def settled_credits(self) -> DataFrame:
        return settle(
            attribution.attribution_credits(self.settled_bridge, self.config), "fct_attribution_credits"
        )

    @cached_property
    def comparison(self) -> DataFrame:
        return comparison.channel_comparison(self.credits)


@dataclass(frozen=True)
class GeoChain:
    """Sessions to matched region pairs."""

    sessions: DataFrame
    config: GeoConfig = GeoConfig()

    @cached_property
    def normalized(self) -> DataFrame:
        return panel.normalize_geo_sessions(self.sessions, self.config.window)

    @cached_property
    def profile(self) -> DataFrame:
        return panel.geo_profile(self.normalized, self.config)

    @cached_property
    def outcomes(self) -> DataFrame:
        return panel.geo_weekly_outcomes(self.sessions, self.config)

    @cached_property
    def pre_panel(self) -> DataFrame:
        """Small from here on: eligible regions x PRE weeks."""
        return settle(panel.eligible_pre_panel(self.outcomes), "pre_panel")

    @cached_property
    def features(self) -> DataFrame:
        return settle(geo_design.region_features(self.pre_panel), "region_features")

    @cached_property
    def profiles(self) -> DataFrame:
        return geo_design.matching_profiles(
            self.features.select(
                "geo_region",
                "pre_sessions",
                "pre_transactions",
                "pre_revenue_usd",
                *geo_design.MATCHING_FEATURES,
            )
        )

    @cached_property
    def pairs(self) -> DataFrame:
        return settle(geo_design.pair_metrics(self.profiles, self.pre_panel), "pair_metrics")

    @cached_property
    def scored(self) -> DataFrame:
        return settle(geo_design.composite_score(self.pairs), "scored_pairs")

    @cached_property
    def thresholds(self) -> DataFrame:
        return settle(geo_design.threshold_summary(self.pairs), "thresholds")

    @cached_property
    def edges(self) -> DataFrame:
        return settle(geo_design.candidate_edges(self.scored, self.thresholds), "candidate_edges")

    @cached_property
    def matched(self) -> DataFrame:
        return settle(geo_design.match_pairs(self.edges), "matched_pairs")

    @cached_property
    def extended(self) -> DataFrame:
        """The same design reached from the pairs taken lightest first."""
        return geo_design.extended_pairs(self.edges, geo_design.greedy_pairs(self.edges))


# Published table -> columns its files are laid out by, and the key that cuts ranges of equal values.
LAYOUT: dict[str, tuple[list[str], str | None]] = {
    "fct_transactions": (["transaction_date", "transaction_key_method", "user_pseudo_id"], "transaction_key"),
    "fct_transaction_items": (["transaction_date", "item_category", "item_id"], "transaction_item_key"),
    "fct_sessions": (["session_date", "session_channel_group", "user_pseudo_id"], "session_key"),
    "dim_pseudo_users": (["user_pseudo_id"], None),
    "dim_date": (["date_day"], None),
    "dim_channel": (["channel_order"], None),
    "dim_geo": (["geo_country", "geo_region"], None),
    "bridge_transaction_touchpoints": (
        ["transaction_date", "touchpoint_channel_group", "user_pseudo_id"],
        "touchpoint_session_key",
    ),
    "mart_attribution_paths": (["transaction_date", "transaction_key"], None),
    "fct_attribution_credits": (
        ["transaction_date", "attribution_model", "touchpoint_channel_group", "user_pseudo_id"],
        "touchpoint_session_key",
    ),
    "mart_attribution_channel_comparison": (
        ["analysis_population", "attribution_model", "touchpoint_channel_group"],
        None,
    ),
    "mart_attribution_channel_shifts": (["attribution_model", "touchpoint_channel_group"], None),
    "fct_geo_weekly_outcomes": (["geo_region", "period_name"], "geo_key"),
}


def _put(
    out: dict[str, DataFrame], root: str, name: str, df: DataFrame | list[DataFrame], checks: list[contracts.Contract]
) -> DataFrame:
    cluster_by, spread = LAYOUT[name]
    out[name] = publish(df, mart_path(root, name), checks, cluster_by, spread)
    return out[name]


def publish_attribution(chain: AttributionChain, root: str, channels: int) -> dict[str, DataFrame]:
    """Publish facts, dimensions and marts in order, each behind its contracts.

    A later table is built from the published earlier ones, never from an unchecked build.  So what was
    written on the way to a table goes when it stands, and shuffles go with the step that made them: disk
    holds the published tables and one step.
    """
    spark = chain.events.sparkSession
    with freed_shuffles(spark), watched_frames() as passing:
        try:
            return _publish_attribution(chain, root, channels, passing)
        finally:
            drop_frames(spark, passing)


def _publish_attribution(chain: AttributionChain, root: str, channels: int, passing: list[str]) -> dict[str, DataFrame]:
    """``passing`` are the frames settled for the table that is being built."""
    out: dict[str, DataFrame] = {}
    days, most = chain.config.lookback_days, chain.config.slice_rows

    def put(name: str, df: DataFrame | list[DataFrame], checks: list[contracts.Contract]) -> DataFrame:
        build = _put(out, root, name, df, checks)
        drop_frames(build.sparkSession, passing)
        passing.clear()
        return build

    tx = put(
        "fct_transactions",
        transaction_ops.fct_transactions(chain.staged, chain.skew),
        contracts.transaction_contracts(chain.staged),
    )
    put("fct_transaction_items", entities.fct_transaction_items(tx, chain.items), contracts.item_contracts(tx))
    # Settled, or the shuffles of the events would be held beside that of the ranges.
    sessions = put(
        "fct_sessions",
        settle(session_ops.fct_sessions(chain.staged, tx), "fct_sessions", CODEC),
        contracts.session_contracts(chain.staged, tx),
    )
    put("dim_pseudo_users", entities.dim_pseudo_users(sessions, tx), contracts.user_contracts(tx))
    put(
        "dim_date",
        entities.dim_date(sessions, "session_date"),
        [contracts.Contract.unique("days are unique", "date_day"), contracts.Contract.not_null("days are set", "date_day")],
    )
    put("dim_channel", entities.dim_channel(sessions), contracts.dimension_contracts(sessions, "channel_group"))
    put("dim_geo", entities.dim_geo(sessions), contracts.dimension_contracts(sessions, "geo_country", "geo_region"))
    bridge = put(
        "bridge_transaction_touchpoints",
        attribution.bridge_slices(tx, sessions, chain.config),
        contracts.bridge_contracts(tx, days),
    )
    put("mart_attribution_paths", entities.mart_attribution_paths(bridge), contracts.path_contracts(tx))
    credits = [
        attribution.attribution_credits(bridge.where(run), chain.config)
        for run in attribution.day_slices(bridge, "transaction_date", most)
    ]
    put("fct_attribution_credits", credits, contracts.credit_contracts(bridge))
    contracts.enforce(
        attribution.credit_summary(out["fct_attribution_credits"]), contracts.credit_total_contracts(tx)
    )
    mart = put(
        "mart_attribution_channel_comparison",
        comparison.channel_comparison(out["fct_attribution_credits"]),
        contracts.comparison_contracts(channels, bridge),
    )
    put("mart_attribution_channel_shifts", comparison.shift_analysis(mart), contracts.shift_contracts(channels))
    return out


def publish_geo(chain: GeoChain, root: str) -> DataFrame:
    """Publish the region-week outcome table behind its contracts."""
    window = chain.config.window
    checks = contracts.geo_contracts(
        panel.target_sessions(chain.sessions, chain.config), window.week_count, window.pre_week_count
    )
    region_weeks = contracts.Contract.unique("region-weeks are unique", "geo_region", "week_start_date")
    with freed_shuffles(chain.sessions.sparkSession):
        return _put({}, root, "fct_geo_weekly_outcomes", chain.outcomes, [*checks, region_weeks])
