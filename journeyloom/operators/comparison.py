"""Channel comparison over models and populations, and the shift analysis on top of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from journeyloom.functions.numeric import ratio
from journeyloom.operators.sessions import DIRECT_CHANNEL
from journeyloom.sources.workspace import settle

ALL_OBSERVED, COMPLETE_WINDOW = "all_observed", "complete_window"
BASELINE, SECOND_BASELINE = "last_touch", "last_non_direct"

SPINE = [
    "analysis_population_order",
    "analysis_population",
    "is_complete_window_population",
    "attribution_model_order",
    "attribution_model",
    "touchpoint_channel_group",
]
MEASURES = {
    "credited_touchpoint_rows": F.sum,
    "credited_transactions": F.sum,
    "attributed_conversion_credit": F.sum,
    "attributed_revenue_usd": F.sum,
}


def _population(order: int, name: str, complete: bool) -> Column:
    return F.struct(
        F.lit(order).alias("analysis_population_order"),
        F.lit(name).alias("analysis_population"),
        F.lit(complete).alias("is_complete_window_population"),
    )


POPULATIONS = ((1, ALL_OBSERVED, False), (2, COMPLETE_WINDOW, True))


def channel_credit(credits: DataFrame) -> DataFrame:
    """Credit per window kind, model and channel: the only pass over the credit fact.

    Complete and censored transactions are disjoint, so every measure of the population of all
    transactions is the sum of the two kinds.
    """
    return credits.groupBy(
        "is_complete_lookback_window",
        "attribution_model_order",
        "attribution_model",
        "touchpoint_channel_group",
    ).agg(
        F.count(F.lit(1)).alias("credited_touchpoint_rows"),
        F.count_distinct("transaction_key").alias("credited_transactions"),
        F.sum("attributed_conversion_credit").alias("attributed_conversion_credit"),
        F.sum("attributed_revenue_usd").alias("attributed_revenue_usd"),
    )


def _filled(kinds: DataFrame) -> DataFrame:
    """Population x model x channel, zeros where nothing was credited.

    The grid is exploded from one row of model and channel lists, which hold the few labels that
    occur in the aggregate; no relation is crossed with another.
    """
    grid = (
        kinds.agg(
            F.collect_set(F.struct("attribution_model_order", "attribution_model")).alias("_models"),
            F.collect_set("touchpoint_channel_group").alias("_channels"),
        )
        .select(F.explode("_models").alias("_m"), "_channels")
        .select("_m.*", F.explode("_channels").alias("touchpoint_channel_group"))
        .select("*", F.inline(F.array(*[_population(*p) for p in POPULATIONS])))
    )
    both = F.array(*[_population(*p) for p in POPULATIONS])
    all_only = F.array(_population(*POPULATIONS[0]))
    observed = (
        kinds.select(
            "*", F.inline(F.when(F.col("is_complete_lookback_window"), both).otherwise(all_only))
        )
        .groupBy(*SPINE)
        .agg(*[how(name).alias(name) for name, how in MEASURES.items()])
    )
    return (
        grid.join(observed, SPINE, "left")
        .fillna(0, ["credited_touchpoint_rows", "credited_transactions"])
        .fillna(0.0, ["attributed_conversion_credit", "attributed_revenue_usd"])
        .select(*SPINE, *MEASURES)
    )


def channel_comparison(credits: DataFrame) -> DataFrame:
    """Shares, deltas against two baseline models and rank, per population, model and channel.

    After the aggregate a few dozen rows are left; totals and baselines are windows over them.  These
    rows are written: the grid and the sums both read them, and the credits are built once.
    """
    grid = _filled(settle(channel_credit(credits), "channel_credit"))
    model = Window.partitionBy("analysis_population", "attribution_model")
    channel = Window.partitionBy("analysis_population", "touchpoint_channel_group")
    conv, rev = F.col("attributed_conversion_credit"), F.col("attributed_revenue_usd")
    baseline = lambda name, c: F.max(F.when(F.col("attribution_model") == name, c)).over(channel)
    with_levels = grid.withColumns(
        {
            "model_total_attributed_conversions": F.sum(conv).over(model),
            "model_total_attributed_revenue_usd": F.sum(rev).over(model),
            "last_touch_attributed_conversions": baseline(BASELINE, conv),
            "last_touch_attributed_revenue_usd": baseline(BASELINE, rev),
            "last_non_direct_attributed_conversions": baseline(SECOND_BASELINE, conv),
            "last_non_direct_attributed_revenue_usd": baseline(SECOND_BASELINE, rev),
            "channel_revenue_rank_within_model": F.row_number().over(
                model.orderBy(F.desc("attributed_revenue_usd"), "touchpoint_channel_group")
            ),
        }
    )
    total_conv = F.col("model_total_attributed_conversions")
    total_rev = F.col("model_total_attributed_revenue_usd")
    lt_conv, lt_rev = F.col("last_touch_attributed_conversions"), F.col("last_touch_attributed_revenue_usd")
    lnd_conv = F.col("last_non_direct_attributed_conversions")
    lnd_rev = F.col("last_non_direct_attributed_revenue_usd")
    return with_levels.select(
        *SPINE,
        *MEASURES,
        ratio(rev, conv).alias("attributed_average_order_value_usd"),
        "model_total_attributed_conversions",
        "model_total_attributed_revenue_usd",
        ratio(conv, total_conv).alias("model_conversion_share"),
        ratio(rev, total_rev).alias("model_revenue_share"),
        "last_touch_attributed_conversions",
        "last_touch_attributed_revenue_usd",
        (conv - lt_conv).alias("conversion_delta_vs_last_touch"),
        (rev - lt_rev).alias("revenue_delta_vs_last_touch_usd"),
        ratio(conv - lt_conv, lt_conv).alias("conversion_delta_pct_vs_last_touch"),
        ratio(rev - lt_rev, lt_rev).alias("revenue_delta_pct_vs_last_touch"),
        (ratio(rev, total_rev) - ratio(lt_rev, total_rev)).alias("revenue_share_delta_vs_last_touch"),
        "last_non_direct_attributed_conversions",
        "last_non_direct_attributed_revenue_usd",
        (conv - lnd_conv).alias("conversion_delta_vs_last_non_direct"),
        (rev - lnd_rev).alias("revenue_delta_vs_last_non_direct_usd"),
        "channel_revenue_rank_within_model",
    )


def comparison_summary(comparison: DataFrame) -> DataFrame:
    keys = SPINE[:2] + SPINE[3:5]
    total = lambda c, digits: F.round(F.sum(c), digits)
    moved = F.sum(F.abs("revenue_delta_vs_last_touch_usd")) / 2
    of_direct = F.max(
        F.when(F.col("touchpoint_channel_group") == DIRECT_CHANNEL, F.col("attributed_revenue_usd"))
    )
    return (
        comparison.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("represented_channels"),
            total("attributed_conversion_credit", 6).alias("attributed_conversions"),
            total("attributed_revenue_usd", 2).alias("attributed_revenue_usd"),
            total("model_conversion_share", 6).alias("conversion_share_sum"),
            total("model_revenue_share", 6).alias("revenue_share_sum"),
            F.round(moved, 2).alias("revenue_reallocated_vs_last_touch_usd"),
            F.round(of_direct, 2).alias("direct_attributed_revenue_usd"),
        )
        .orderBy("analysis_population_order", "attribution_model_order")
    )


# Short prefix -> population.
SIDES = {"full": ALL_OBSERVED, "complete": COMPLETE_WINDOW}

# The four readings of a shift.
READINGS = {
    "none": "No material difference from last touch",
    "under": "Potentially undervalued by last touch",
    "over": "Potentially overvalued by last touch",
    "mixed": "Direction changes across populations",
}

# Measure of the shift analysis -> digits in the reported table.
SHIFT_MEASURES = {
    "model_revenue_usd": 2,
    "last_touch_revenue_usd": 2,
    "revenue_delta_vs_last_touch_usd": 2,
    "relative_revenue_delta_vs_last_touch": 6,
    "model_revenue_share": 6,
    "last_touch_revenue_share": 6,
    "revenue_share_delta_vs_last_touch": 6,
    "model_revenue_rank": None,
    "last_touch_revenue_rank": None,
    "revenue_rank_change_vs_last_touch": None,
}


def shift_analysis(comparison: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Unrounded shift table: model x channel, both populations side by side."""
    channel = Window.partitionBy("analysis_population", "touchpoint_channel_group")
    of_baseline = lambda c: F.max(F.when(F.col("attribution_model") == BASELINE, F.col(c))).over(channel)
    rev, base = F.col("model_revenue_usd"), F.col("last_touch_revenue_usd")
    measured = (
        comparison.withColumns(
            {
                "last_touch_conversion_credit": of_baseline("attributed_conversion_credit"),
                "last_touch_revenue_usd": of_baseline("attributed_revenue_usd"),
                "last_touch_revenue_share": of_baseline("model_revenue_share"),
                "last_touch_average_order_value_usd": of_baseline("attributed_average_order_value_usd"),
                "last_touch_revenue_rank": of_baseline("channel_revenue_rank_within_model"),
            }
        )
        .where(F.col("attribution_model") != BASELINE)
        .withColumnsRenamed(
            {
                "attributed_conversion_credit": "model_conversion_credit",
                "attributed_revenue_usd": "model_revenue_usd",
                "attributed_average_order_value_usd": "model_average_order_value_usd",
                "channel_revenue_rank_within_model": "model_revenue_rank",
            }
        )
        .drop(
            "conversion_delta_vs_last_touch",
            "revenue_delta_vs_last_touch_usd",
            "revenue_share_delta_vs_last_touch",
        )
        .withColumns(
            {
                "conversion_delta_vs_last_touch": F.col("model_conversion_credit")
                - F.col("last_touch_conversion_credit"),
                "revenue_delta_vs_last_touch_usd": rev - base,
                "relative_revenue_delta_vs_last_touch": ratio(rev - base, base),
                "revenue_share_delta_vs_last_touch": F.col("model_revenue_share")
                - F.col("last_touch_revenue_share"),
                "revenue_rank_change_vs_last_touch": F.col("model_revenue_rank")
                - F.col("last_touch_revenue_rank"),
                # A model hands out all revenue of its population, so its total is the
                # population's total.
                "delta_share_of_population_revenue": ratio(
                    rev - base, F.col("model_total_attributed_revenue_usd")
                ),
            }
        )
    )
    carried = [
        "model_conversion_credit",
        "last_touch_conversion_credit",
        "conversion_delta_vs_last_touch",
        *SHIFT_MEASURES,
        "model_average_order_value_usd",
        "last_touch_average_order_value_usd",
        "delta_share_of_population_revenue",
    ]
    wide = measured.groupBy("attribution_model_order", "attribution_model", "touchpoint_channel_group").agg(
        *[
            F.max(F.when(F.col("analysis_population") == population, F.col(c))).alias(f"{side}_{c}")
            for side, population in SIDES.items()
            for c in carried
        ]
    )
    full, complete = (F.col(f"{side}_revenue_delta_vs_last_touch_usd") for side in SIDES)
    reading = (
        F.when(F.greatest(F.abs(full), F.abs(complete)) < tolerance, READINGS["none"])
        .when(F.least(full, complete) > 0, READINGS["under"])
        .when(F.greatest(full, complete) < 0, READINGS["over"])
        .otherwise(READINGS["mixed"])
    )
    return wide.withColumns(
        {
            "normalized_delta_change_between_populations": F.col("complete_delta_share_of_population_revenue")
            - F.col("full_delta_share_of_population_revenue"),
            "directional_interpretation": reading,
            "attribution_direction_consistent": reading != READINGS["mixed"],
        }
    )


def channel_shift(comparison: DataFrame) -> DataFrame:
    """The reported shift table: rounded and ordered by the size of the shift."""
    analysis = shift_analysis(comparison)
    shown = [
        (F.round(c, digits) if digits is not None else F.col(c)).alias(c)
        for side in SIDES
        for c, digits in ((f"{side}_{m}", d) for m, d in SHIFT_MEASURES.items())
    ]
    shares = [
        "full_delta_share_of_population_revenue",
        "complete_delta_share_of_population_revenue",
        "normalized_delta_change_between_populations",
    ]
    return analysis.orderBy(
        "attribution_model_order",
        F.abs("full_revenue_delta_vs_last_touch_usd").desc(),
        "touchpoint_channel_group",
    ).select(
        "attribution_model_order",
        "attribution_model",
        "touchpoint_channel_group",
        *shown,
        *[F.round(c, 6).alias(c) for c in shares],
        "attribution_direction_consistent",
        "directional_interpretation",
    )
