"""Matched-market design: region features, pair similarity, candidate designs, matching.

Regions are geographies of one country.  Their number does not grow with the event volume; the
pair table is quadratic in it by definition of the method.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from journeyloom.config import COMPOSITE_BLEND, DESIGNS, DesignSpec, SkewConfig
from journeyloom.functions.numeric import min_max_ratio, ratio, rows_where
from journeyloom.operators.onepass import attach_row
from journeyloom.operators.skew import lookup_join, quantiles, value_ladder
from journeyloom.sources.tables import const_relation
from journeyloom.sources.workspace import settle

# Below this size a mean, total or deviation counts as zero.
NEAR_ZERO = 1e-8

MATCHING_FEATURES = [
    "log_pre_sessions",
    "log_pre_revenue",
    "pre_transaction_rate_pct",
    "revenue_cv",
    "session_trend_pct_per_week",
    "revenue_trend_pct_per_week",
]
RANGE_FEATURES = [
    "pre_sessions",
    "pre_transactions",
    "pre_revenue_usd",
    "pre_transaction_rate_pct",
    "pre_revenue_per_session_usd",
    "pre_average_order_value_usd",
    "revenue_cv",
    "session_trend_pct_per_week",
    "transaction_trend_pct_per_week",
    "revenue_trend_pct_per_week",
]
CORRELATION_FEATURES = [
    "log_pre_sessions",
    "log_pre_revenue",
    "pre_transaction_rate_pct",
    "pre_revenue_per_session_usd",
    "pre_average_order_value_usd",
    "revenue_cv",
    "session_trend_pct_per_week",
    "transaction_trend_pct_per_week",
    "revenue_trend_pct_per_week",
]
PRIMARY_DISTANCE, SENSITIVITY_DISTANCE = (
    "category_balanced_feature_distance",
    "six_feature_distance_sensitivity",
)
PAIR_MEASURES = (
    PRIMARY_DISTANCE,
    SENSITIVITY_DISTANCE,
    "session_correlation",
    "revenue_correlation",
    "session_shape_nrmse",
    "revenue_shape_nrmse",
    "session_scale_ratio",
    "transaction_scale_ratio",
    "revenue_scale_ratio",
)


def near_zero(c: Column) -> Column:
    return F.abs(c) <= NEAR_ZERO


def region_summary(panel: DataFrame) -> DataFrame:
    """Totals and weekly spread of every region of the PRE panel."""
    return (
        panel.groupBy("geo_region")
        .agg(
            F.count_distinct("week_start_date").alias("pre_weeks"),
            F.sum("observed_session_count").alias("pre_sessions"),
            F.sum("observed_transaction_count").alias("pre_transactions"),
            F.sum("observed_revenue_usd").alias("pre_revenue_usd"),
            F.avg("observed_revenue_usd").alias("average_weekly_revenue_usd"),
            F.stddev_samp("observed_revenue_usd").alias("weekly_revenue_stddev_usd"),
            F.first("pre_revenue_coefficient_of_variation").alias("revenue_coefficient_of_variation"),
        )
        .orderBy(F.desc("pre_revenue_usd"), F.desc("pre_sessions"))
    )


def _trend(measure: str) -> Column:
    """Fitted weekly change in percent of the mean; NULL when the mean is zero."""
    y = F.col(measure).cast("double")
    slope = F.regr_slope(y, F.col("period_week_number").cast("double"))
    return F.when(~near_zero(F.avg(y)), 100 * ratio(slope, F.avg(y)))


def region_features(panel: DataFrame) -> DataFrame:
    """Matching features per region, from PRE weeks only."""
    rev = F.col("observed_revenue_usd")
    base = panel.groupBy("geo_region").agg(
        F.count_distinct("week_start_date").alias("pre_weeks"),
        F.sum("observed_session_count").cast("double").alias("pre_sessions"),
        F.sum("observed_transaction_count").cast("double").alias("pre_transactions"),
        F.sum(rev).alias("pre_revenue_usd"),
        F.avg(rev).alias("average_weekly_revenue_usd"),
        F.stddev_samp(rev).alias("weekly_revenue_stddev_usd"),
        rows_where(rev == 0).alias("zero_revenue_weeks"),
        _trend("observed_session_count").alias("session_trend_pct_per_week"),
        _trend("observed_transaction_count").alias("transaction_trend_pct_per_week"),
        _trend("observed_revenue_usd").alias("revenue_trend_pct_per_week"),
        F.first("pre_revenue_coefficient_of_variation").alias("warehouse_revenue_cv"),
    )
    s, t, r = F.col("pre_sessions"), F.col("pre_transactions"), F.col("pre_revenue_usd")
    mean = F.col("average_weekly_revenue_usd")
    return base.select(
        "geo_region",
        "pre_weeks",
        "pre_sessions",
        "pre_transactions",
        "pre_revenue_usd",
        (100 * ratio(t, s)).alias("pre_transaction_rate_pct"),
        ratio(r, s).alias("pre_revenue_per_session_usd"),
        ratio(r, t).alias("pre_average_order_value_usd"),
        "average_weekly_revenue_usd",
        "weekly_revenue_stddev_usd",
        F.when(mean > 0, ratio(F.col("weekly_revenue_stddev_usd"), mean)).alias("revenue_cv"),
        "zero_revenue_weeks",
        "session_trend_pct_per_week",
        "transaction_trend_pct_per_week",
        "revenue_trend_pct_per_week",
        "warehouse_revenue_cv",
        F.log1p(s).alias("log_pre_sessions"),
        F.log1p(r).alias("log_pre_revenue"),
    )


def long_measures(df: DataFrame, columns: list[str] | tuple[str, ...], ids: tuple[str, ...] = ()) -> DataFrame:
    """Unpivot measures to (metric, value) rows without NULLs."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return df.select(*ids, F.inline(entries)).where(F.col("value").isNotNull())


def measure_distribution(
    df: DataFrame, columns: list[str] | tuple[str, ...], points: dict[str, float], digits: int = 4
) -> DataFrame:
    """Count, mean, deviation and exact percentiles per measure, one row each."""
    spark = df.sparkSession
    values = long_measures(df, columns)
    wanted = const_relation(
        spark,
        [(c, name, q) for c in columns for name, q in points.items()],
        "metric string, name string, q double",
    )
    marks = (
        quantiles(value_ladder(values), wanted)
        .groupBy("metric")
        .agg(
            *[
                F.round(F.max(F.when(F.col("name") == name, F.col("quantile"))), digits).alias(name)
                for name in points
            ]
        )
    )
    moments = values.groupBy("metric").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg("value"), digits).alias("mean"),
        F.round(F.stddev_samp("value"), digits).alias("std"),
    )
    return moments.join(marks, "metric")


def feature_range_summary(features: DataFrame) -> DataFrame:
    """Smallest, median, mean and largest value of every feature."""
    shown = measure_distribution(features, RANGE_FEATURES, {"min": 0.0, "median": 0.5, "max": 1.0})
    return shown.select("metric", "min", "median", "mean", "max")


def pair_metric_summary(pairs: DataFrame) -> DataFrame:
    """Distribution of every pair measure."""
    points = {"min": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "max": 1.0}
    return measure_distribution(pairs, PAIR_MEASURES, points)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; NULL for a constant series, where corr() fails."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def feature_correlations(features: DataFrame) -> DataFrame:
    """Correlation matrix in long form; every coefficient comes from the same aggregate."""
    cells = [(a, b) for a in CORRELATION_FEATURES for b in CORRELATION_FEATURES]
    one_row = features.agg(
        *[correlation(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(cells)]
    )
    return one_row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("feature_a"),
                        F.lit(b).alias("feature_b"),
                        F.round(F.col(f"c{i}"), 2).alias("correlation"),
                    )
                    for i, (a, b) in enumerate(cells)
                ]
            )
        )
    )


def standardize(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """Add ``z_<column>``: population z-scores; a constant column becomes all zeros."""
    stats = df.agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_sd_{c}") for c in columns],
    )
    scale = lambda c: F.when(near_zero(F.col(f"_sd_{c}")), 1.0).otherwise(F.col(f"_sd_{c}"))
    return attach_row(df, stats).select(
        *df.columns, *[((F.col(c) - F.col(f"_mean_{c}")) / scale(c)).alias(f"z_{c}") for c in columns]
    )


def matching_profiles(features: DataFrame) -> DataFrame:
    """Standardised features plus the scale index, itself standardised again."""
    scaled = standardize(features, MATCHING_FEATURES).withColumn(
        "scale_index", (F.col("z_log_pre_sessions") + F.col("z_log_pre_revenue")) / 2
    )
    return standardize(scaled, ["scale_index"])


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _trajectories(panel: DataFrame) -> DataFrame:
    """Weekly series of a region, prepared so that a pair needs one product and one difference.

    ``unit_*`` is the centred series scaled to length one (dot product = correlation), ``shape_*``
    the series over its mean.  Either is NULL when it is undefined.  A series has one entry per
    PRE week.
    """
    week = F.struct(
        "week_start_date",
        F.col("observed_session_count").cast("double").alias("s"),
        F.col("observed_revenue_usd").cast("double").alias("r"),
    )
    series = panel.groupBy("geo_region").agg(F.array_sort(F.collect_list(week)).alias("_weeks"))
    out = series.select("geo_region", F.col("_weeks.s").alias("session"), F.col("_weeks.r").alias("revenue"))
    for name in ("session", "revenue"):
        out = out.withColumn(f"_mean_{name}", _mean(F.col(name)))
        mean = F.col(f"_mean_{name}")
        out = out.withColumn(
            f"_centred_{name}", F.zip_with(name, F.array_repeat(mean, F.size(name)), lambda x, m: x - m)
        )
        centred = F.col(f"_centred_{name}")
        out = out.withColumn(f"_norm_{name}", F.sqrt(_dot(centred, centred)))
        norm = F.col(f"_norm_{name}")
        flat = near_zero(norm / F.sqrt(F.size(name)))
        out = out.withColumns(
            {
                f"unit_{name}": F.when(
                    ~flat, F.zip_with(centred, F.array_repeat(norm, F.size(name)), lambda x, n: x / n)
                ),
                f"shape_{name}": F.when(
                    ~near_zero(mean),
                    F.zip_with(name, F.array_repeat(mean, F.size(name)), lambda x, m: x / m),
                ),
            }
        )
    return out.select("geo_region", "unit_session", "shape_session", "unit_revenue", "shape_revenue")


def _euclid(columns: list[str]) -> Column:
    gaps = [F.col(f"a.{c}") - F.col(f"b.{c}") for c in columns]
    return F.sqrt(reduce(lambda x, y: x + y, [g * g for g in gaps]))


def pair_metrics(profiles: DataFrame, panel: DataFrame, block_regions: int = 64) -> DataFrame:
    """Similarity of every unordered pair of regions.

    Regions are hashed into blocks of about ``block_regions`` and meet by an equi-join on the pair of
    blocks, so the work is cut into blocks x (blocks + 1) / 2 even parts, as many as the regions ask for.
    A region carries its weekly series as arrays: a pair is one row from the start and nothing is
    regrouped.  Starts a job that counts the regions.
    """
    blocks = 1 + profiles.count() // block_regions
    regions = profiles.join(_trajectories(panel), "geo_region").withColumn(
        "_block", F.pmod(F.xxhash64("geo_region"), F.lit(blocks)).cast("int")
    )
    payload = F.struct(*[c for c in regions.columns if c != "_block"])
    left = regions.select(
        F.col("_block").alias("i"),
        F.explode(F.sequence(F.col("_block"), F.lit(blocks - 1))).alias("j"),
        payload.alias("p"),
    )
    right = regions.select(
        F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("i"),
        F.col("_block").alias("j"),
        payload.alias("q"),
    )
    in_order = F.col("p.geo_region") < F.col("q.geo_region")
    met = (
        left.join(right, ["i", "j"])
        .where(F.when(F.col("i") == F.col("j"), in_order).otherwise(True))
        .select(
            F.when(in_order, F.col("p")).otherwise(F.col("q")).alias("a"),
            F.when(in_order, F.col("q")).otherwise(F.col("p")).alias("b"),
        )
    )
    corr = lambda name: _dot(F.col(f"a.unit_{name}"), F.col(f"b.unit_{name}"))

    def shape_gap(name: str) -> Column:
        gap = F.zip_with(
            F.col(f"a.shape_{name}"), F.col(f"b.shape_{name}"), lambda x, y: (x - y) * (x - y)
        )
        return F.sqrt(_mean(gap))

    def scale(total: str) -> Column:
        a, b = F.col(f"a.{total}"), F.col(f"b.{total}")
        return F.when(~near_zero(F.greatest(a, b)), min_max_ratio(a, b))

    z = [f"z_{c}" for c in MATCHING_FEATURES]
    return met.select(
        F.concat("a.geo_region", F.lit("__"), "b.geo_region").alias("pair_id"),
        F.col("a.geo_region").alias("region_a"),
        F.col("b.geo_region").alias("region_b"),
        _euclid(["z_scale_index"] + z[2:]).alias(PRIMARY_DISTANCE),
        _euclid(z).alias(SENSITIVITY_DISTANCE),
        corr("session").alias("session_correlation"),
        corr("revenue").alias("revenue_correlation"),
        shape_gap("session").alias("session_shape_nrmse"),
        shape_gap("revenue").alias("revenue_shape_nrmse"),
        scale("pre_sessions").alias("session_scale_ratio"),
        scale("pre_transactions").alias("transaction_scale_ratio"),
        scale("pre_revenue_usd").alias("revenue_scale_ratio"),
    )


def top_pairs(pairs: DataFrame, by: str = PRIMARY_DISTANCE, k: int = 20) -> DataFrame:
    """The k pairs with the smallest distance, ties by pair."""
    return pairs.orderBy(F.col(by).asc_nulls_last(), "pair_id").limit(k)


def _keep_ladder(df: DataFrame) -> DataFrame:
    return settle(df, "ladder")


def with_percentile_ranks(
    pairs: DataFrame, ranks: dict[str, str], skew: SkewConfig = SkewConfig(), hold=_keep_ladder
) -> DataFrame:
    """Add average-tie percentile ranks: ``ranks`` maps measure -> output column.

    The pairs are written first: a measure that is looked up is bit by bit the one that was ranked.
    """
    pairs = settle(pairs, "ranked_pairs")
    ladder = hold(value_ladder(long_measures(pairs, list(ranks))))
    out = pairs
    for measure, name in ranks.items():
        own = ladder.where(F.col("metric") == measure).select(
            F.col("value").alias(measure),
            "copies",
            ((F.col("below") + (F.col("copies") + 1) / 2) / F.col("total")).alias(name),
        )
        out = lookup_join(out, own, measure, "copies", F.col("pair_id"), skew).drop("copies")
    return out


def composite_score(pairs: DataFrame, skew: SkewConfig = SkewConfig(), hold=_keep_ladder) -> DataFrame:
    """Rank-based dissimilarity of a pair and its match quality."""
    ranked = with_percentile_ranks(
        pairs,
        {
            PRIMARY_DISTANCE: "feature_distance_percentile",
            "session_shape_nrmse": "session_shape_percentile",
            "revenue_shape_nrmse": "revenue_shape_percentile",
        },
        skew,
        hold,
    )
    blend = (
        COMPOSITE_BLEND["feature"] * F.col("feature_distance_percentile")
        + COMPOSITE_BLEND["session_shape"] * F.col("session_shape_percentile")
        + COMPOSITE_BLEND["revenue_shape"] * F.col("revenue_shape_percentile")
    )
    return ranked.withColumn("composite_dissimilarity", blend).withColumn(
        "match_quality_score", 100 * (1 - F.col("composite_dissimilarity"))
    )


def pair_distance_sensitivity(pairs: DataFrame, k: int = 20, hold=_keep_ladder) -> DataFrame:
    """Rank correlation of the two distances and overlap of their k best pairs, one row."""
    ranked = with_percentile_ranks(pairs, {PRIMARY_DISTANCE: "_p", SENSITIVITY_DISTANCE: "_s"}, hold=hold)
    spearman = ranked.agg(correlation(F.col("_p"), F.col("_s")).alias("distance_rank_correlation"))
    shared = (
        top_pairs(pairs, PRIMARY_DISTANCE, k)
        .select("pair_id")
        .intersect(top_pairs(pairs, SENSITIVITY_DISTANCE, k).select("pair_id"))
    )
    return attach_row(spearman, shared.agg(F.count(F.lit(1)).alias("top_pair_overlap")))


# Threshold -> (pair measure, quantile field of the design, whether it is an upper bound).
GUARDRAILS = {
    "maximum_feature_distance": (PRIMARY_DISTANCE, "feature_quantile", True),
    "minimum_session_correlation": ("session_correlation", "correlation_quantile", False),
    "minimum_revenue_correlation": ("revenue_correlation", "correlation_quantile", False),
    "minimum_session_scale_ratio": ("session_scale_ratio", "scale_quantile", False),
    "minimum_revenue_scale_ratio": ("revenue_scale_ratio", "scale_quantile", False),
}


def threshold_summary(pairs: DataFrame, designs: tuple[DesignSpec, ...] = DESIGNS) -> DataFrame:
    """Guardrail values of every design: exact quantiles of the pair measures."""
    wanted = const_relation(
        pairs.sparkSession,
        [
            (measure, f"{d.name}|{threshold}", float(getattr(d, field)))
            for d in designs
            for threshold, (measure, field, _) in GUARDRAILS.items()
        ],
        "metric string, name string, q double",
    )
    measures = sorted({m for m, _, _ in GUARDRAILS.values()})
    found = quantiles(value_ladder(long_measures(pairs, measures)), wanted)
    design, threshold = (F.split_part("name", F.lit("|"), F.lit(i)) for i in (1, 2))
    return found.groupBy(design.alias("design_name")).agg(
        *[F.max(F.when(threshold == t, F.col("quantile"))).alias(t) for t in GUARDRAILS]
    )


def candidate_edges(
    pairs: DataFrame, thresholds: DataFrame, designs: tuple[DesignSpec, ...] = DESIGNS
) -> DataFrame:
    """Pairs that pass all guardrails of a design, one row per design and pair."""
    limits = thresholds.agg(
        *[
            F.max(F.when(F.col("design_name") == d.name, F.struct(*GUARDRAILS))).alias(f"_{d.name}")
            for d in designs
        ]
    )

    def passes(d: DesignSpec) -> Column:
        checks = [
            F.col(m) <= F.col(f"_{d.name}.{t}") if upper else F.col(m) >= F.col(f"_{d.name}.{t}")
            for t, (m, _, upper) in GUARDRAILS.items()
        ]
        return reduce(lambda x, y: x & y, checks)

    admitted = F.array_compact(F.array(*[F.when(passes(d), F.lit(d.name)) for d in designs]))
    return attach_row(pairs, limits).select(F.explode(admitted).alias("design_name"), *pairs.columns)


def _numbered_pairs(edges: DataFrame, picked: DataFrame, weight: str) -> DataFrame:
    """The edges named by ``picked`` (design_name, pair_id), numbered per design, lightest first."""
    place = F.row_number().over(Window.partitionBy("design_name").orderBy(weight, "pair_id"))
    return (
        edges.join(picked, ["design_name", "pair_id"], "left_semi")
        .withColumn("candidate_pair_number", place)
        .select(
            "design_name",
            "candidate_pair_number",
            *[c for c in edges.columns if c != "design_name"],
            F.lit("CANDIDATE_PAIR_ONLY").alias("assignment_status"),
        )
    )


def greedy_pairs(edges: DataFrame, weight: str = "composite_dissimilarity") -> DataFrame:
    """(design_name, pair_id) of non-overlapping pairs, lightest first.

    Works in rounds.  Every region names its lightest edge; an edge named by both of its ends is
    chosen, and the edges of the chosen regions leave.  The outcome is that of taking edges in
    order of weight one at a time, and each round settles at least the lightest edge left.

    The driver holds only the round counter; the frames of a round are written tables.
    """
    rank = F.struct(F.col(weight).alias("w"), F.col("pair_id").alias("id"))
    left = settle(edges.select("design_name", "pair_id", "region_a", "region_b", weight), "edges-0")
    chosen: list[DataFrame] = []
    while not left.isEmpty():
        named = (
            left.select(
                "design_name", F.explode(F.array("region_a", "region_b")).alias("region"), rank.alias("edge")
            )
            .groupBy("design_name", "region")
            .agg(F.min("edge").alias("edge"))
        )
        mutual = settle(
            named.groupBy("design_name", F.col("edge.id").alias("pair_id"))
            .agg(F.count(F.lit(1)).alias("votes"), F.array_sort(F.collect_set("region")).alias("ends"))
            .where(F.col("votes") == 2)
            .select("design_name", "pair_id", "ends"),
            f"mutual-{len(chosen)}",
        )
        chosen.append(mutual.select("design_name", "pair_id"))
        used = mutual.select("design_name", F.explode("ends").alias("region"))
        for end in ("region_a", "region_b"):
            taken = used.select("design_name", F.col("region").alias(end))
            left = left.join(taken, ["design_name", end], "left_anti")
        left = settle(left, f"edges-{len(chosen)}")
    return reduce(DataFrame.unionByName, chosen) if chosen else edges.select("design_name", "pair_id").limit(0)


# A change of weight below this is rounding.
_LEAST_GAIN = 1e-12


def _moves(edges: DataFrame, taken: DataFrame, through: int) -> DataFrame:
    """Exchanges along alternating walks over at most ``through`` chosen edges that make a matching better.

    ``edges`` and ``taken`` are (design_name, pair_id, region_a, region_b, _w).  Walks go from region to
    region over candidate and chosen edges in turn and visit none twice.  Three kinds are moves: from a
    free region to another (wins a pair); from a free region to the far end of a chosen edge, which
    becomes free; and closed ones.  The latter two are kept when the weight falls.  A row has the
    regions touched, the edges that come and go, the pairs won and the change of the weight.
    """

    def both(df: DataFrame, at: str, to: str, pair: str, w: str) -> DataFrame:
        ends = (("region_a", "region_b"), ("region_b", "region_a"))
        turned = [df.select("design_name", F.col(a).alias(at), F.col(b).alias(to), F.col("pair_id").alias(pair), F.col("_w").alias(w)) for a, b in ends]
        return turned[0].unionByName(turned[1])

    step = both(edges, "_at", "_to", "_new", "_more")
    mates = both(taken, "_to", "_far", "_old", "_less")
    busy = mates.select("design_name", F.col("_to").alias("_region"))
    no_pairs = F.array().cast("array<string>")
    regions = step.select("design_name", F.col("_at").alias("_region")).distinct()
    starts = regions.join(busy, ["design_name", "_region"], "left_anti").select(
        "design_name", F.col("_region").alias("first"), F.col("_region").alias("_at"), F.array("_region").alias("regions"),
        no_pairs.alias("come"), no_pairs.alias("go"), F.lit(0.0).alias("change"), F.lit(True).alias("open"),
    )
    held = mates.select(
        "design_name", F.col("_to").alias("first"), F.col("_far").alias("_at"), F.array("_to", "_far").alias("regions"),
        no_pairs.alias("come"), F.array("_old").alias("go"), (-F.col("_less")).alias("change"), F.lit(False).alias("open"),
    )
    shape = ["design_name", "regions", "come", "go", "change"]
    walk, moves = starts.unionByName(held), []
    inside = lambda c: F.array_contains("regions", F.col(c))
    for crossed in range(through + 1):
        ahead = walk.join(step, ["design_name", "_at"]).join(mates, ["design_name", "_to"], "left").withColumns(
            {"come": F.concat("come", F.array("_new")), "change": F.col("change") + F.col("_more")}
        )
        # Both ends see a path, every region of it a closed walk: one of them counts.
        won = ahead.where(F.col("open") & F.col("_far").isNull() & ~inside("_to") & (F.col("first") < F.col("_to")))
        closed = ahead.where(~F.col("open") & (F.col("_to") == F.col("first")) & (F.size("go") > 1) & (F.col("first") == F.array_min("regions")))
        moves.append(won.withColumn("regions", F.concat("regions", F.array("_to"))).select(*shape, F.lit(1).alias("won")))
        moves.append(closed.select(*shape, F.lit(0).alias("won")))
        onward = ahead.where(F.col("_far").isNotNull() & ~inside("_to") & ~inside("_far"))
        # A closed walk has one chosen edge from the start.
        onward = onward.where(F.size("go") < through) if crossed < through else onward.limit(0)
        walk = onward.select(
            "design_name", "first", F.col("_far").alias("_at"), F.concat("regions", F.array("_to", "_far")).alias("regions"),
            "come", F.concat("go", F.array("_old")).alias("go"), (F.col("change") - F.col("_less")).alias("change"), "open",
        )
        moves.append(walk.where("open").select(*shape, F.lit(0).alias("won")))
    found = reduce(DataFrame.unionByName, moves)
    return found.where((F.col("won") == 1) | (F.col("change") < -_LEAST_GAIN))


def extend_matching(
    edges: DataFrame, matched: DataFrame, weight: str = "composite_dissimilarity", through: int = 4
) -> DataFrame:
    """``matched`` made larger and lighter: (design_name, pair_id) once no move is left.

    In a round every region names the best move it lies on (a won pair first, then the least change of
    weight), and a move named by all of its regions is carried out.  Short moves are used up before
    longer ones are looked for.  Without a move over ``through`` chosen edges at least
    (through + 1) / (through + 2) of the largest possible number of pairs are chosen, and where no design
    has more than ``through`` pairs nothing better exists.  A move over all pairs of a larger design may be
    missed; tests on random graphs measure how often.  Work grows with the regions and with the number
    of edges of a region to the power of ``through``, not with the events; frames of a round are written.
    """
    weighed = settle(edges.select("design_name", "pair_id", "region_a", "region_b", F.col(weight).alias("_w")), "matching_edges")
    chosen = settle(matched.select("design_name", "pair_id"), "matching")
    reach = min(1, through)
    while reach <= through:
        taken = weighed.join(chosen, ["design_name", "pair_id"])
        name = F.concat_ws("|", F.concat_ws(",", F.array_sort("come")), F.concat_ws(",", F.array_sort("go")))
        moves = settle(_moves(weighed, taken, reach).withColumn("id", name), "moves")
        if moves.isEmpty():
            # Whether anything is left at all is asked once, over the longest walks.
            reach = through if reach < through else through + 1
            continue
        rank = F.struct((-F.col("won")).alias("lost"), "change", "id")
        named = moves.select("design_name", F.explode("regions").alias("region"), rank.alias("move")).groupBy("design_name", "region").agg(F.min("move").alias("move"))
        votes = named.groupBy("design_name", F.col("move.id").alias("id")).agg(F.count(F.lit(1)).alias("votes"))
        done = settle(moves.join(votes, ["design_name", "id"]).where(F.col("votes") == F.size("regions")), "moves_done")
        gone = done.select("design_name", F.explode("go").alias("pair_id"))
        come = done.select("design_name", F.explode("come").alias("pair_id"))
        chosen = settle(chosen.join(gone, ["design_name", "pair_id"], "left_anti").unionByName(come), "matching")
        reach = min(1, through)
    return chosen


def match_pairs(edges: DataFrame, weight: str = "composite_dissimilarity") -> DataFrame:
    """Non-overlapping pairs per design: as many as can be, and of these the lightest.

    Begins with ``greedy_pairs`` and goes on with ``extend_matching``.
    """
    return _numbered_pairs(edges, extend_matching(edges, greedy_pairs(edges, weight), weight), weight)


def extended_pairs(edges: DataFrame, matched: DataFrame, weight: str = "composite_dissimilarity") -> DataFrame:
    """Any pairs of non-overlapping regions made larger and lighter, in the form of ``match_pairs``."""
    return _numbered_pairs(edges, extend_matching(edges, matched, weight), weight)


def matching_sizes(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """Chosen pairs per design after the extension; designs without edges have no row."""
    chosen = extend_matching(edges, matched).groupBy("design_name").agg(F.count(F.lit(1)).alias("pair_count"))
    return edges.select("design_name").distinct().join(chosen, "design_name", "left").fillna(0, ["pair_count"])


def design_summary(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """Size and average quality of every design."""
    offered = edges.groupBy("design_name").agg(F.count(F.lit(1)).alias("candidate_edge_count"))
    averages = {
        "mean_feature_distance": PRIMARY_DISTANCE,
        "mean_session_correlation": "session_correlation",
        "mean_revenue_correlation": "revenue_correlation",
        "mean_session_scale_ratio": "session_scale_ratio",
        "mean_revenue_scale_ratio": "revenue_scale_ratio",
    }
    picked = matched.groupBy("design_name").agg(
        F.count(F.lit(1)).alias("selected_pair_count"),
        (2 * F.count(F.lit(1))).alias("represented_region_count"),
        F.avg("match_quality_score").alias("mean_match_quality_score"),
        F.min("match_quality_score").alias("minimum_match_quality_score"),
        *[F.avg(c).alias(name) for name, c in averages.items()],
    )
    return offered.join(picked, "design_name", "left").fillna(
        0, ["selected_pair_count", "represented_region_count"]
    )
