import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest

from journeyloom.config import DESIGNS, EligibilityThresholds, ExperimentWindow, GeoConfig
from journeyloom.operators import geo_design as G, panel as P

WINDOW = ExperimentWindow(dt.date(2020, 11, 1), dt.date(2020, 11, 28), dt.date(2020, 11, 29), dt.date(2020, 12, 12))
SCHEMA = """
session_key string, user_pseudo_id string, session_date date, geo_country string, geo_region string,
is_engaged_session boolean, is_new_user_session boolean, view_item_event_count bigint,
add_to_cart_event_count bigint, begin_checkout_event_count bigint, canonical_transaction_count bigint,
canonical_revenue_usd double, canonical_item_quantity bigint
"""


def visit(i, day, region, tx=0, revenue=0.0, country="US", user=None):
    return (f"s{i}", user or f"u{i}", day, country, region, None, True, 1, 1, None, tx, revenue, None)


def sessions(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def config(**limits):
    return GeoConfig(WINDOW, EligibilityThresholds(**{"min_active_weeks": 4, "min_sessions": 0, "min_transactions": 0, "min_revenue_usd": 0.0, **limits}), "US")


def test_weeks_start_on_sunday_and_empty_weeks_are_zero(spark):
    rows = [
        visit(1, dt.date(2020, 11, 7), "Ohio", 1, 5.0),
        visit(2, dt.date(2020, 11, 8), "Ohio", user="u1"),
        visit(3, dt.date(2020, 12, 6), " Utah\t"),
        visit(4, dt.date(2020, 11, 2), "(Not Set)"),
        visit(5, dt.date(2020, 11, 2), " "),
        visit(6, dt.date(2020, 10, 31), "Ohio"),
        visit(7, dt.date(2020, 11, 2), "Bern", country="CH"),
    ]
    got = P.geo_weekly_outcomes(sessions(spark, rows), config()).orderBy("geo_region", "week_start_date").collect()
    assert len(got) == 2 * 6 and {r.geo_region for r in got} == {"Ohio", "Utah"}
    ohio = [r for r in got if r.geo_region == "Ohio"]
    assert [r.observed_session_count for r in ohio] == [1, 1, 0, 0, 0, 0]
    assert [r.period_name for r in ohio] == ["PRE"] * 4 + ["TEST"] * 2
    assert [r.period_week_number for r in ohio] == [1, 2, 3, 4, 1, 2]
    assert ohio[0].observed_average_order_value_usd == 5.0 and ohio[2].observed_transaction_rate is None
    assert ohio[0].week_end_date == dt.date(2020, 11, 7) and ohio[0].pre_revenue_usd == 5.0


def test_eligibility_reports_the_first_reason(spark):
    weeks = [dt.date(2020, 11, 1) + dt.timedelta(7 * i) for i in range(4)]
    n = itertools.count()
    rows = [visit(next(n), w, "few_weeks", 1, 9.0) for w in weeks[:3]]
    rows += [visit(next(n), w, "few_sessions", 1, 9.0) for w in weeks]
    rows += [visit(next(n), w, "few_orders") for w in weeks * 2]
    rows += [visit(next(n), w, "little_revenue", 1, 0.1) for w in weeks * 2]
    rows += [visit(next(n), w, "zero_mean", 1, 0.0) for w in weeks * 2]
    rows += [visit(next(n), w, "unstable", 1, 90.0 if i == 0 else 0.0) for i, w in enumerate(weeks * 2)]
    rows += [visit(next(n), w, "good", 1, 9.0) for w in weeks * 2]
    screen = lambda **limits: {
        r.geo_region: r.eligibility_status
        for r in P.geo_profile(P.normalize_geo_sessions(sessions(spark, rows), WINDOW), config(min_sessions=6, min_transactions=4, **limits)).collect()
    }
    got = screen(min_revenue_usd=5.0, max_revenue_cv=1.5)
    assert got["few_weeks"] == "INSUFFICIENT_ACTIVE_WEEKS" and got["few_sessions"] == "INSUFFICIENT_PRE_SESSIONS"
    assert got["few_orders"] == "INSUFFICIENT_PRE_TRANSACTIONS" and got["little_revenue"] == "INSUFFICIENT_PRE_REVENUE"
    assert got["unstable"] == "UNSTABLE_PRE_REVENUE" and got["good"] == "ELIGIBLE"
    assert screen()["zero_mean"] == "UNDEFINED_PRE_REVENUE_VARIATION"


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(5)
    series = {f"r{i}": [(rng.randrange(5, 60), float(rng.randrange(1, 900))) for _ in range(8)] for i in range(6)}
    series["twin"] = series["r0"]
    series["flat"] = [(10, 50.0)] * 8
    series["idle"] = [(7 + i, 0.0) for i in range(8)]
    rows = [
        (region, dt.date(2020, 11, 1) + dt.timedelta(7 * i), i + 1, s, s // 3, r, 0.1)
        for region, weeks in series.items()
        for i, (s, r) in enumerate(weeks)
    ]
    schema = "geo_region string, week_start_date date, period_week_number int, observed_session_count bigint, observed_transaction_count bigint, observed_revenue_usd double, pre_revenue_coefficient_of_variation double"
    return series, spark.createDataFrame(rows, schema)


def test_features_against_numpy(panel):
    series, df = panel
    for r in G.region_features(df).collect():
        s, rev = (np.array(x, dtype=float) for x in zip(*series[r.geo_region]))
        trend = lambda y: 100 * np.polyfit(np.arange(8), y, 1)[0] / y.mean()
        assert r.session_trend_pct_per_week == pytest.approx(trend(s), abs=1e-9)
        if rev.mean() > 0:
            assert r.revenue_trend_pct_per_week == pytest.approx(trend(rev), abs=1e-9)
            assert r.revenue_cv == pytest.approx(rev.std(ddof=1) / rev.mean())
        else:
            assert r.revenue_trend_pct_per_week is None and r.revenue_cv is None
        assert r.log_pre_sessions == pytest.approx(np.log1p(s.sum()))


@pytest.fixture(scope="module")
def pairs(panel):
    _, df = panel
    usable = df.where("geo_region <> 'idle'")
    features = G.region_features(usable)
    return G.matching_profiles(features), G.pair_metrics(G.matching_profiles(features), usable, block_regions=3).cache()


@pytest.mark.parametrize("blocks", [1, 4])
def test_pairs_against_brute_force(panel, blocks):
    series, df = panel
    profiles = G.matching_profiles(G.region_features(df).fillna(0.0))
    z = {r.geo_region: r for r in profiles.collect()}
    for c in G.MATCHING_FEATURES + ["scale_index"]:
        values = np.array([r[f"z_{c}"] for r in z.values()])
        assert abs(values.mean()) < 1e-10 and abs(values.std() - 1) < 1e-10
    got = {(r.region_a, r.region_b): r for r in G.pair_metrics(profiles, df, blocks).collect()}
    assert set(got) == set(itertools.combinations(sorted(series), 2))
    for (a, b), r in got.items():
        (sa, ra), (sb, rb) = ([np.array(x, dtype=float) for x in zip(*series[k])] for k in (a, b))
        for x, y, corr, gap in ((sa, sb, r.session_correlation, r.session_shape_nrmse), (ra, rb, r.revenue_correlation, r.revenue_shape_nrmse)):
            if np.isclose(x.std(), 0) or np.isclose(y.std(), 0):
                assert corr is None
            else:
                assert corr == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
            if np.isclose(x.mean(), 0) or np.isclose(y.mean(), 0):
                assert gap is None
            else:
                assert gap == pytest.approx(np.sqrt(np.mean((x / x.mean() - y / y.mean()) ** 2)), abs=1e-9)
        six = [f"z_{c}" for c in G.MATCHING_FEATURES]
        gap = lambda cs: np.sqrt(sum((z[a][c] - z[b][c]) ** 2 for c in cs))
        assert r.six_feature_distance_sensitivity == pytest.approx(gap(six))
        assert r.category_balanced_feature_distance == pytest.approx(gap(["z_scale_index"] + six[2:]))
        assert r.session_scale_ratio == pytest.approx(min(sa.sum(), sb.sum()) / max(sa.sum(), sb.sum()))
    assert got["r0", "twin"].category_balanced_feature_distance == pytest.approx(0, abs=1e-9)
    assert got["flat", "idle"].revenue_scale_ratio == 0.0


def test_scores_thresholds_and_designs_against_pandas(pairs):
    _, df = pairs
    pdf = df.toPandas()
    scored = G.composite_score(df)
    got = scored.toPandas().set_index("pair_id").loc[pdf.pair_id]
    rank = lambda c: pdf[c].rank(method="average", pct=True).to_numpy()
    assert np.allclose(got.feature_distance_percentile, rank(G.PRIMARY_DISTANCE))
    blend = 0.5 * rank(G.PRIMARY_DISTANCE) + 0.25 * rank("session_shape_nrmse") + 0.25 * rank("revenue_shape_nrmse")
    assert np.allclose(got.composite_dissimilarity, blend)
    limits = G.threshold_summary(df)
    for r in limits.collect():
        spec = next(d for d in DESIGNS if d.name == r.design_name)
        for t, (c, field, _) in G.GUARDRAILS.items():
            assert r[t] == pytest.approx(pdf[c].dropna().quantile(getattr(spec, field)))
    edges = G.candidate_edges(scored, limits)
    matched = G.greedy_pairs(edges).toPandas()
    for name, rows in edges.toPandas().groupby("design_name"):
        used, want = set(), []
        for e in rows.sort_values(["composite_dissimilarity", "pair_id"]).itertuples():
            if not {e.region_a, e.region_b} & used:
                used |= {e.region_a, e.region_b}
                want.append(e.pair_id)
        assert set(matched[matched.design_name == name].pair_id) == set(want)


EDGES = "design_name string, pair_id string, region_a string, region_b string, composite_dissimilarity double"


def _best(edges):
    """(pairs, weight) of the largest and of these lightest matching, over all matchings."""
    if not edges:
        return 0, 0.0
    (a, b, w), rest = edges[0], edges[1:]
    n, v = _best([e for e in rest if not {a, b} & {*e[:2]}])
    return min(_best(rest), (n - 1, v + w))


def test_matching_without_reuse_and_numbered(spark):
    rng = random.Random(11)
    rows = [("D", f"{a}__{b}", a, b, rng.randrange(4) / 4) for a, b in itertools.combinations("abcdefghij", 2) if rng.random() < 0.5]
    edges = spark.createDataFrame(rows, EDGES)
    got = G.match_pairs(edges).collect()
    ends = [x for r in got for x in (r.region_a, r.region_b)]
    assert len(ends) == len(set(ends)) == 10
    assert [r.candidate_pair_number for r in sorted(got, key=lambda r: r.candidate_pair_number)] == list(range(1, len(got) + 1))
    assert G.match_pairs(edges.limit(0)).count() == 0


def test_matching_is_the_largest_and_lightest_on_random_graphs(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for g in range(14):
        share = rng.choice((0.2, 0.3, 0.4))
        edges = [(a, b, rng.random() if g % 2 else rng.randrange(8) / 8) for a, b in itertools.combinations("abcdefghij", 2) if rng.random() < share]
        rows += [(f"D{g}", f"{a}__{b}", a, b, w) for a, b, w in edges]
        if edges:
            want[f"D{g}"] = _best(edges)
    pairs = G.match_pairs(spark.createDataFrame(rows, EDGES)).collect()
    for name, (n, weight) in want.items():
        mine = [r for r in pairs if r.design_name == name]
        ends = [x for r in mine for x in (r.region_a, r.region_b)]
        assert len(ends) == len(set(ends)) and len(mine) == -n
        assert sum(r.composite_dissimilarity for r in mine) == pytest.approx(weight)


def test_paths_and_closed_walks_are_exchanged(spark):
    # Lightest first takes the middle of a path of three edges, where two pairs exist; twice in a path of five.
    rows = [("D", "b__c", "b", "c", 0.1), ("D", "a__b", "a", "b", 0.5), ("D", "c__d", "c", "d", 0.5)]
    rows += [("E", f"{a}__{b}", a, b, w) for (a, b), w in zip(("pq", "qr", "rs", "st", "tu"), (0.5, 0.1, 0.6, 0.1, 0.5))]
    # A square whose lightest edge faces a heavy one, and a free region that would do for a lighter pair.
    rows += [("F", f"{a}__{b}", a, b, w) for (a, b), w in zip(("ab", "bc", "cd", "ad"), (0.1, 0.2, 0.9, 0.2))]
    frame = spark.createDataFrame(rows, EDGES)
    matched = G.match_pairs(frame)
    found = [(r.design_name, r.candidate_pair_number, r.pair_id) for r in matched.orderBy("design_name", "candidate_pair_number").collect()]
    assert found == [("D", 1, "a__b"), ("D", 2, "c__d"), ("E", 1, "p__q"), ("E", 2, "t__u"), ("E", 3, "r__s"), ("F", 1, "a__d"), ("F", 2, "b__c")]
    worse = spark.createDataFrame([("F", "a__b"), ("F", "c__d")], "design_name string, pair_id string")
    got = G.extended_pairs(frame.where("design_name = 'F'"), worse)
    assert got.columns == matched.columns and {r.pair_id for r in got.collect()} == {"a__d", "b__c"}


def test_extended_designs_are_registered():
    from workloads.queries import QUERIES

    assert {"extended_pairs", "extended_design_summary"} <= set(QUERIES)


def test_distance_sensitivity_and_distribution(pairs):
    _, df = pairs
    pdf = df.toPandas()
    r = G.pair_distance_sensitivity(df, k=5).first()
    assert r.distance_rank_correlation == pytest.approx(
        pdf[[G.PRIMARY_DISTANCE, G.SENSITIVITY_DISTANCE]].corr(method="spearman").iloc[0, 1]
    )
    top = lambda c: set(pdf.nsmallest(5, c).pair_id)
    assert r.top_pair_overlap == len(top(G.PRIMARY_DISTANCE) & top(G.SENSITIVITY_DISTANCE))
    summary = {x.metric: x for x in G.pair_metric_summary(df).collect()}
    for c in G.PAIR_MEASURES:
        values = pdf[c].dropna()
        assert summary[c]["p25"] == pytest.approx(values.quantile(0.25), abs=6e-5)
        assert summary[c]["std"] == pytest.approx(values.std(), abs=6e-5)


def test_correlation_matrix_is_null_for_a_constant_feature(spark):
    pdf = pd.DataFrame({c: np.arange(5.0) ** (i % 3) for i, c in enumerate(G.CORRELATION_FEATURES)})
    got = {(r.feature_a, r.feature_b): r.correlation for r in G.feature_correlations(spark.createDataFrame(pdf)).collect()}
    want = pdf.corr()
    for (a, b), v in got.items():
        assert (v is None) if np.isnan(want.loc[a, b]) else v == pytest.approx(round(want.loc[a, b], 2), abs=0.011)
