import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from journeyloom.config import AttributionConfig
from journeyloom.operators import attribution as A, comparison as C
from tests.fixtures import SESSION_SCHEMA, TX_SCHEMA, transaction, visit

T0 = dt.datetime(2020, 12, 20, 12)
DAY = dt.timedelta(days=1)


def frames(spark, tx, visits):
    return spark.createDataFrame(tx, TX_SCHEMA), spark.createDataFrame(visits, SESSION_SCHEMA)


def direct(key, user, at):
    return visit(key, user, at, "Direct", "(direct)", "(none)")


@pytest.fixture(scope="module")
def five_touches(spark):
    visits = [visit(f"s{i}", "u", T0 - (5 - i) * DAY) for i in range(1, 5)]
    visits += [direct("s5", "u", T0), visit("early", "u", T0 - 40 * DAY), visit("other", "v", T0)]
    return frames(spark, [transaction("t", "u", T0, "s5")], visits)


def weights(credits, model):
    rows = credits.where(f"attribution_model = '{model}'").collect()
    return {r.touchpoint_session_key: round(r.attribution_weight, 4) for r in rows}


def test_five_touches_last_one_direct(five_touches):
    credits = A.attribution_credits(A.bridge_touchpoints(*five_touches))
    assert weights(credits, "first_touch") == {"s1": 1.0}
    assert weights(credits, "last_touch") == {"s5": 1.0}
    assert weights(credits, "last_non_direct") == {"s4": 1.0}
    assert weights(credits, "linear") == {f"s{i}": 0.2 for i in range(1, 6)}
    assert weights(credits, "position_based") == {"s1": 0.4, "s2": 0.0667, "s3": 0.0667, "s4": 0.0667, "s5": 0.4}


def test_window_ends_are_included_and_direct_only_falls_back(spark):
    second = dt.timedelta(seconds=1)
    visits = [
        direct("edge", "u", T0 - 30 * DAY),
        direct("out", "u", T0 - 30 * DAY - second),
        direct("same", "u", T0),
        direct("after", "u", T0 + second),
        visit("one", "w", T0),
    ]
    tx = [transaction("t", "u", T0, "same"), transaction("t1", "w", T0, "one")]
    bridge = A.bridge_touchpoints(*frames(spark, tx, visits)).collect()
    mine = {r.touchpoint_session_key: r for r in bridge if r.transaction_key == "t"}
    assert set(mine) == {"edge", "same"}
    assert mine["edge"].seconds_before_transaction == 30 * 86400
    assert mine["same"].is_last_non_direct_attribution_touchpoint and not mine["same"].is_last_non_direct_touchpoint
    assert mine["edge"].non_direct_touchpoint_position_asc is None
    credits = A.attribution_credits(A.bridge_touchpoints(*frames(spark, tx, visits)))
    assert weights(credits.where("transaction_key = 't'"), "position_based") == {"edge": 0.5, "same": 0.5}
    assert weights(credits.where("transaction_key = 't1'"), "position_based") == {"one": 1.0}


def test_left_censoring(spark):
    visits = [visit("first", "z", T0 - 30 * DAY), visit("s", "u", T0), visit("s2", "u", T0 - DAY)]
    tx = [transaction("t", "u", T0, "s"), transaction("t2", "u", T0 - DAY, "s2")]
    got = {r.transaction_key: r.is_lookback_left_censored for r in A.bridge_touchpoints(*frames(spark, tx, visits)).collect()}
    assert got == {"t": False, "t2": True}


def brute_bridge(tx, visits, days):
    """(transaction, session) -> position, by nested loops."""
    out = {}
    for t in tx:
        journey = sorted(
            (v[5], v[0]) for v in visits if v[1] == t[5] and t[4] - dt.timedelta(days=days) <= v[5] <= t[4]
        )
        for place, (_, key) in enumerate(journey, start=1):
            out[t[0], key] = (place, len(journey))
    return out


@pytest.mark.parametrize("cell_days,lane_rows", [(None, 20_000), (1, 5), (3, 2), (None, 1)])
def test_bridge_equals_nested_loops_with_a_hot_user(spark, cell_days, lane_rows):
    """One user holds most rows; cells and lanes must neither lose nor repeat a pair."""
    rng = random.Random(7)
    user = lambda: "hot" if rng.random() < 0.7 else f"u{rng.randrange(5)}"
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(20 * 86400))
    visits = [visit(f"s{i}", user(), at()) for i in range(150)]
    tx = [transaction(f"t{i}", user(), at(), None) for i in range(40)]
    config = AttributionConfig(lookback_days=6, cell_days=cell_days, lane_rows=lane_rows)
    got = A.bridge_touchpoints(*frames(spark, tx, visits), config).collect()
    assert {
        (r.transaction_key, r.touchpoint_session_key): (r.touchpoint_position_asc, r.touchpoint_count) for r in got
    } == brute_bridge(tx, visits, 6)
    assert len(got) == len(brute_bridge(tx, visits, 6))
    assert all(r.touchpoint_position_desc == r.touchpoint_count + 1 - r.touchpoint_position_asc for r in got)


def test_every_crowded_cell_is_cut_and_no_part_is_above_the_limit(spark):
    """More crowded cells than any list of hot keys would hold, one with a third of all rows."""
    config = AttributionConfig(lookback_days=2, lane_rows=100)
    micros = T0.timestamp()
    rows = spark.range(30_000).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('u', id % 100) end AS user")
    at = F.timestamp_seconds(F.lit(micros) + F.pmod(F.xxhash64("id"), F.lit(86400)))
    names = [c for c in dict.fromkeys(A.FROM_SESSION.values()) if c not in ("session_key", "session_start_timestamp_utc")]
    sessions = rows.select(F.concat(F.lit("s"), "id").alias("session_key"), F.col("user").alias("user_pseudo_id"), at.alias("session_start_timestamp_utc"), *[F.lit(None).cast("string").alias(c) for c in names])
    more = [c for c in A.FROM_TRANSACTION.values() if c not in ("transaction_key", "user_pseudo_id", "transaction_timestamp_utc")]
    tx = rows.where("id % 10 = 0").select(F.concat(F.lit("t"), "id").alias("transaction_key"), F.col("user").alias("user_pseudo_id"), at.alias("transaction_timestamp_utc"), *[F.lit(None).cast("string").alias(c) for c in more])
    left, right = A._sides(tx, sessions, config)
    crowded = A.crowded_cells(left, right, config)
    assert crowded.count() > 60 and crowded.agg(F.max("_lanes")).first()[0] > 50
    left, right = A.cut_into_lanes(left, right, config)
    for side, keys, kept in ((right, ["_user", "_cell", "_lane", "_slot"], "_slot = 0"), (left, ["user_pseudo_id", "_at_cell", "_at_lane", "_at_slot"], "_at_lane = 0")):
        assert side.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 100
        # Every row is in one part, and stands in each part of the other side.
        assert side.where(kept).count() == (sessions.count() if side is right else left.select("transaction_key", "_at_cell").distinct().count())
    plan = right._jdf.queryExecution().optimizedPlan().toString()
    assert "hint" not in plan.lower()  # how the join to the crowded cells runs is up to their size


def test_the_lookback_join_runs_once(spark, five_touches):
    tx, sessions = five_touches
    touchpoints = A.eligible_touchpoints(tx, sessions)
    plan = touchpoints._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("touchpoint_start_timestamp_utc") and plan.count("Join Inner, ") == 1
    bridge = A.bridge_touchpoints(tx, sessions)
    plan = bridge._jdf.queryExecution().optimizedPlan().toString()
    # Hour totals and rows come from the written touchpoints; one join puts them together.
    assert plan.count("Join ") == 1 and plan.count("Relation [") == 2


def test_conservation_laws(spark):
    rng = random.Random(3)
    channels = [("Email", "n", "email"), ("Direct", "(direct)", "(none)"), ("Referral", "p", "referral")]
    visits = [visit(f"s{i}", f"u{i % 9}", T0 + dt.timedelta(hours=rng.randrange(600)), *rng.choice(channels)) for i in range(120)]
    tx = [transaction(f"t{i}", v[1], v[5], v[0], float(rng.randrange(1, 90))) for i, v in enumerate(visits[::3])]
    credits = A.attribution_credits(A.bridge_touchpoints(*frames(spark, tx, visits)))
    sums = credits.groupBy("attribution_model", "transaction_key").sum("attribution_weight").collect()
    assert len(sums) == 5 * len(tx) and all(abs(r[2] - 1) < 1e-9 for r in sums)
    grid = C.channel_comparison(credits).collect()
    total = sum(t[9] for t in tx)
    assert len(grid) == 2 * 5 * 3
    for model in A.MODELS:
        rows = [r for r in grid if r.attribution_model == model and r.analysis_population == "all_observed"]
        assert abs(sum(r.attributed_revenue_usd for r in rows) - total) < 1e-6
        assert abs(sum(r.model_revenue_share for r in rows) - 1) < 1e-9
        assert abs(sum(r.revenue_delta_vs_last_touch_usd for r in rows)) < 1e-6
        assert sorted(r.channel_revenue_rank_within_model for r in rows) == [1, 2, 3]
    shift = C.channel_shift(C.channel_comparison(credits)).collect()
    assert len(shift) == 4 * 3 and {r.attribution_model for r in shift} == set(A.MODELS) - {"last_touch"}


def test_a_channel_without_credit_stays_in_the_grid(spark):
    visits = [visit("s1", "u", T0 - DAY), direct("s2", "u", T0)]
    grid = C.channel_comparison(A.attribution_credits(A.bridge_touchpoints(*frames(spark, [transaction("t", "u", T0, "s2")], visits))))
    row = grid.where("attribution_model = 'first_touch' and touchpoint_channel_group = 'Direct' and analysis_population = 'all_observed'").first()
    assert (row.credited_touchpoint_rows, row.attributed_revenue_usd, row.attributed_average_order_value_usd) == (0, 0.0, None)
    assert row.revenue_delta_vs_last_touch_usd == -100.0


def test_a_crowded_cell_stands_once_per_salt_of_its_rows_and_many_are_not_broadcast(spark, monkeypatch):
    """Small cells by the thousand: their lookup must not outgrow their rows nor go through the driver."""
    visits = [visit(f"s{u}-{i}", f"u{u}", T0 - i * DAY) for u in range(40) for i in range(3)]
    tx = [transaction(f"t{u}", f"u{u}", T0, f"s{u}-0") for u in range(40)]
    config = AttributionConfig(lookback_days=6, lane_rows=1)
    left, right = A._sides(*frames(spark, tx, visits), config)
    assert 0 < A.crowded_cells(left, right, config).count() <= left.count() + right.count()
    monkeypatch.setattr(A, "BROADCAST_ROWS", 10, raising=False)
    _, cut = A.cut_into_lanes(left, right, config)
    assert "BroadcastHashJoin" not in cut._jdf.queryExecution().sparkPlan().toString()
    got = A.bridge_touchpoints(*frames(spark, tx, visits), config).collect()
    assert {
        (r.transaction_key, r.touchpoint_session_key): (r.touchpoint_position_asc, r.touchpoint_count) for r in got
    } == brute_bridge(tx, visits, 6)
    assert len(got) == len(brute_bridge(tx, visits, 6))
