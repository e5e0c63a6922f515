import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from journeyloom.config import SkewConfig
from journeyloom.operators.skew import lookup_join, numbered, quantiles, value_ladder


@pytest.mark.parametrize("skew", [SkewConfig(), SkewConfig(min_hot_rows=2), SkewConfig(1)])
def test_lookup_join_is_exact_for_hot_cold_and_null_keys(spark, skew):
    keys = ["hot"] * 40 + ["a", "b", "b", None, None, "unknown"]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string")
    lookup = spark.createDataFrame([("hot", 40, 1.0), ("a", 1, None), ("b", 2, 3.0), ("idle", 9, 9.0)], "k string, n int, v double")
    got = sorted(lookup_join(rows, lookup, "k", "n", F.col("id"), skew).collect())
    want = {"hot": (40, 1.0), "a": (1, None), "b": (2, 3.0)}
    assert [(r.k, r.n, r.v) for r in got] == [(k, *want.get(k, (None, None))) for k in keys]


def test_value_ladder_and_quantiles_against_brute_force(spark):
    rng = random.Random(1)
    data = {"m": [rng.choice([0.0, 0.0, 1.5, rng.gauss(0, 1) ** 3]) for _ in range(301)], "c": [2.0] * 5}
    df = spark.createDataFrame([(m, v) for m, vs in data.items() for v in vs], "metric string, value double")
    ladder = value_ladder(df)
    for r in ladder.collect():
        counted = Counter(data[r.metric])
        assert r.copies == counted[r.value] and r.total == len(data[r.metric])
        assert r.below == sum(n for v, n in counted.items() if v < r.value)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    wanted = spark.createDataFrame([(m, str(q), q) for m in data for q in qs], "metric string, name string, q double")
    for r in quantiles(ladder, wanted).collect():
        ordered = sorted(data[r.metric])
        spot = r.q * (len(ordered) - 1)
        low = int(spot)
        high = min(low + 1, len(ordered) - 1)
        assert r.quantile == pytest.approx(ordered[low] + (ordered[high] - ordered[low]) * (spot - low))


def test_numbered_is_a_global_row_number(spark):
    rng = random.Random(2)
    rows = [(i, rng.random() < 0.4, float(rng.randrange(20))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, ok boolean, amount double")
    order = [F.desc("ok"), F.desc("amount"), F.col("id")]
    got = numbered(df.repartition(7), order, "place").collect()
    ranked = sorted(rows, key=lambda r: (not r[1], -r[2], r[0]))
    assert {r.id: r.place for r in got} == {r[0]: i for i, r in enumerate(ranked, start=1)}


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fractions_over_many_ranges_equal_a_global_sort(spark, many_ranges):
    """Doubles that differ in their last bits, computed in the plan from sums of fractions."""
    df = spark.range(0, 5_000, 1, 11).selectExpr("id", "id % 97 AS g", "(hash(id) % 1000) / 7.0D + 0.1D * (id % 13) AS part")
    sums = df.groupBy("g").agg(F.sum("part").alias("amount")).repartition(5)
    got = numbered(sums, [F.desc("amount"), F.col("g")], "place").collect()
    ranked = sorted(got, key=lambda r: (-r.amount, r.g))
    assert [r.place for r in ranked] == list(range(1, 98))
    values = df.selectExpr("'m' AS metric", "part AS value").unionByName(df.selectExpr("'n' AS metric", "-part AS value"))
    ladder = value_ladder(values).where("metric = 'm'").orderBy("value").collect()
    counted = Counter(r.part for r in df.collect())
    below = 0
    assert [r.value for r in ladder] == sorted(counted)
    for r in ladder:
        assert (r.below, r.copies, r.total) == (below, counted[r.value], 5_000)
        below += r.copies


def test_more_hot_keys_than_any_list_would_hold(spark):
    """Every key is hot: none of them meets its rows in one place."""
    rows = spark.range(9_000).selectExpr("id", "cast(case when id % 3 = 0 then 0 else id % 3001 end AS string) AS k")
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    joined = lookup_join(rows, lookup, "k", "n", F.col("id"), SkewConfig(2))
    assert joined.count() == 9_000 and joined.where("top is null or top < id").count() == 0


def test_pair_blocks_grow_with_the_regions(spark):
    from journeyloom.operators import geo_design

    weeks = spark.range(300 * 4).selectExpr(
        "concat('r', id div 4) AS geo_region", "date_add(DATE'2020-01-05', cast(7 * (id % 4) AS int)) AS week_start_date",
        "10 + hash(id) % 7 AS observed_session_count", "5.5D + hash(id) % 5 AS observed_revenue_usd",
    )
    features = weeks.groupBy("geo_region").agg(F.sum("observed_session_count").alias("pre_sessions"), F.sum("observed_revenue_usd").alias("pre_revenue_usd"), F.lit(3).alias("pre_transactions"))
    profiles = features.select("*", *[F.rand(k).alias(f"z_{c}") for k, c in enumerate(geo_design.MATCHING_FEATURES)], F.lit(0.5).alias("z_scale_index"))
    pairs = geo_design.pair_metrics(profiles, weeks)
    assert "LocalLimit" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() == 300 * 299 // 2 == pairs.select("pair_id").distinct().count()
