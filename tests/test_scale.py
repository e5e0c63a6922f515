"""Plans and sizes that decide whether a step still runs on large tables."""

import datetime as dt

from journeyloom.operators.comparison import channel_comparison
from journeyloom.operators.staging import stage_events
from journeyloom.sources.tables import read_events, write_events
from tests.fixtures import event, events
from workloads import adapter


def test_lines_of_an_event_are_gathered_behind_the_exchange_only(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    events = [(i, at) for i in range(5)]
    lines = [(k, n, 13 * k, None if k == 3 else 7, 10.5 * n, 2.0, "N", "O") for k in range(12) for n in (2, 1, 7)]
    spark.createDataFrame(events, "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(
        lines,
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, "
        "l_returnflag string, l_linestatus string",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    gathered = adapter.line_items(spark, str(tmp_path))
    got = {r["event_id"]: [(i["price"], i["price_in_usd"], i["item_brand"]) for i in r["items"]] for r in gathered.collect()}
    for event in range(5):
        want = sorted((k, n, price) for k, n, _, _, price, *_ in lines if k % 5 == event)
        assert got[event] == [
            (price, None if n == 7 else float(int(price)), None if k == 3 else "B7") for k, n, price in want
        ]
    plan = gathered._jdf.queryExecution().sparkPlan().toString()
    before, exchange, behind = plan.partition("REPARTITION_BY_COL")
    assert exchange and "collect_list" in before and "collect_list" not in behind


def test_days_are_written_by_few_tasks(spark, tmp_path):
    rows = [event(i, day=1 + i % 2, user=f"u{i}") for i in range(40)]
    dealt = events(spark, rows).repartition(8)
    for _ in range(2):  # the second time in place of the first
        write_events(dealt, f"{tmp_path}/days")
    for day in ("20201101", "20201102"):
        assert len(list((tmp_path / "days" / f"event_date={day}").glob("*.parquet"))) == 1
    back = read_events(spark, f"{tmp_path}/days", "20201101", "20201102")
    by_name = lambda df: sorted(map(str, df.select(*dealt.columns).collect()))
    assert by_name(back) == by_name(dealt)


def test_items_are_counted_by_one_leaf(spark, tmp_path):
    item = ("P1", None, None, None, None, 1.0, 1.0, None, 1.0, 1.0)
    rows = [event(1), event(2, items=[]), event(3, items=[item, None, item]), event(4, items=[item])]
    events(spark, rows).write.parquet(f"{tmp_path}/events")
    counted = stage_events(spark.read.parquet(f"{tmp_path}/events")).select("event_bundle_sequence_id", "item_record_count")
    assert {r[0]: r[1] for r in counted.collect()} == {1: 0, 2: 0, 3: 3, 4: 1}
    read = counted._jdf.queryExecution().executedPlan().toString()
    assert "items:array<struct<quantity:bigint>>" in read


def test_credits_are_built_once_for_the_comparison(spark, tmp_path):
    rows = [(True, 1, "last_touch", "Email", "A", 1.0, 8.0), (False, 1, "last_touch", "Other", "B", 1.0, 2.0)]
    names = "is_complete_lookback_window boolean, attribution_model_order int, attribution_model string, "
    names += "touchpoint_channel_group string, transaction_key string, attributed_conversion_credit double, attributed_revenue_usd double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/credits")
    mart = channel_comparison(spark.read.parquet(f"{tmp_path}/credits"))
    got = {(r["analysis_population"], r["touchpoint_channel_group"]): r["attributed_revenue_usd"] for r in mart.collect()}
    assert got == {
        ("all_observed", "Email"): 8.0,
        ("all_observed", "Other"): 2.0,
        ("complete_window", "Email"): 8.0,
        ("complete_window", "Other"): 0.0,
    }
    assert not [f for f in mart.inputFiles() if "/credits/" in f]
