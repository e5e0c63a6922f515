import datetime as dt
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from journeyloom.config import AttributionConfig
from journeyloom.operators import entities, reconcile
from journeyloom.operators.attribution import attribution_credits, bridge_touchpoints, day_slices
from journeyloom.operators.contracts import (
    Contract,
    ContractViolation,
    bridge_contracts,
    check,
    comparison_contracts,
    credit_contracts,
    session_contracts,
    transaction_contracts,
)
from journeyloom.operators.onepass import distinct, one_pass
from journeyloom.operators.profiling import leading_values
from journeyloom.operators.sessions import channel_group
from journeyloom.operators.staging import stage_events, stage_items
from journeyloom.plans.warehouse import LAYOUT, AttributionChain, publish_attribution
from journeyloom.sources.publish import NotPublished, current_version, layout_report, publish, read_published
from journeyloom.sources.tables import read_events, read_mart
from journeyloom.sources.workspace import application_folder, list_folder, scratch_folder, settle
from tests.fixtures import event, events, session, text


@pytest.fixture(scope="module")
def chain(spark):
    p = lambda n, medium=None: [session(n), ("currency", text("USD"))] + ([("medium", text(medium))] if medium else [])
    rows = [
        event(1, second=1, params=p(1, "email")),
        event(2, "purchase", second=2, params=p(1), tx="A", revenue=10.0),
        event(3, "purchase", second=3, params=p(1), tx="A", revenue=10.0),
        event(4, day=3, params=p(2)),
        event(5, "purchase", day=3, second=9, params=p(2), tx=None, revenue=4.0),
        event(6, user="u2", day=4, params=p(3, "cpc")),
        event(7, "purchase", user="u2", day=4, second=9, params=p(3), tx="B", revenue=6.0),
    ]
    return AttributionChain(settle(events(spark, rows), "tiny"), AttributionConfig())


def test_contracts_count_violations(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -2.0), ("b", None)], "k string, v double")
    got = {
        r.contract: (r.violations, r.passed)
        for r in check(
            df,
            [
                Contract.unique("unique", "k"),
                Contract.not_null("not null", "v"),
                Contract.nonnegative("nonnegative", "v"),
                Contract.equals("sum", F.sum("v"), -1.0, 1e-9),
                Contract.per_group("pairs", ("k",), F.count(F.lit(1)) != 2),
                Contract.reconcile("rows", F.count(F.lit(1)), df, F.count("v")),
                Contract.reconcile("sums", F.sum("v"), df, F.sum("v"), 1e-9),
            ],
        ).collect()
    }
    assert got == {
        "unique": (1, False),
        "not null": (1, False),
        "nonnegative": (1, False),
        "sum": (0, True),
        "pairs": (1, False),
        "rows": (1, False),
        "sums": (0, True),
    }


def test_a_set_of_contracts_reads_each_frame_once(spark, tmp_path):
    spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "id int, k string, v double").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([("a", 5.0)], "k string, v double").write.parquet(str(tmp_path / "s"))
    df, source = (spark.read.parquet(str(tmp_path / x)) for x in "ts")
    report = check(
        df,
        [
            Contract.unique("unique", "id"),
            Contract.unique("pair", "id", "k"),
            Contract.not_null("set", "v"),
            Contract.equals("sum", F.sum("v"), 5.0),
            Contract.key_count("keys", 2, "k"),
            Contract.reconcile("revenue", F.sum("v"), source, F.sum("v")),
            Contract.reconcile("rows", F.count(F.lit(1)), source, F.count(F.lit(1))),
            Contract.reconcile_keys("all keys", ("k",), source, F.count_distinct("k")),
        ],
    )
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2
    assert {r.contract for r in report.collect() if not r.passed} == {"rows", "all keys"}


def test_contracts_on_an_empty_frame(spark):
    df = spark.createDataFrame([], "k string, v double")
    checks = [
        Contract.unique("unique", "k"),
        Contract.equals("no rows", F.count(F.lit(1)), 0),
        Contract.equals("some rows", F.count(F.lit(1)), 3),
        Contract.key_count("keys", 0, "k"),
        Contract.reconcile("rows", F.count(F.lit(1)), df, F.count(F.lit(1))),
    ]
    assert {r.contract for r in check(df, checks).collect() if not r.passed} == {"some rows"}
    assert {r.contract for r in check(df, checks[1:3]).collect() if not r.passed} == {"some rows"}


def test_a_failing_contract_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.range(5).withColumn("day", F.col("id") % 2)
    publish(good, path, [Contract.unique("unique", "id"), Contract.not_null("set", "id")], ["day"], "id")
    first = current_version(spark, path)
    with pytest.raises(ContractViolation, match="unique"):
        publish(good.union(good), path, [Contract.unique("unique", "id")])
    assert current_version(spark, path) == first and read_published(spark, path).count() == 5
    # The failed build is gone as well.
    assert [x for x in list_folder(spark, path) if x.startswith("v-")] == [first.rsplit("/", 1)[1]]


def test_a_build_that_is_killed_before_the_switch_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    publish(spark.range(5), path)
    first = current_version(spark, path)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr("journeyloom.sources.publish.switch", killed)
        with pytest.raises(KeyboardInterrupt):
            publish(spark.range(7), path)
        # Half-written files without a pointer are no table at all.
        with pytest.raises(KeyboardInterrupt):
            publish(spark.range(7), str(tmp_path / "new"))
    assert current_version(spark, path) == first and read_published(spark, path).count() == 5
    with pytest.raises(NotPublished):
        read_published(spark, str(tmp_path / "new"))
    held = read_published(spark, path)
    publish(spark.range(9), path)
    # Who reads the version before goes on; what the killed build left goes once it is older than that.
    assert held.count() == 5 and read_published(spark, path).count() == 9
    publish(read_published(spark, path).where("id > 1"), path)
    assert read_published(spark, path).count() == 7
    assert len([x for x in list_folder(spark, path) if x.startswith("v-")]) == 2


def test_files_are_laid_out_in_ranges(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("id", "pmod(xxhash64(id), 10) AS day", "pmod(hash(id), 7) AS k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        publish(rows, str(tmp_path / "ranged"), [], ["day", "k"], "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    publish(rows.repartition(4), str(tmp_path / "mixed"))
    ranged = layout_report(spark, str(tmp_path / "ranged"), ["day", "k"]).first()
    assert (ranged.row_count, ranged.overlapping_files, ranged.overlapping_blocks) == (40_000, 0, 0) and ranged.file_count == 4
    mixed = layout_report(spark, str(tmp_path / "mixed"), ["day", "k"]).first()
    assert mixed.overlapping_files == 3 and mixed.row_count == 40_000
    one = rows.coalesce(1)
    publish(one, str(tmp_path / "unsorted"))
    assert layout_report(spark, str(tmp_path / "unsorted"), ["day"]).first().overlapping_blocks == 3


def test_tables_are_published_in_order(spark, chain, tmp_path):
    out = publish_attribution(chain, str(tmp_path), channels=3)
    counts = {name: read_mart(spark, str(tmp_path), name).count() for name in out}
    assert counts == {
        "fct_transactions": 3,
        "fct_transaction_items": 0,
        "fct_sessions": 3,
        "dim_pseudo_users": 2,
        "dim_date": 4,
        "dim_channel": 10,
        "dim_geo": 1,
        "bridge_transaction_touchpoints": 4,
        "mart_attribution_paths": 3,
        "fct_attribution_credits": 3 * 3 + 2 * 4,
        "mart_attribution_channel_comparison": 2 * 5 * 3,
        "mart_attribution_channel_shifts": 4 * 3,
    }


def test_runs_of_days_have_every_row_once(spark):
    day = lambda d: dt.date(2020, 11, d)
    dates = [None, None, *[day(1)] * 2, *[day(2)] * 7, day(3), day(5), *[day(9)] * 3]
    rows = spark.createDataFrame([(d,) for d in dates], "day date")
    taken = lambda most: [
        sorted((r[0] for r in rows.where(run).collect()), key=str) for run in day_slices(rows, "day", most)
    ]
    assert taken(100) == [sorted(dates, key=str)]
    assert taken(4) == [[day(1)] * 2 + [None] * 2, [day(2)] * 7 + [day(3), day(5)], [day(9)] * 3]
    assert taken(1) == [[day(1)] * 2 + [None] * 2, [day(2)] * 7, [day(3)], [day(5)], [day(9)] * 3]
    assert len(day_slices(rows.where("false"), "day", 4)) == len(day_slices(rows.where("day is null"), "day", 4)) == 1


def test_publishing_holds_one_run_of_days_at_a_time(spark, chain, tmp_path):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = blocks.getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {n for n in names if n.startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    frames, before, own = list_folder(spark, scratch_folder(spark)), shuffles(), spark.conf.get(setting, None)
    out = publish_attribution(replace(chain, config=replace(chain.config, slice_rows=1)), str(tmp_path), channels=3)
    # Nothing is left of the way there; shuffle files are deleted in the background.
    assert sorted(list_folder(spark, scratch_folder(spark))) == sorted(frames)
    assert spark.conf.get(setting, None) == own
    end = time.monotonic() + 20
    while shuffles() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not shuffles() - before

    bridge = bridge_touchpoints(out["fct_transactions"], out["fct_sessions"], chain.config)
    whole = {
        "bridge_transaction_touchpoints": bridge,
        "fct_attribution_credits": attribution_credits(bridge, chain.config),
    }
    by_name = lambda df, names: sorted(map(str, df.select(*names).collect()))
    for name, df in whole.items():
        assert by_name(out[name], df.columns) == by_name(df, df.columns)
        report = layout_report(spark, f"{tmp_path}/{name}", LAYOUT[name][0]).first()
        assert (report.file_count, report.overlapping_files, report.overlapping_blocks) == (3, 0, 0)
        days = out[name].groupBy(F.col("_metadata.file_path")).agg(F.count_distinct("transaction_date"))
        assert [n for _, n in days.collect()] == [1, 1, 1]


def test_session_contracts_read_their_inputs_once(chain):
    report = check(chain.sessions, session_contracts(settle(chain.staged, "staged"), chain.transactions))
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3


def test_seeded_defects_fail_their_contracts(chain):
    tx, bridge, credits = chain.transactions, chain.settled_bridge, chain.settled_credits
    failing = lambda df, checks: {r.contract for r in check(df, checks).collect() if not r.passed}
    assert failing(tx, transaction_contracts(chain.staged)) == set()
    assert failing(tx.limit(1), transaction_contracts(chain.staged)) == {"all purchase events are kept or counted as duplicates"}
    # A flag on another row of the journey hides nothing: transactions are counted by their keys.
    lost = bridge.where(F.col("transaction_key") != tx.agg(F.min("transaction_key")).first()[0])
    assert "all transactions are represented" in failing(lost, bridge_contracts(tx, 30))
    assert failing(credits, credit_contracts(bridge)) == set()
    assert failing(credits.where("not (attribution_model = 'linear' and touchpoint_position_asc = 1)"), credit_contracts(bridge)) == {
        "credit rows follow from the bridge", "weights of a transaction sum to one",
    }
    doubled = chain.comparison.withColumn("attributed_revenue_usd", 2 * F.col("attributed_revenue_usd"))
    assert "totals are those of the population" in failing(doubled, comparison_contracts(3, bridge))
    assert failing(chain.comparison, comparison_contracts(3, bridge)) == set()


def test_reconciliation_passes_and_fails_on_a_seeded_defect(chain):
    staged, tx, se, bridge = chain.staged, chain.transactions, chain.sessions, chain.settled_bridge
    assert reconcile.reconcile_events(chain.events, staged).first().reconciliation_status == "PASS"
    assert reconcile.reconcile_events(chain.events, staged.where("event_name <> 'page_view'")).first().reconciliation_status == "REVIEW"
    assert reconcile.reconcile_items(chain.events, stage_items(chain.events)).first().reconciliation_status in ("PASS", "REVIEW")
    ok = reconcile.reconcile_transactions(staged, tx, {"fact_transaction_rows": 3, "duplicate_measurement_rows_removed": 1}).first()
    assert (ok.reconciliation_status, ok.raw_revenue_reconciles, ok.duplicate_measurement_revenue_removed_usd) == ("PASS", True, 10.0)
    assert reconcile.reconcile_transactions(staged, tx, {"fact_transaction_rows": 4}).first().reconciliation_status == "REVIEW"
    assert reconcile.reconcile_sessions(staged, tx, se).first().reconciliation_status == "PASS"
    assert reconcile.reconcile_sessions(staged, tx, se.where("user_pseudo_id <> 'u2'")).first().reconciliation_status == "REVIEW"
    assert reconcile.reconcile_bridge(tx, bridge, 30).first().reconciliation_status == "PASS"
    assert reconcile.reconcile_bridge(tx, bridge.union(bridge.limit(1)), 30).first().reconciliation_status == "FAIL"
    credits = chain.settled_credits
    assert {r.model_reconciliation_status for r in reconcile.reconcile_credits(tx, bridge, credits).collect()} == {"PASS"}
    broken = credits.where("not (attribution_model = 'linear' and touchpoint_position_asc = 1)")
    got = {r.attribution_model: r.model_reconciliation_status for r in reconcile.reconcile_credits(tx, bridge, broken).collect()}
    assert got["linear"] == "FAIL"
    mart, totals = chain.comparison, reconcile.population_totals(credits)
    rows = reconcile.reconcile_comparison(mart, totals, 3).collect()
    assert len(rows) == 10
    assert {r.reconciliation_status for r in rows if r.analysis_population == "all_observed"} == {"PASS"}
    assert {r.reconciliation_status for r in reconcile.reconcile_comparison(mart, totals, 4).collect()} == {"FAIL"}


def test_day_folders_are_pruned(spark, chain, tmp_path):
    path = str(tmp_path / "days")
    chain.events.write.partitionBy("event_date").parquet(path)
    got = read_events(spark, path, "20201102", "20201103")
    assert got.count() == 2 and dict(got.dtypes)["event_date"] == "string"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [(cast" in plan


def test_staging_reads_only_the_leaves_it_needs(spark, chain):
    narrow = stage_events(chain.events).select("geo_country", "event_name").where("is_purchase_event")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "geo:struct<country:string>" in plan and "items" not in plan
    assert "EqualTo(event_name,purchase)" in plan


def test_settled_frames_live_in_the_shared_folder(spark):
    held = settle(spark.range(3), "probe")
    shared = spark.conf.get("spark.checkpoint.dir")
    assert application_folder(spark).startswith(shared)
    assert held.inputFiles()[0].startswith(f"file://{shared}")


def test_leading_values_do_not_shuffle_all_distinct_values(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("concat('k', id % 3) AS k", "case when id % 3 = 2 then 'only' else cast(hash(id) AS string) end AS v")
    rows = rows.unionByName(spark.createDataFrame([("k9", None), ("k1", None)], "k string, v string"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    found = leading_values(rows, "k", "v", 3, "first")
    got = {r.k: r.first for r in found.collect()}
    expected = {}
    for r in rows.where("v is not null").distinct().collect():
        expected.setdefault(r.k, []).append(r.v)
    assert got == {k: sorted(v)[:3] for k, v in expected.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The last exchanges carry what is left behind the bound, and nothing is exchanged before it.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    near = rows.join(found.select(F.col("k").alias("of"), F.element_at("first", -1).alias("bound")), F.col("k") == F.col("of")).where("v <= bound")
    assert near.select("k", "v").distinct().count() <= 12


def test_one_pass_equals_separate_aggregates(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", 2.0), (2, None, 3.0), (2, None, 4.0)], "i int, k string, v double")
    row = one_pass(df, {"n": F.count(F.lit(1)), "s": F.sum("v"), "nulls": F.count_if(F.col("k").isNull())}, [distinct("ks", "k"), distinct("pairs", "i", "k"), distinct("vs", "v")]).first()
    assert row.asDict() == {"n": 4, "s": 9.0, "nulls": 2, "ks": 2, "pairs": 2, "vs": 3}


def test_reconciliation_reads_each_side_once(spark, chain):
    staged, tx, se = settle(chain.staged, "staged"), chain.transactions, chain.sessions
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(reconcile.reconcile_sessions(staged, tx, se)).count("Relation [") == 3
    assert plan(reconcile.reconcile_events(chain.events, staged)).count("Relation [") == 2


def test_dim_channel_does_not_write_the_session_fact(spark, chain, monkeypatch):
    from journeyloom.plans import warehouse
    from workloads import queries

    written = []
    monkeypatch.setattr(warehouse, "settle", lambda df, name: written.append(name) or settle(df, name))
    fresh = AttributionChain(chain.events, chain.config)
    monkeypatch.setattr(queries, "_chain", lambda spark, sf: fresh)
    got = queries.QUERIES["dim_channel"](spark, "").collect()
    assert written == ["fct_transactions"]
    assert {r.channel_group: r.session_count for r in got if r.session_count} == {"Email": 1, "Paid Search": 1, "Direct": 1}
    by_order = lambda df: sorted(map(tuple, queries.plain(df).collect()))
    assert sorted(map(tuple, got)) == by_order(entities.dim_channel(chain.sessions))


def test_channel_mapping_tells_rules_and_retargeting(spark):
    rows = [
        ("(direct)", "(none)", "(not set)"), ("g", "CPC", "x"), ("g", "cpc", "Remarketing May"), ("s", "paid-social", "x"),
        ("s", "Social", "x"), ("d", "banner", "retargeting"), ("n", "email", "x"), ("z", "podcast", "x"), ("z", "podcast", "x"),
    ]
    df = spark.createDataFrame(rows, "session_source string, session_medium string, session_campaign string")
    df = df.withColumn("session_channel_group", channel_group(F.col("session_source"), F.col("session_medium")))
    got = {(r.session_source, r.session_medium): (r.channel_group, r.reporting_channel, r.mapping_rule, r.session_count) for r in entities.dim_channel_mapping(df).collect()}
    assert got["(direct)", "(none)"] == ("Direct", "Direct", "(direct) / (none)", 1)
    assert got["g", "CPC"][:2] == ("Paid Search", "Paid Search") and got["g", "cpc"][:2] == ("Paid Search", "Retargeting")
    assert got["s", "paid-social"][:3] == ("Paid Social", "Paid Social", "medium matches paid.*social|social.*paid")
    assert got["s", "Social"][:2] == ("Organic Social", "Organic Social") and got["d", "banner"][:2] == ("Display", "Retargeting")
    assert got["z", "podcast"] == ("Other", "Other or Unassigned", "no rule", 2) and len(got) == 8
