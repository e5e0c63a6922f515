import datetime as dt

from pyspark.sql import functions as F

from journeyloom.functions.text import double_text, strip
from journeyloom.operators import profiling
from journeyloom.operators.sessions import channel_group, fct_sessions
from journeyloom.operators.staging import EVENT_COLUMNS, ITEM_COLUMNS, stage_events, stage_items
from journeyloom.operators.transactions import fct_transactions
from journeyloom.sources.tables import REQUIRED_PATHS, verify_schema
from tests.fixtures import double, event, events, floating, session, text, whole


def test_strip_takes_all_white_space(spark):
    df = spark.createDataFrame([("\t  a b \n　",), ("\t ",), (None,)], "x string")
    assert [r[0] for r in df.select(strip(F.col("x"))).collect()] == ["a b", "", None]


def test_double_text_has_no_trailing_zero(spark):
    df = spark.createDataFrame([(40.0,), (0.5,), (1e7,), (None,)], "x double")
    assert [r[0] for r in df.select(double_text(F.col("x"))).collect()] == ["40", "0.5", "10000000", None]


def test_parameters_are_typed_by_slot_and_repeated_keys_take_the_largest(spark):
    ev = events(
        spark,
        [
            event(1, params=[("ga_session_id", text("7")), ("value", text("2.5")), ("session_engaged", double(1.0))]),
            event(2, params=[("ga_session_id", whole(3)), ("ga_session_id", whole(9)), ("value", whole(4))]),
            event(3, params=[("ga_session_id", text("1.5")), ("value", floating(0.25)), ("session_engaged", text(" YES\t"))]),
            event(4, params=[("session_engaged", text("maybe")), ("source", whole(5))]),
        ],
    )
    got = {r.event_bundle_sequence_id: r for r in stage_events(ev).collect()}
    assert [got[i].ga_session_id for i in (1, 2, 3, 4)] == [7, 9, None, None]
    assert [got[i].event_value for i in (1, 2, 3, 4)] == [2.5, 4.0, 0.25, None]
    assert [got[i].session_engaged for i in (1, 2, 3, 4)] == [True, None, True, None]
    assert got[4].event_source is None
    assert [got[i].session_key for i in (1, 2, 3, 4)] == ["u1|7", "u1|9", None, None]


def test_event_contract_has_all_columns_and_flags(spark):
    ev = events(spark, [event(1, user=" ", params=[session(1)]), event(2, user=None), event(3, items=None)])
    staged = stage_events(ev)
    assert staged.columns == EVENT_COLUMNS and len(EVENT_COLUMNS) == 53
    rows = {r.event_bundle_sequence_id: r for r in staged.collect()}
    assert rows[1].session_key is None and not rows[1].has_user_pseudo_id and rows[1].has_session_id
    assert rows[2].source_event_fingerprint is not None
    assert rows[3].item_record_count == 0 and rows[3].items_json == "[]" and not rows[3].has_item_records


def test_transaction_id_status(spark):
    ids = [None, " \t", "(Not Set)", "NOT SET", "not_set ", "\tT1 "]
    ev = events(spark, [event(i, "purchase", tx=t) for i, t in enumerate(ids)])
    rows = sorted(stage_events(ev).collect(), key=lambda r: r.event_bundle_sequence_id)
    assert [r.transaction_id_status for r in rows] == ["MISSING", "MISSING", "NOT_SET", "NOT_SET", "NOT_SET", "VALID"]
    assert [r.transaction_id_normalized for r in rows] == [None] * 5 + ["T1"]


def test_items_keep_their_position_and_identity(spark):
    item = lambda i, n, p, q: (i, n, None, None, None, p, p, q, None, None)
    ev = events(spark, [event(1, items=[item("A ", "x", 2.0, 3), item(" ", " n", None, 1), item(None, "", 1.0, None)]), event(2)])
    got = stage_items(ev)
    assert got.columns == ITEM_COLUMNS
    rows = got.orderBy("item_offset").collect()
    assert [r.item_offset for r in rows] == [0, 1, 2]
    assert [r.item_identity for r in rows] == ["ID:A", "NAME:n", None]
    assert [r.calculated_item_value_in_usd for r in rows] == [6.0, None, None]
    assert len({r.item_record_fingerprint for r in rows}) == 3


def test_transactions_keep_reliable_ids_and_split_conflicts(spark):
    rows = [
        event(1, "purchase", "u1", 1, 10, tx="A", revenue=5.0),
        event(2, "purchase", "u1", 1, 3, tx=" A\t", revenue=5.0),
        event(3, "purchase", "u1", tx="B", revenue=5.0),
        event(4, "purchase", "u2", tx="B", revenue=5.0),
        event(5, "purchase", "u1", tx="C", revenue=5.0),
        event(6, "purchase", "u1", tx="C", revenue=6.0),
        event(7, "purchase", "u1", tx="D", revenue=None),
        event(8, "purchase", "u1", tx=None, revenue=1.0),
        event(9, "purchase", "u1", tx="not set", revenue=1.0),
        event(10, "purchase", None, tx="E", revenue=1.0),
        event(11, "view_item", "u1", tx="A", revenue=5.0),
    ]
    got = fct_transactions(stage_events(events(spark, rows))).collect()
    by_method = {}
    for r in got:
        by_method.setdefault(r.transaction_key_method, []).append(r)
    assert {k: len(v) for k, v in by_method.items()} == {
        "RELIABLE_TRANSACTION_ID": 2,
        "FALLBACK_CONFLICTING_TRANSACTION_ID": 5,
        "FALLBACK_MISSING_ID": 1,
        "FALLBACK_NOT_SET": 1,
    }
    a = next(r for r in got if r.transaction_key == "TRANSACTION_ID|A")
    assert (a.measurement_event_rows, a.duplicate_measurement_rows, a.measurement_span_seconds) == (2, 1, 7)
    assert a.transaction_timestamp_utc == dt.datetime(2020, 11, 1, 0, 0, 3)
    assert any(r.transaction_key == "TRANSACTION_ID|D" for r in got)


def test_session_takes_first_acquisition_and_pages(spark):
    p = lambda loc: ("page_location", text(loc))
    rows = [
        event(1, second=1, params=[session(1), p(" ")], source="google"),
        event(2, second=2, params=[session(1), p("/a"), ("source", text(" \t")), ("medium", text("cpc"))], source="x"),
        event(3, "purchase", second=3, params=[session(1), p("/b"), ("source", text("late"))], tx="A", revenue=2.0),
        event(4, "purchase", second=4, params=[session(1), p("/c")], tx="A", revenue=2.0),
        event(5, second=5, params=[session(1), ("engagement_time_msec", whole(500)), ("session_engaged", whole(1))]),
        event(6, user="u2", params=[session(1)]),
        event(7, user="u2"),
    ]
    staged = stage_events(events(spark, rows))
    got = {r.session_key: r for r in fct_sessions(staged, fct_transactions(staged)).collect()}
    s = got["u1|1"]
    assert (s.session_source, s.session_medium, s.session_campaign) == ("(not set)", "cpc", "(not set)")
    assert (s.session_channel_group, s.first_user_source) == ("Paid Search", "google")
    assert (s.entry_page_location, s.exit_page_location) == ("/a", "/c")
    assert (s.event_count, s.distinct_event_name_count, s.session_duration_seconds) == (5, 2, 4)
    assert (s.canonical_transaction_count, s.canonical_revenue_usd, s.duplicate_purchase_measurement_rows) == (1, 2.0, 1)
    assert s.is_engaged_session and s.average_engagement_seconds_per_event == 0.1
    d = got["u2|1"]
    assert (d.session_source, d.session_medium, d.session_channel_group) == ("(direct)", "(none)", "Direct")
    assert d.average_order_value_usd is None and d.canonical_revenue_usd == 0.0 and len(got) == 2


def test_channel_rules_in_order(spark):
    cases = {
        ("(direct)", "(none)"): "Direct",
        ("a", "(none)"): "Other",
        ("a", "PPC"): "Paid Search",
        ("a", "cpc "): "Other",
        ("a", "organic social"): "Organic Search",
        ("a", "social-paid"): "Paid Social",
        ("a", "Social"): "Organic Social",
        ("a", "cpm"): "Display",
        ("a", "e-mail email"): "Email",
        ("a", "affiliate referral"): "Affiliate",
        ("a", "referral"): "Referral",
    }
    df = spark.createDataFrame([(s, m, c) for (s, m), c in cases.items()], "s string, m string, want string")
    assert df.where(channel_group(F.col("s"), F.col("m")) != F.col("want")).count() == 0


def test_profiles_read_the_first_value_of_a_repeated_key(spark):
    rows = [
        event(1, "purchase", tx="A", revenue=5.0, params=[("value", whole(5)), ("value", whole(9)), ("transaction_id", text("A"))]),
        event(2, "purchase", tx="A", revenue=5.0, params=[("value", text("9")), ("transaction_id", whole(3))]),
    ]
    r = profiling.purchase_quality(events(spark, rows)).first()
    assert (r.matching_revenue_value_events, r.mismatched_revenue_value_events) == (1, 1)
    assert (r.matching_transaction_id_events, r.mismatched_transaction_id_events) == (1, 1)
    assert (r.duplicated_transaction_ids, r.excess_purchase_event_rows) == (1, 1)
    assert r.currencies_observed == []


def test_duplicate_patterns(spark):
    s = lambda n: [session(n)]
    rows = [
        event(1, "purchase", tx=None), event(2, "purchase", tx="U", params=s(1)),
        event(3, "purchase", "a", tx="X"), event(4, "purchase", "b", tx="X"),
        event(5, "purchase", tx="R", revenue=1.0), event(6, "purchase", tx="R", revenue=2.0),
        event(7, "purchase", tx="T", revenue=1.0), event(8, "purchase", tx="T", revenue=1.0),
        event(9, "purchase", tx="S", params=s(1)), event(10, "purchase", tx="S", second=90, params=s(1)),
        event(11, "purchase", tx="O", params=s(1)), event(12, "purchase", tx="O", second=9, params=s(2)),
    ]
    got = profiling.duplicate_transaction_patterns(events(spark, rows)).collect()
    assert [r.transaction_pattern for r in got] == list(profiling.PATTERNS)
    assert [r.sample_transaction_ids for r in got] == [["U"], None, ["X"], ["R"], ["T"], ["S"], ["O"]]
    assert [r.maximum_event_span_seconds for r in got] == [0, 0, 0, 0, 0, 90, 9]


def test_final_keys_count_null_revenue_as_a_value(spark):
    rows = [event(1, "purchase", tx="A", revenue=1.0), event(2, "purchase", tx="A", revenue=None), event(3, "purchase", tx="B", revenue=None)]
    got = {r.final_key_method: r.purchase_event_rows for r in profiling.final_key_profile(events(spark, rows)).collect()}
    assert got == {"FALLBACK_CONFLICTING_TRANSACTION_ID": 2, "RELIABLE_TRANSACTION_ID": 1}


def test_schema_contract_lists_missing_paths_first(spark):
    ev = events(spark, [event(1), event(2, user=None)])
    got = verify_schema([ev, ev], [*REQUIRED_PATHS, "app.id"], count_rows=True).collect()
    assert (got[0].required_field_path, got[0].schema_status, got[0].data_type) == ("app.id", "MISSING", None)
    assert all(r.schema_status == "AVAILABLE" for r in got[1:]) and len(got) == len(REQUIRED_PATHS) + 1
    assert {r.required_field_path: r.populated_rows for r in got}["user_pseudo_id"] == 2
