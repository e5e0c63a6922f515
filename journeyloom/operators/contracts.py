"""Data contracts: named checks on a frame.

All checks of a table are answered by one aggregate over it, and by one over each frame it is
reconciled with, however many checks there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from journeyloom.operators.comparison import ALL_OBSERVED
from journeyloom.operators.onepass import GroupCounts, attach_row, distinct, one_pass


class ContractViolation(Exception):
    """Raised with the names of the contracts that failed."""


@dataclass(frozen=True)
class Contract:
    """One check.

    ``rows``      - condition of a bad row; violations are counted.
    ``total``     - condition over aggregates of the whole frame that must hold.
    ``group``     - condition over aggregates of a key group that marks the group as bad.
    ``keys``      - the number of distinct keys must be ``expected``.
    ``reconcile`` - an aggregate, or the number of distinct keys, must be that of another frame.

    ``against`` are further one-row frames whose columns a condition may name.
    """

    name: str
    kind: str
    condition: Column | None = None
    keys: tuple[str, ...] = ()
    against: tuple[DataFrame, ...] = field(default=(), compare=False)
    source: DataFrame | None = field(default=None, compare=False)
    expected: Column | float | None = field(default=None, compare=False)
    tolerance: float = 0

    @staticmethod
    def unique(name: str, *keys: str) -> Contract:
        return Contract(name, "group", F.count(F.lit(1)) > 1, keys)

    @staticmethod
    def not_null(name: str, *columns: str) -> Contract:
        return Contract.no_row(name, reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))

    @staticmethod
    def nonnegative(name: str, *columns: str) -> Contract:
        return Contract.no_row(name, reduce(lambda a, b: a | b, [F.col(c) < 0 for c in columns]))

    @staticmethod
    def no_row(name: str, bad: Column) -> Contract:
        return Contract(name, "rows", bad)

    @staticmethod
    def equals(name: str, aggregate: Column, expected: float, tolerance: float = 0) -> Contract:
        return Contract(name, "total", F.abs(aggregate - F.lit(expected)) <= tolerance)

    @staticmethod
    def key_count(name: str, expected: int, *keys: str) -> Contract:
        return Contract(name, "keys", keys=keys, expected=expected)

    @staticmethod
    def per_group(name: str, keys: tuple[str, ...], bad: Column, *against: DataFrame) -> Contract:
        return Contract(name, "group", bad, keys, against)

    @staticmethod
    def reconcile(
        name: str, measure: Column, source: DataFrame, source_measure: Column, tolerance: float = 0
    ) -> Contract:
        return Contract(name, "reconcile", measure, source=source, expected=source_measure, tolerance=tolerance)

    @staticmethod
    def reconcile_keys(name: str, keys: tuple[str, ...], source: DataFrame, source_measure: Column) -> Contract:
        return Contract(name, "reconcile", keys=keys, source=source, expected=source_measure)


def _failed(holds: Column) -> Column:
    return F.when(holds, 0).otherwise(1)


def check(df: DataFrame, contracts: list[Contract]) -> DataFrame:
    """Evaluate contracts: one row each with the number of violations.

    The frame is read once, and so is every frame it is reconciled with.
    """
    reached: dict[int, DataFrame] = {id(f): f for c in contracts for f in c.against}
    wide = reduce(attach_row, reached.values(), df)
    totals: dict[str, Column] = {}
    groups: list[GroupCounts] = []
    sources: dict[int, tuple[DataFrame, dict[str, Column]]] = {}
    for i, c in enumerate(contracts):
        name = f"c{i}"
        if c.kind == "rows":
            totals[name] = F.count_if(c.condition)
        elif c.kind == "total":
            totals[name] = _failed(c.condition)
        elif c.kind == "group":
            groups.append(GroupCounts(c.keys, {name: c.condition}))
        elif c.keys:
            groups.append(distinct(name, *c.keys))
        else:
            totals[name] = c.condition
        if c.kind == "reconcile":
            sources.setdefault(id(c.source), (c.source, {}))[1][f"s{i}"] = c.expected
    one_row = one_pass(wide, totals, groups)
    for source, measures in sources.values():
        one_row = attach_row(one_row, source.agg(*[m.alias(name) for name, m in measures.items()]))

    def violations(i: int, c: Contract) -> Column:
        if c.kind in ("keys", "reconcile"):
            wanted = F.lit(c.expected) if c.kind == "keys" else F.col(f"s{i}")
            return _failed(F.abs(F.col(f"c{i}") - wanted) <= c.tolerance)
        return F.col(f"c{i}")

    rows = [
        F.struct(F.lit(c.name).alias("contract"), violations(i, c).cast("bigint").alias("violations"))
        for i, c in enumerate(contracts)
    ]
    return one_row.select(F.inline(F.array(*rows))).withColumn("passed", F.col("violations") == 0)


def enforce(df: DataFrame, contracts: list[Contract]) -> None:
    """Raise ``ContractViolation`` when a contract fails; only failing names reach the driver."""
    if not contracts:
        return
    failed = check(df, contracts).where(~F.col("passed")).collect()
    if failed:
        raise ContractViolation("; ".join(f"{r.contract}: {r.violations}" for r in sorted(failed)))


# ---- contract sets of the published tables -----------------------------------------------------


def session_contracts(staged: DataFrame, transactions: DataFrame) -> list[Contract]:
    return [
        Contract.unique("session_key is unique", "session_key"),
        Contract.not_null("session_key is set", "session_key"),
        Contract.no_row(
            "sessions do not end before they start",
            F.col("session_start_timestamp_utc") > F.col("session_end_timestamp_utc"),
        ),
        Contract.reconcile(
            "all events are represented", F.sum("event_count"), staged, F.count("session_key")
        ),
        Contract.reconcile(
            "all transactions are represented",
            F.sum("canonical_transaction_count"),
            transactions,
            F.count("session_key"),
        ),
        Contract.reconcile(
            "revenue is represented",
            F.sum("canonical_revenue_usd"),
            transactions,
            F.coalesce(F.sum(F.when(F.col("session_key").isNotNull(), F.col("transaction_revenue_usd"))), F.lit(0.0)),
            1e-6,
        ),
    ]


def transaction_contracts(staged: DataFrame) -> list[Contract]:
    reliable = F.col("transaction_key_method") == "RELIABLE_TRANSACTION_ID"
    return [
        Contract.unique("transaction_key is unique", "transaction_key"),
        Contract.not_null("transaction_key is set", "transaction_key"),
        Contract.no_row(
            "reliable IDs have no conflict",
            reliable
            & (F.col("transaction_id_cross_user_conflict") | F.col("transaction_id_revenue_conflict")),
        ),
        Contract.reconcile(
            "all purchase events are kept or counted as duplicates",
            F.sum("measurement_event_rows"),
            staged,
            F.count_if("is_purchase_event"),
        ),
    ]


def bridge_contracts(transactions: DataFrame, lookback_days: int) -> list[Contract]:
    return [
        Contract.not_null(
            "transaction identifiers are set",
            "transaction_key",
            "user_pseudo_id",
            "transaction_timestamp_utc",
            "transaction_session_key",
        ),
        Contract.not_null(
            "attribution dimensions are set",
            "touchpoint_source",
            "touchpoint_medium",
            "touchpoint_channel_group",
        ),
        Contract.no_row(
            "touchpoints lie inside the lookback window",
            (F.col("seconds_before_transaction") < 0)
            | (F.col("seconds_before_transaction") > lookback_days * 86400),
        ),
        Contract.unique(
            "transaction-touchpoint pairs are unique", "transaction_key", "touchpoint_session_key"
        ),
        Contract.per_group(
            "one conversion session per transaction",
            ("transaction_key",),
            F.count_if("is_conversion_session") != 1,
        ),
        Contract.reconcile_keys(
            "all transactions are represented", ("transaction_key",), transactions, F.count(F.lit(1))
        ),
        Contract.reconcile(
            "revenue is represented",
            F.sum(F.when(F.col("is_last_touchpoint"), F.col("transaction_revenue_usd"))),
            transactions,
            F.sum("transaction_revenue_usd"),
            0.01,
        ),
    ]


def credit_contracts(bridge: DataFrame, models: int = 5) -> list[Contract]:
    """``bridge`` is what the credits were built from.

    Three models credit one touchpoint of a journey, two credit all of them.
    """
    weight = F.sum("attribution_weight")
    return [
        Contract.key_count("all models are present", models, "attribution_model"),
        Contract.reconcile(
            "credit rows follow from the bridge",
            F.count(F.lit(1)),
            bridge,
            3 * F.count_if("is_last_touchpoint") + 2 * F.count(F.lit(1)),
        ),
        Contract.no_row(
            "weights lie in (0, 1]",
            F.col("attribution_weight").isNull()
            | (F.col("attribution_weight") <= 0)
            | (F.col("attribution_weight") > 1),
        ),
        Contract.not_null(
            "credit fields are set",
            "transaction_key",
            "touchpoint_session_key",
            "attribution_model",
            "touchpoint_channel_group",
            "attributed_revenue_usd",
        ),
        Contract.unique(
            "credit rows are unique", "attribution_model", "transaction_key", "touchpoint_session_key"
        ),
        Contract.per_group(
            "weights of a transaction sum to one",
            ("attribution_model", "transaction_key"),
            F.abs(weight - 1.0) > 1e-9,
        ),
    ]


def credit_total_contracts(transactions: DataFrame) -> list[Contract]:
    """Every model hands out all transactions and all revenue; checked on the model totals."""
    one = transactions.agg(
        F.count(F.lit(1)).alias("_n"), F.sum("transaction_revenue_usd").alias("_revenue")
    )
    conversions_off = F.abs(F.col("attributed_conversions") - F.col("_n")) > 1e-6
    revenue_off = F.abs(F.col("attributed_revenue_usd") - F.col("_revenue")) > 0.01
    bad = (F.col("represented_transactions") != F.col("_n")) | conversions_off | revenue_off
    return [
        Contract("models allocate all conversions and revenue", "total", F.count_if(bad) == 0, against=(one,))
    ]


def population_totals(bridge: DataFrame) -> DataFrame:
    """Transactions and revenue of all journeys and of those with a complete window, one row."""
    closing = F.col("is_last_touchpoint")
    complete = closing & ~F.col("is_lookback_left_censored")
    paid = lambda which: F.coalesce(F.sum(F.when(which, F.col("transaction_revenue_usd"))), F.lit(0.0))
    return bridge.agg(
        F.count_if(closing).alias("_all_transactions"),
        paid(closing).alias("_all_revenue"),
        F.count_if(complete).alias("_complete_transactions"),
        paid(complete).alias("_complete_revenue"),
    )


def comparison_contracts(
    channels: int, bridge: DataFrame, models: int = 5, populations: int = 2
) -> list[Contract]:
    """``bridge`` is the independent source of the population totals."""
    keys = ("analysis_population", "attribution_model")
    whole = F.max("analysis_population") == ALL_OBSERVED
    expected = lambda what: F.when(whole, F.max(f"_all_{what}")).otherwise(F.max(f"_complete_{what}"))
    off = lambda c, target, tol: F.abs(F.sum(c) - target) > tol
    own = lambda model, c, tol: (F.col("attribution_model") == model) & (F.abs(F.col(c)) > tol)
    return [
        Contract.equals("grid is complete", F.count(F.lit(1)), channels * models * populations),
        Contract.unique("grid cells are unique", *keys, "touchpoint_channel_group"),
        Contract.not_null(
            "comparison fields are set",
            *keys,
            "touchpoint_channel_group",
            "attributed_conversion_credit",
            "attributed_revenue_usd",
        ),
        Contract.nonnegative(
            "credit is not negative", "attributed_conversion_credit", "attributed_revenue_usd"
        ),
        Contract.per_group(
            "totals are those of the population",
            keys,
            (F.abs(F.sum("attributed_conversion_credit") - expected("transactions")) > 1e-6)
            | (F.abs(F.sum("attributed_revenue_usd") - expected("revenue")) > 0.01),
            population_totals(bridge),
        ),
        Contract.per_group(
            "shares sum to one",
            keys,
            off("model_conversion_share", 1.0, 1e-9) | off("model_revenue_share", 1.0, 1e-9),
        ),
        Contract.per_group(
            "deltas against last touch cancel",
            keys,
            off("conversion_delta_vs_last_touch", 0.0, 1e-6)
            | off("revenue_delta_vs_last_touch_usd", 0.0, 0.01),
        ),
        Contract.per_group(
            "models agree within a population",
            ("analysis_population",),
            (F.max("model_total_attributed_revenue_usd") - F.min("model_total_attributed_revenue_usd") > 0.01)
            | (
                F.max("model_total_attributed_conversions") - F.min("model_total_attributed_conversions")
                > 1e-6
            ),
        ),
        Contract.no_row(
            "last touch equals its baseline",
            own("last_touch", "conversion_delta_vs_last_touch", 1e-9)
            | own("last_touch", "revenue_delta_vs_last_touch_usd", 0.01),
        ),
        Contract.no_row(
            "last non-direct equals its baseline",
            own("last_non_direct", "conversion_delta_vs_last_non_direct", 1e-9)
            | own("last_non_direct", "revenue_delta_vs_last_non_direct_usd", 0.01),
        ),
    ]


def shift_contracts(channels: int, models: int = 4) -> list[Contract]:
    moved = [f"{side}_revenue_delta_vs_last_touch_usd" for side in ("full", "complete")]
    return [
        Contract.equals("analysis is complete", F.count(F.lit(1)), channels * models),
        Contract.key_count("comparison models are present", models, "attribution_model"),
        Contract.key_count("channels are present", channels, "touchpoint_channel_group"),
        Contract.not_null(
            "analysis fields are set",
            "attribution_model",
            "touchpoint_channel_group",
            "full_model_revenue_usd",
            "full_last_touch_revenue_usd",
            "complete_model_revenue_usd",
            "complete_last_touch_revenue_usd",
        ),
        Contract.per_group(
            "shifts cancel within a model",
            ("attribution_model",),
            (F.abs(F.sum(moved[0])) > 0.01) | (F.abs(F.sum(moved[1])) > 0.01),
        ),
    ]


def geo_contracts(target: DataFrame, weeks: int, pre_weeks: int) -> list[Contract]:
    """``target`` are the sessions the panel was built from."""
    pre = F.count_if(F.col("period_name") == "PRE")
    rows = F.count(F.lit(1))
    return [
        Contract.per_group("regions have all weeks", ("geo_region",), rows != weeks),
        Contract.per_group(
            "regions have all PRE and TEST weeks",
            ("geo_region",),
            (pre != pre_weeks) | (rows - pre != weeks - pre_weeks),
        ),
        Contract.not_null("panel keys are set", "geo_key", "geo_region", "week_start_date", "period_name"),
        Contract.nonnegative(
            "outcomes are not negative",
            "observed_session_count",
            "observed_unique_users",
            "observed_transaction_count",
            "observed_revenue_usd",
            "observed_item_quantity",
        ),
        Contract.no_row(
            "outcomes are observed and unassigned",
            (F.col("treatment_assignment_status") != "UNASSIGNED") | F.col("is_synthetic_outcome"),
        ),
        Contract.reconcile(
            "sessions reconcile", F.sum("observed_session_count"), target, F.count(F.lit(1))
        ),
        Contract.reconcile(
            "transactions reconcile",
            F.sum("observed_transaction_count"),
            target,
            F.sum("canonical_transaction_count"),
        ),
        Contract.reconcile(
            "revenue reconciles",
            F.sum("observed_revenue_usd"),
            target,
            F.sum("canonical_revenue_usd"),
            0.01,
        ),
    ]


def feature_contracts(pre_weeks: int) -> list[Contract]:
    gap = F.abs(F.col("revenue_cv") - F.col("warehouse_revenue_cv"))
    return [
        Contract.unique("regions are unique", "geo_region"),
        Contract.no_row("regions have all PRE weeks", F.col("pre_weeks") != pre_weeks),
        Contract.no_row(
            "variation agrees with the panel",
            gap > 1e-6 + 1e-6 * F.abs(F.col("warehouse_revenue_cv")),
        ),
        Contract.not_null(
            "features are defined",
            "pre_transaction_rate_pct",
            "revenue_cv",
            "session_trend_pct_per_week",
            "revenue_trend_pct_per_week",
        ),
    ]


def profile_contracts(z_columns: list[str]) -> list[Contract]:
    return [
        c
        for z in z_columns
        for c in (
            Contract.equals(f"{z} has mean zero", F.avg(z), 0.0, 1e-10),
            Contract.equals(f"{z} has deviation one", F.stddev_pop(z), 1.0, 1e-10),
        )
    ]


def pair_contracts(measures: tuple[str, ...]) -> list[Contract]:
    correlations = [m for m in measures if m.endswith("_correlation")]
    ratios = [m for m in measures if m.endswith("_ratio")]
    distances = [m for m in measures if m not in correlations + ratios]
    either = lambda conds: reduce(lambda a, b: a | b, conds)
    return [
        Contract.unique("pair_id is unique", "pair_id"),
        Contract.not_null("pair measures are defined", *measures),
        Contract.nonnegative("distances are not negative", *distances),
        Contract.no_row(
            "correlations lie in [-1, 1]", either([F.abs(F.col(c)) > 1 + 1e-12 for c in correlations])
        ),
        Contract.no_row(
            "scale ratios lie in (0, 1]", either([(F.col(c) <= 0) | (F.col(c) > 1) for c in ratios])
        ),
    ]


def design_contracts() -> list[Contract]:
    """For one row per design and region: a region may serve in one pair only."""
    return [Contract.unique("regions are not reused", "design_name", "region")]


def user_contracts(transactions: DataFrame) -> list[Contract]:
    return [
        Contract.unique("users are unique", "user_pseudo_id"),
        Contract.no_row("event dates are ordered", F.col("first_event_date") > F.col("last_event_date")),
        Contract.no_row(
            "purchase dates are ordered", F.col("first_purchase_date") > F.col("last_purchase_date")
        ),
        Contract.reconcile(
            "transactions reconcile",
            F.sum("canonical_transaction_count"),
            transactions,
            F.count("user_pseudo_id"),
        ),
    ]


def item_contracts(transactions: DataFrame) -> list[Contract]:
    """For one row per transaction and item position."""
    return [
        Contract.unique("transaction_item_key is unique", "transaction_item_key"),
        Contract.not_null("items are linked", "transaction_item_key", "transaction_key", "item_record_fingerprint"),
        Contract.nonnegative("quantities are not negative", "item_quantity"),
        Contract.reconcile(
            "all items of transactions are present", F.count(F.lit(1)), transactions, F.sum("item_record_count")
        ),
        Contract.reconcile_keys(
            "transactions with items are present",
            ("transaction_key",),
            transactions,
            F.count_if(F.col("item_record_count") > 0),
        ),
    ]


def path_contracts(transactions: DataFrame) -> list[Contract]:
    """For one row per conversion journey."""
    return [
        Contract.unique("journeys are unique", "transaction_key"),
        Contract.not_null("paths are set", "channel_path", "first_touch_channel", "last_touch_channel"),
        Contract.reconcile("all transactions have a path", F.count(F.lit(1)), transactions, F.count(F.lit(1))),
        Contract.reconcile(
            "revenue is represented",
            F.sum("transaction_revenue_usd"),
            transactions,
            F.sum("transaction_revenue_usd"),
            0.01,
        ),
    ]


def dimension_contracts(sessions: DataFrame, *key: str) -> list[Contract]:
    """For a dimension that says how many sessions a member has."""
    return [
        Contract.unique("members are unique", *key),
        Contract.not_null("members are named", *key),
        Contract.reconcile("all sessions have a member", F.sum("session_count"), sessions, F.count(F.lit(1))),
    ]
