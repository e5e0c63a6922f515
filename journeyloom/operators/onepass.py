"""Several aggregates of one frame from a single read of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate, which is one row by construction."""
    return df.crossJoin(F.broadcast(one_row))


@dataclass(frozen=True)
class GroupCounts:
    """Counts of the groups of ``keys`` for which an aggregate condition holds, by name."""

    keys: tuple[str, ...]
    conditions: dict[str, Column] = field(default_factory=dict)


def distinct(name: str, *keys: str) -> GroupCounts:
    """The number of distinct keys without NULL."""
    return GroupCounts(keys, {name: F.count_if(_all_set(keys)) > 0})


def _all_set(keys: tuple[str, ...]) -> Column:
    held = F.lit(True)
    for k in keys:
        held = held & F.col(k).isNotNull()
    return held


def one_pass(df: DataFrame, totals: dict[str, Column], groups: list[GroupCounts]) -> DataFrame:
    """One row: aggregates of the whole frame, and counts of groups, from one scan and one exchange.

    The frame is aggregated by grouping sets, the empty set for the totals and one per list of keys.
    Each is combined before the exchange, so a key that holds a large part of the rows arrives as
    one row per task, as does the empty set.  Totals of an empty frame are those of no rows.
    """
    if not groups:
        return df.agg(*[c.alias(name) for name, c in totals.items()])
    columns = list(dict.fromkeys(k for g in groups for k in g.keys))
    sets = list(dict.fromkeys([(), *[g.keys for g in groups]]))
    number = lambda keys: sum(1 << k for k, c in enumerate(reversed(columns)) if c not in keys)
    conditions = {name: (g.keys, c) for g in groups for name, c in g.conditions.items()}
    grouped = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("_set"),
        *[c.alias(name) for name, c in totals.items()],
        *[c.alias(name) for name, (_, c) in conditions.items()],
    )
    in_set = lambda keys: F.col("_set") == number(keys)
    one_row = grouped.agg(
        *[F.max(F.when(in_set(()), F.col(name))).alias(name) for name in totals],
        *[F.count_if(in_set(keys) & F.col(name)).alias(name) for name, (keys, _) in conditions.items()],
    )
    if not totals:
        return one_row
    # Grouping sets of no rows have no row, not even the empty set.
    nothing = df.sparkSession.createDataFrame([], df.schema).agg(*[c.alias(f"_no_{name}") for name, c in totals.items()])
    return attach_row(one_row, nothing).select(
        *[F.coalesce(name, f"_no_{name}").alias(name) for name in totals], *conditions
    )
