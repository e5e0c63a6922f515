"""Numeric helpers that give NULL instead of an error, in ANSI mode as well."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL when b is zero or either side is NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column, digits: int = 2) -> Column:
    return F.round(100 * ratio(a, b), digits)


def min_max_ratio(a: Column, b: Column) -> Column:
    return ratio(F.least(a, b), F.greatest(a, b))


def rows_where(cond: Column) -> Column:
    return F.count_if(cond)


def sum_where(cond: Column, value: Column, zero: float | int = 0) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(zero)))


def differs(c: Column) -> Column:
    """Aggregate: does the group hold more than one distinct non-NULL value?

    min <> max answers the question in one pass; a distinct count would expand every row.
    """
    return F.coalesce(F.min(c) != F.max(c), F.lit(False))


def agrees(c: Column) -> Column:
    """Aggregate: does the group hold exactly one distinct non-NULL value?"""
    return F.coalesce(F.min(c) == F.max(c), F.lit(False))
