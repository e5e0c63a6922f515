"""Joins and orderings that survive a key holding a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from journeyloom.config import SkewConfig
from journeyloom.sources.workspace import settle


# Parts a hot key's rows are dealt into while they look their key up.
HOT_PARTS = 64
# A lookup of more rows than this is never broadcast, however small its files are.
BROADCAST_ROWS = 100_000


def hot_keys(counted: DataFrame, weight: str, skew: SkewConfig) -> DataFrame:
    """All keys of ``counted`` with ``skew.min_hot_rows`` rows or more, however many they are.

    There is at most one per ``min_hot_rows`` rows of the input.  The result is written, so that joins to
    it are planned by its real size.
    """
    return settle(counted.where(F.col(weight) >= skew.min_hot_rows), "hot_keys")


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    weight: str,
    spread: Column,
    skew: SkewConfig = SkewConfig(),
) -> DataFrame:
    """Left join of ``rows`` to a lookup with one row per ``key``, exact under skew.

    ``weight`` is the lookup column with the number of rows behind a key.  Every hot key stands in the
    hot part of the lookup ``HOT_PARTS`` times, and a row asks for one of them by ``spread``: the join
    is a broadcast where that part is small, else a shuffle that has no crowded key.  All other rows
    meet the rest of the lookup in a shuffle join; rows without a partner there (NULL or hot keys) are
    spread over the partitions rather than sent to one.
    """
    values = [c for c in lookup.columns if c != key]
    hot = hot_keys(lookup, weight, skew).select(
        F.col(key).alias("_hot_key"),
        F.struct(*values).alias("_hot"),
        F.explode(F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).alias("_hot_part"),
    )
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(HOT_PARTS)).cast("int"))
    marked = dealt.join(hot, (F.col(key) == F.col("_hot_key")) & (F.col("_part") == F.col("_hot_part")), "left")

    searched = F.col(key).isNotNull() & F.col("_hot").isNull()
    # Zero, but not a literal: a constant would be folded out of the join keys.
    nought = F.pmod(F.xxhash64(F.col(key)), F.lit(1))
    left = marked.withColumns(
        {
            "_find": F.when(searched, F.col(key)),
            "_lane": F.when(searched, nought).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))),
        }
    )
    right = lookup.where(F.coalesce(F.col(weight) < skew.min_hot_rows, F.lit(True))).select(
        F.col(key).alias("_found"),
        nought.alias("_found_lane"),
        F.struct(*values).alias("_cold"),
    )
    joined = left.join(
        right,
        (F.col("_find") == F.col("_found")) & (F.col("_lane") == F.col("_found_lane")),
        "left",
    )
    # struct first, field second: one coalesce decides for all fields.
    return (
        joined.withColumn("_hit", F.coalesce("_hot", "_cold"))
        .select(*rows.columns, *[F.col(f"_hit.{v}").alias(v) for v in values])
    )


def running_offsets(
    counts: DataFrame, group: list[str], bucket: str, sums: dict[str, str]
) -> DataFrame:
    """Sums of all earlier buckets of a group, for frames of a few buckets per group."""
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns(
        {out: F.coalesce(F.sum(src).over(before), F.lit(0)) for out, src in sums.items()}
    )


def in_global_order(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``_at``, a number that grows with ``order``, and ``_cell``, the range it lies in; written.

    Rows are dealt into ranges and sorted inside of them.  How many ranges there are follows from the size
    of the data.  Ranges and places are written down together with the rows: whatever is read later,
    also after a lost executor, sees the same values in the same places.  ``_at`` has no gaps in a cell and
    cells follow one another; a total ``order`` makes it repeatable.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(placed.withColumn("_at", F.monotonically_increasing_id()), name).withColumn(
        "_cell", F.shiftright("_at", 33)
    )


def value_ladder(values: DataFrame) -> DataFrame:
    """Distinct values in global order, without a global sort in one task.

    Input: rows (metric, value) without NULLs, for a handful of metrics.  Output, one row per
    metric and distinct value: ``copies``, ``below`` (rows with a smaller value) and ``total``.
    Copies of one value are one row before the values are dealt into ranges, so ties cannot overload
    a range.  Range totals, one row per metric and range, give the offsets.
    """
    distinct = values.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("copies"))
    placed = in_global_order(distinct, [F.col("metric"), F.col("value")], "value_ladder")
    cells = placed.groupBy("metric", "_cell").agg(F.sum("copies").alias("_in_cell"))
    offsets = running_offsets(cells, ["metric"], "_cell", {"_before_cell": "_in_cell"}).select(
        "metric",
        "_cell",
        "_before_cell",
        F.sum("_in_cell").over(Window.partitionBy("metric")).alias("total"),
    )
    inside = (
        Window.partitionBy("metric", "_cell")
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        placed.join(offsets, ["metric", "_cell"])
        .withColumn("below", F.col("_before_cell") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .select("metric", "value", "copies", "below", "total")
    )


def quantiles(ladder: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact quantiles with linear interpolation, read off a value ladder.

    ``wanted`` holds (metric, name, q); the result adds ``quantile``.  Only the two neighbouring
    order statistics of a quantile leave the ladder.
    """
    asked = ladder.join(F.broadcast(wanted), "metric")
    spot = F.col("q") * (F.col("total") - 1)
    low, high = F.floor(spot), F.ceil(spot)
    covers = lambda at: (F.col("below") <= at) & (at < F.col("below") + F.col("copies"))
    return (
        asked.where(covers(low) | covers(high))
        .groupBy("metric", "name", "q")
        .agg(
            F.max(F.when(covers(low), F.col("value"))).alias("_v0"),
            F.max(F.when(covers(high), F.col("value"))).alias("_v1"),
            F.max(spot - low).alias("_part"),
        )
        .select(
            "metric",
            "name",
            "q",
            (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_part")).alias("quantile"),
        )
    )


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Global row number over a total ``order`` without a window over the whole frame."""
    placed = in_global_order(rows, order, "numbered")
    # One row per range; they share the constant group.
    cells = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_in_cell"), F.min("_at").alias("_first")).withColumn("_all", F.lit(0))
    offsets = running_offsets(cells, ["_all"], "_cell", {"_before": "_in_cell"}).select("_cell", "_first", "_before")
    return placed.join(offsets, "_cell").select(
        (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name), *rows.columns
    )
