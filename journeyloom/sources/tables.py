"""Reading events and marts, the schema contract, small constant relations and export."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from journeyloom.functions.calendar import weekly_dates
from journeyloom.sources.publish import read_published

# Leaf paths the staging views read.
REQUIRED_PATHS = [
    "event_date",
    "event_timestamp",
    "event_name",
    "user_pseudo_id",
    "event_bundle_sequence_id",
    "event_server_timestamp_offset",
    "platform",
    "event_params.key",
    "event_params.value.string_value",
    "event_params.value.int_value",
    "event_params.value.float_value",
    "event_params.value.double_value",
    "traffic_source.name",
    "traffic_source.medium",
    "traffic_source.source",
    "ecommerce.transaction_id",
    "ecommerce.purchase_revenue",
    "ecommerce.purchase_revenue_in_usd",
    "ecommerce.total_item_quantity",
    "items.item_id",
    "items.item_name",
    "items.item_brand",
    "items.item_variant",
    "items.item_category",
    "items.price",
    "items.price_in_usd",
    "items.quantity",
    "items.item_revenue",
    "items.item_revenue_in_usd",
    "geo.country",
    "geo.region",
    "geo.city",
    "device.category",
    "device.operating_system",
    "device.web_info.browser",
    "privacy_info.analytics_storage",
    "privacy_info.ads_storage",
    "privacy_info.uses_transient_token",
]


def write_events(events: DataFrame, path: str) -> None:
    """Events as a dataset partitioned by ``event_date``, in place of what was there.

    Writing by day sorts the events of a task by day.  They are rebalanced by day first: small days share a
    task and a large one is cut over many, so a task sorts a piece of the advisory size however many events
    there are, and a day has few files.
    """
    events.hint("rebalance", "event_date").write.mode("overwrite").partitionBy("event_date").parquet(path)


def read_events(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Events of the days start..end (yyyyMMdd), from a dataset partitioned by ``event_date``.

    The bound is a partition filter: folders of other days are never listed for reading.
    """
    events = spark.read.parquet(path)
    day = F.col("event_date").cast("string")
    return events.where(day.between(start, end)).withColumn("event_date", day)


def mart_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def read_mart(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version of a published table."""
    return read_published(spark, mart_path(root, name))


def register_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def const_relation(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A relation of literals, small by construction."""
    return spark.createDataFrame(rows, schema)


def week_spine(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    return spark.range(1).select(F.explode(weekly_dates(start, end)).alias("week_start_date"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _leaves(data_type: T.DataType, path: str):
    if isinstance(data_type, T.ArrayType):
        yield from _leaves(data_type.elementType, path)
    elif isinstance(data_type, T.StructType):
        for f in data_type.fields:
            yield from _leaves(f.dataType, f"{path}.{f.name}" if path else f.name)
    else:
        yield path, data_type.simpleString()


def _filled(data_type: T.DataType, value: Column, steps: list[str]) -> Column:
    """Does the row hold at least one value at this path?  Repeated fields: in any element."""
    if isinstance(data_type, T.ArrayType):
        element = data_type.elementType
        return F.coalesce(F.exists(value, lambda e: _filled(element, e, steps)), F.lit(False))
    if not steps:
        return value.isNotNull()
    return _filled(data_type[steps[0]].dataType, value[steps[0]], steps[1:])


def verify_schema(
    shards: list[DataFrame], required: list[str] = REQUIRED_PATHS, count_rows: bool = False
) -> DataFrame:
    """Compare the required leaf paths with those the shards have; missing ones come first.

    ``count_rows`` adds how many rows of all shards hold a value at the path.
    """
    spark = shards[0].sparkSession
    found = [(p, t) for shard in shards for p, t in _leaves(shard.schema, "")]
    available = (
        spark.createDataFrame(found, "field_path string, data_type string")
        .groupBy("field_path")
        .agg(F.any_value("data_type").alias("data_type"))
    )
    wanted = spark.createDataFrame([(p,) for p in required], "required_field_path string")
    status = wanted.join(
        F.broadcast(available), F.col("required_field_path") == F.col("field_path"), "left"
    ).select(
        "required_field_path",
        "data_type",
        F.when(F.col("field_path").isNull(), "MISSING").otherwise("AVAILABLE").alias("schema_status"),
    )
    if count_rows:
        counted = None
        for shard in shards:
            have = [p for p in required if p in dict(_leaves(shard.schema, ""))]
            one_row = shard.agg(
                *[
                    F.count_if(
                        _filled(shard.schema[p.split(".")[0]].dataType, F.col(p.split(".")[0]), p.split(".")[1:])
                    ).alias(p.replace(".", "/"))
                    for p in have
                ]
            )
            long = one_row.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(F.lit(p).alias("_path"), F.col(p.replace(".", "/")).alias("_rows"))
                            for p in have
                        ]
                    )
                )
            )
            counted = long if counted is None else counted.unionByName(long)
        totals = counted.groupBy("_path").agg(F.sum("_rows").alias("populated_rows"))
        status = status.join(totals, F.col("required_field_path") == F.col("_path"), "left").select(
            *status.columns, F.coalesce("populated_rows", F.lit(0)).alias("populated_rows")
        )
    return status.orderBy(F.desc("schema_status"), "required_field_path")
