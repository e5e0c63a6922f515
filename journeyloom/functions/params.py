"""Typed reads from the repeated key/value parameter array of an event.

One pass over the array per parameter, inside the row: nothing is exploded or shuffled.  Lookups
through parallel key and value arrays (``array_position`` and ``get``) were measured and are
slower, because they copy the arrays for every parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from journeyloom.functions.text import double_text


def _as_long(v: Column) -> Column:
    return F.coalesce(v["int_value"], v["string_value"].try_cast("bigint"))


def _as_double(v: Column) -> Column:
    return F.coalesce(
        v["double_value"],
        v["float_value"].cast("double"),
        v["int_value"].cast("double"),
        v["string_value"].try_cast("double"),
    )


def _as_text(v: Column) -> Column:
    return F.coalesce(
        v["string_value"],
        v["int_value"].cast("string"),
        double_text(v["double_value"]),
        double_text(v["float_value"]),
    )


def _as_sample(v: Column) -> Column:
    return F.coalesce(
        v["string_value"],
        v["int_value"].cast("string"),
        double_text(v["float_value"]),
        double_text(v["double_value"]),
    )


def _string_slot(v: Column) -> Column:
    return v["string_value"]


# How a value struct becomes one typed value.
READERS = {
    "long": _as_long,
    "double": _as_double,
    "text": _as_text,
    "sample": _as_sample,
    "string": _string_slot,
}


@dataclass(frozen=True)
class Param:
    column: str
    key: str
    kind: str


# The parameters of the event contract and how each one is typed.
EVENT_PARAMS = (
    Param("ga_session_id", "ga_session_id", "long"),
    Param("ga_session_number", "ga_session_number", "long"),
    Param("session_engaged_raw", "session_engaged", "text"),
    Param("engagement_time_msec", "engagement_time_msec", "double"),
    Param("engaged_session_event", "engaged_session_event", "long"),
    Param("debug_mode", "debug_mode", "long"),
    Param("event_source", "source", "string"),
    Param("event_medium", "medium", "string"),
    Param("event_campaign", "campaign", "string"),
    Param("page_location", "page_location", "string"),
    Param("page_title", "page_title", "string"),
    Param("page_referrer", "page_referrer", "string"),
    Param("currency", "currency", "string"),
    Param("event_value", "value", "double"),
    Param("gclid", "gclid", "text"),
    Param("gclsrc", "gclsrc", "text"),
    Param("dclid", "dclid", "text"),
)


def first_value(params: Column, key: str, kind: str) -> Column:
    """Value at the first occurrence of ``key``, NULL when the key is absent."""
    return READERS[kind](F.get(F.filter(params, lambda p: p["key"] == key)["value"], F.lit(0)))


def largest_value(params: Column, key: str, kind: str) -> Column:
    """Largest value over all occurrences of ``key``; entries of other keys become NULL."""
    return F.array_max(F.transform(params, lambda p: F.when(p["key"] == key, READERS[kind](p["value"]))))
