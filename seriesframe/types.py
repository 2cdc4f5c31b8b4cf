"""Schemas and small value types."""

from __future__ import annotations

from enum import IntEnum
from typing import NamedTuple

from pyspark.sql import types as T

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1
ULONG_MAX = 2**64 - 1
#: Points of one page, at most: what a 64 KiB page of 16-byte points holds besides its 128-byte header.
PAGE_POINTS = (64 * 1024 - 128) // 16

POINTS = T.StructType([T.StructField("series", T.StringType(), False), T.StructField("ts", T.LongType(), False), T.StructField("value", T.DoubleType(), False)])
#: The six fields of an aggregate and their types.
AGGREGATE = "count long, minimum double, maximum double, sum double, first double, last double"
SUMMARY = "ts_min long, ts_max long, point_count long, v_min double, v_max double, v_sum double, v_first double, v_last double"


class LookupMode(IntEnum):
    EXACT = 0
    PREDECESSOR = 1
    SUCCESSOR = 2
    NEAREST = 3


class Point(NamedTuple):
    ts: int
    value: float


class Aggregate(NamedTuple):
    count: int
    minimum: float
    maximum: float
    sum: float
    first: float
    last: float


def check_long(name: str, value) -> int:
    """value as a signed 64-bit integer; booleans and other types are refused."""
    from seriesframe.errors import InvalidArguments

    if isinstance(value, bool) or not isinstance(value, int):
        raise InvalidArguments(f"{name} must be an integer, not {type(value).__name__}")
    if not LONG_MIN <= value <= LONG_MAX:
        raise InvalidArguments(f"{name} is outside the 64-bit range")
    return value


def check_ulong(name: str, value) -> int:
    from seriesframe.errors import InvalidArguments

    if isinstance(value, bool) or not isinstance(value, int):
        raise InvalidArguments(f"{name} must be an integer, not {type(value).__name__}")
    if not 0 <= value <= ULONG_MAX:
        raise InvalidArguments(f"{name} is outside the unsigned 64-bit range")
    return value


def check_name(name) -> str:
    from seriesframe.errors import InvalidArguments

    if not isinstance(name, str):
        raise InvalidArguments("a series name must be text")
    if not 1 <= len(name.encode("utf-8")) <= 65535:
        raise InvalidArguments("a series name has 1 to 65535 bytes")
    return name
