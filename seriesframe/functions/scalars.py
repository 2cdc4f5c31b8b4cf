"""Scalar functions on timestamps and values."""

from __future__ import annotations

import struct
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def distance(a: Column, b: Column) -> Column:
    """|a - b| over the whole 64-bit domain, as DECIMAL."""
    return F.abs(a.cast("decimal(20,0)") - b.cast("decimal(20,0)"))


def wide(value: int) -> Column:
    """An integer of up to 64 bits, signed or not, as DECIMAL(20, 0)."""
    return F.lit(Decimal(value)).cast("decimal(20,0)")


def number(value: Column) -> Column:
    """value, or null where it is NaN."""
    return F.when(~F.isnan(value), value)


def bucket_of(ts: str, start: int, resolution: int, span: int) -> Column:
    """(ts - start) div resolution for ts >= start; `span` is the largest ts - start that can occur."""
    if resolution > span:
        return F.lit(0).cast("long")
    if span <= 2**63 - 1:
        return F.expr(f"(`{ts}` - {start if start >= 0 else f'({start + 1}L - 1L)'}{'L' if start >= 0 else ''}) div {resolution}L")
    offset = F.col(ts).cast("decimal(20,0)") - wide(start)
    size = wide(resolution)
    # the remainder goes first: a decimal quotient would be rounded
    return ((offset - offset % size) / size).cast("decimal(20,0)").cast("long")


def encode_record(ts: int, value: float) -> bytes:
    """A point as 16 little-endian bytes."""
    return struct.pack("<qd", ts, value)


def plain_number(value: float) -> str:
    """The shortest decimal form without an exponent: 100, 0.1, every digit of a subnormal; nan, inf and -inf."""
    if value != value:
        return "nan"
    if value in (float("inf"), float("-inf")):
        return "inf" if value > 0 else "-inf"
    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text
