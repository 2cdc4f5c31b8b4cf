"""The six aggregates of a series and their mergeable summaries, as built-in expressions (partial and final aggregation come from Spark)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesframe.functions.scalars import NAN, number

FIELDS = ("count", "minimum", "maximum", "sum", "first", "last")


def aggregate_exprs(ts: str = "ts", value: str = "value") -> list[Column]:
    """count (NaN included), minimum, maximum and sum (NaN left out), first and last by time (NaN as it is)."""
    v = number(F.col(value))
    return [
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.min(v), F.lit(NAN)).alias("minimum"),
        F.coalesce(F.max(v), F.lit(NAN)).alias("maximum"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
        F.coalesce(F.min_by(value, ts), F.lit(NAN)).alias("first"),
        F.coalesce(F.max_by(value, ts), F.lit(NAN)).alias("last"),
    ]


def empty_defaults(prefix: str = "") -> list[Column]:
    """The aggregates of an empty range where an outer join left nulls."""
    empty = {"count": F.lit(0).cast("long"), "sum": F.lit(0.0)}
    return [F.coalesce(F.col(prefix + f), empty.get(f, F.lit(NAN))).alias(f) for f in FIELDS]


def summary_exprs(ts: str = "ts", value: str = "value") -> list[Column]:
    """What a page, a series or any time range is summarised by."""
    v = number(F.col(value))
    return [
        F.min(ts).alias("ts_min"),
        F.max(ts).alias("ts_max"),
        F.count(F.lit(1)).alias("point_count"),
        F.coalesce(F.min(v), F.lit(NAN)).alias("v_min"),
        F.coalesce(F.max(v), F.lit(NAN)).alias("v_max"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("v_sum"),
        F.min_by(value, ts).alias("v_first"),
        F.max_by(value, ts).alias("v_last"),
    ]


def merge_exprs() -> list[Column]:
    """The summary of the union of disjoint ranges, from their summaries."""
    return [
        F.min("ts_min").alias("ts_min"),
        F.max("ts_max").alias("ts_max"),
        F.sum("point_count").alias("point_count"),
        F.coalesce(F.min(number(F.col("v_min"))), F.lit(NAN)).alias("v_min"),
        F.coalesce(F.max(number(F.col("v_max"))), F.lit(NAN)).alias("v_max"),
        F.sum("v_sum").alias("v_sum"),
        F.min_by("v_first", "ts_min").alias("v_first"),
        F.max_by("v_last", "ts_max").alias("v_last"),
    ]


def as_aggregate() -> list[Column]:
    """A summary's columns as the six aggregates."""
    names = ("point_count", "v_min", "v_max", "v_sum", "v_first", "v_last")
    empty = {"count": F.lit(0).cast("long"), "sum": F.lit(0.0)}
    return [F.coalesce(F.col(n), empty.get(f, F.lit(NAN))).alias(f) for n, f in zip(names, FIELDS, strict=True)]
