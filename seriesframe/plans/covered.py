"""Aggregates from page summaries: pages inside a range answer from their summary, and only pages at its ends are read.

A rewrite at the DataFrame level: a union of summaries of covered pages and of summaries made from the points of boundary
pages, merged by one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesframe.functions.aggregates import summary_exprs
from seriesframe.functions.scalars import bucket_of
from seriesframe.operators.aggregate import merge_summaries, summary_as_aggregate, windows
from seriesframe.operators.scan import in_range, of_series
from seriesframe.types import check_long

_FIELDS = ["series", "ts_min", "ts_max", "point_count", "v_min", "v_max", "v_sum", "v_first", "v_last"]


def in_runs(pages: DataFrame) -> DataFrame:
    """Pages of one series with the bounds (low, high) of their run: pages that share a timestamp, as equal ones can lie on both sides of a page's end.

    Which points of a shared timestamp a page has can't be told by time, so a run is taken from summaries or from points as a whole.
    """
    order = W.orderBy("ts_min", "ts_max")
    before = F.max("ts_max").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = pages.withColumn("_starts", F.when(before >= F.col("ts_min"), 0).otherwise(1)).withColumn("_run", F.sum("_starts").over(order.rowsBetween(W.unboundedPreceding, 0)))
    own = W.partitionBy("_run")
    return runs.withColumn("low", F.min("ts_min").over(own)).withColumn("high", F.max("ts_max").over(own)).drop("_starts", "_run")


def covered_aggregate(points: DataFrame, pages: DataFrame, series: str, start: int, end: int) -> DataFrame:
    """The six aggregates of the range, from pages (series, page_no, summary) and points (series, ts, value)."""
    check_long("start", start), check_long("end", end)
    own = in_runs(of_series(pages, series).where((F.col("ts_max") >= start) & (F.col("ts_min") <= end)))
    inside = own.where((F.col("low") >= start) & (F.col("high") <= end)).select(*_FIELDS)
    # a series' runs don't overlap: two at most cross the ends of the range
    cut = [(r.low, r.high) for r in own.where((F.col("low") < start) | (F.col("high") > end)).select("low", "high").distinct().collect()] if end >= start else []
    rows = of_series(points, series).where(F.lit(False))
    for low, high in cut:
        rows = rows.unionByName(of_series(points, series).where(in_range(max(low, start), min(high, end))))
    edges = rows.groupBy("series").agg(*summary_exprs()).select(*_FIELDS)
    merged = merge_summaries(inside.where(F.lit(end >= start)).unionByName(edges))
    return summary_as_aggregate(merged)


#: Time ranges of pages that are put into one pushed filter, at most; with more, all points from the first to the last are read.
RANGES = 200


def covered_windows(points: DataFrame, pages: DataFrame, series: str, start: int, end: int, resolution: int, capacity: int | None = None) -> DataFrame:
    """Dense windows (see windows): a page that lies in one window answers from its summary, and points are read of the others only."""

    def reduce(rows: DataFrame, last: int) -> DataFrame:
        bucket = lambda c: bucket_of(c, start, resolution, last - start)
        own = in_runs(of_series(pages, series).where((F.col("ts_max") >= start) & (F.col("ts_min") <= last)))
        inside = (F.col("low") >= start) & (F.col("high") <= last)
        whole = own.where(inside).withColumn("bucket", bucket("low")).withColumn("until", bucket("high"))
        cut = own.where(~inside).select("low", "high").unionByName(whole.where("bucket <> until").select("low", "high")).distinct()
        spans = [(r.low, r.high) for r in cut.limit(RANGES + 1).collect()]
        if len(spans) > RANGES:  # windows finer than pages: summaries are of little use
            rows, whole = rows.where(in_range(start, last)), whole.where(F.lit(False))
        else:
            held = F.lit(False)
            for low, high in spans:
                held = held | in_range(max(low, start), min(high, last))
            rows = rows.where(held)
        fields = [f for f in _FIELDS if f != "series"]
        edges = rows.withColumn("bucket", bucket("ts")).groupBy("bucket").agg(*summary_exprs()).select("bucket", *fields)
        return summary_as_aggregate(merge_summaries(whole.where("bucket = until").select("bucket", *fields).unionByName(edges), "bucket"), "bucket")

    return windows(points, series, start, end, resolution, capacity, reduce=reduce)
