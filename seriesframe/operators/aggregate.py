"""Range aggregates, dense windows and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesframe.errors import InvalidArguments
from seriesframe.functions.aggregates import aggregate_exprs, as_aggregate, empty_defaults, merge_exprs, summary_exprs
from seriesframe.functions.scalars import bucket_of, wide
from seriesframe.operators.chunks import CHUNK_POINTS, with_places
from seriesframe.operators.scan import in_range, of_series, range_scan
from seriesframe.types import PAGE_POINTS, check_long, check_ulong


def range_aggregate(points: DataFrame, series: str | None, start: int, end: int) -> DataFrame:
    """One row with the six aggregates (an empty range: count 0, sum 0, the rest NaN)."""
    return range_scan(points, series, start, end, ordered=False).agg(*aggregate_exprs())


def aggregate_by_series(points: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """A row for each series that has a point in the range."""
    rows = points if start is None else points.where(in_range(start, end))
    return rows.groupBy("series").agg(*aggregate_exprs())


def windows_required(start: int, end: int, resolution: int) -> int:
    """How many windows the range has."""
    check_long("start", start), check_long("end", end)
    if check_ulong("resolution", resolution) == 0:
        raise InvalidArguments("resolution is 0")
    required = 0 if end < start else (end - start) // resolution + 1
    if required > 2**63 - 1:
        raise InvalidArguments("too many windows")
    return required


def windows(points: DataFrame, series: str | list[str] | None, start: int, end: int, resolution: int, capacity: int | None = None, *, reduce=None) -> DataFrame:
    """Dense windows of `resolution`, aligned to start; the last ends at end.  With capacity, the first so many.

    series: one name (its column is left out), several names, or None for every series with a point in the range.
    Points are reduced to their windows before the shuffle, and empty windows come from a generated range.  reduce, if given, makes the
    windows' aggregates from the points up to the last window's end (see plans.covered).
    """
    required = windows_required(start, end, resolution)
    shown = required if capacity is None else min(required, capacity)
    spark = points.sparkSession
    one = isinstance(series, str)
    last = min(end, start + shown * resolution - 1) if shown else start - 1
    rows = of_series(points, series) if one or series is None else points.where(F.col("series").isin(series))
    keys = [] if one else ["series"]
    if shown and reduce is not None:
        found = reduce(rows, last)
    elif shown:
        rows = rows.where(in_range(start, last)).withColumn("bucket", bucket_of("ts", start, resolution, last - start))
    else:
        rows = rows.where(F.lit(False)).withColumn("bucket", F.lit(0).cast("long"))
    if not shown or reduce is None:
        found = rows.groupBy(*keys, "bucket").agg(*aggregate_exprs())
    grid = spark.range(shown).withColumnRenamed("id", "bucket")
    if series is None:
        grid = rows.select("series").distinct().crossJoin(grid)  # the result itself: all windows of all series
    elif not one:
        grid = spark.createDataFrame([(s,) for s in series], "series string").crossJoin(grid)
    at = F.col("bucket").cast("decimal(20,0)") * wide(resolution) + wide(start)
    bounds = [at.cast("decimal(38,0)").cast("long").alias("window_start"), F.least(at + wide(resolution) - 1, wide(end)).cast("decimal(38,0)").cast("long").alias("window_end")]
    return grid.join(found, [*keys, "bucket"], "left").select(*keys, "bucket", *bounds, *empty_defaults())


def sparse_windows(points: DataFrame, start: int, end: int, resolution: int) -> DataFrame:
    """Windows of all series that hold a point: series, bucket and the six aggregates."""
    required = windows_required(start, end, resolution)
    if not required:
        return points.where(F.lit(False)).groupBy("series", F.lit(0).cast("long").alias("bucket")).agg(*aggregate_exprs())
    rows = points.where(in_range(start, end)).withColumn("bucket", bucket_of("ts", start, resolution, end - start))
    return rows.groupBy("series", "bucket").agg(*aggregate_exprs())


def catalog_summary(points: DataFrame) -> DataFrame:
    """A summary of each series."""
    return points.groupBy("series").agg(*summary_exprs())


def page_summaries(points: DataFrame, page_points: int = PAGE_POINTS, *, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """A summary of each run of page_points points of a series (page_no from 0)."""
    placed = with_places(points, ["series"], "ts", "page_no", chunk_points)
    return placed.withColumn("page_no", F.expr(f"page_no div {int(page_points)}")).groupBy("series", "page_no").agg(*summary_exprs())


def merge_summaries(summaries: DataFrame, *keys: str) -> DataFrame:
    """One summary of all, or for each value of keys."""
    return summaries.groupBy(*keys).agg(*merge_exprs())


def summary_as_aggregate(summaries: DataFrame, *keep: str) -> DataFrame:
    return summaries.select(*keep, *as_aggregate())
