"""Inclusive range scans, counts, prefixes and batches over a DataFrame of points (series, ts, value).

Bounds are inclusive; an end before the start is an empty range.  Filters are plain comparisons of stored columns, so that they
reach the Parquet scan (partition and row-group pruning); only the columns in use are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesframe.errors import InvalidArguments
from seriesframe.operators.chunks import CHUNK_POINTS, with_places, with_previous
from seriesframe.types import LONG_MAX, check_long


def in_range(start: int, end: int, ts: str = "ts") -> Column:
    check_long("start", start), check_long("end", end)
    if end < start:
        return F.lit(False)
    return (F.col(ts) >= F.lit(start)) & (F.col(ts) <= F.lit(end))


def of_series(points: DataFrame, series: str | None) -> DataFrame:
    return points if series is None else points.where(F.col("series") == F.lit(series))


def range_scan(points: DataFrame, series: str | None, start: int, end: int, *, ordered: bool = True) -> DataFrame:
    """Points of one series (None: of all) in the range, by time."""
    rows = of_series(points, series).where(in_range(start, end))
    return rows.orderBy(*(["ts"] if series is not None else ["series", "ts"])) if ordered else rows


def range_count(points: DataFrame, series: str | None, start: int, end: int) -> DataFrame:
    """One row with the number of points; values aren't read."""
    return range_scan(points, series, start, end, ordered=False).agg(F.count(F.lit(1)).alias("count"))


def point_get(points: DataFrame, series: str, ts: int) -> DataFrame:
    return range_scan(points, series, ts, ts, ordered=False)


def range_prefix(points: DataFrame, series: str, start: int, end: int, capacity: int) -> DataFrame:
    """The first `capacity` points (top-k: each task keeps as many at most); range_count says how many there are in all."""
    if capacity < 0:
        raise InvalidArguments("capacity is negative")
    return range_scan(points, series, start, end).limit(capacity)


def latest_timestamp(points: DataFrame, series: str | None = None) -> DataFrame:
    """series, ts: the last timestamp of each series."""
    return of_series(points, series).groupBy("series").agg(F.max("ts").alias("ts"))


def cursor_batches(points: DataFrame, series: str, start: int, end: int, size: int, *, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """Points with the number of the batch that a cursor of that size would return them in."""
    if size <= 0:
        raise InvalidArguments("a cursor's batch has one point at least")
    rows = range_scan(points, series, start, end, ordered=False)
    return with_places(rows, ["series"], "ts", "batch", chunk_points).withColumn("batch", F.expr(f"batch div {int(size)}"))


def iterate(points: DataFrame, series: str, start: int, end: int, size: int) -> Iterator[list[tuple[int, float]]]:
    """Batches by time, of bounded size; partitions are fetched one after another."""
    if size <= 0:
        raise InvalidArguments("a cursor's batch has one point at least")
    batch: list[tuple[int, float]] = []
    for row in range_scan(points, series, start, end).select("ts", "value").toLocalIterator(prefetchPartitions=True):
        batch.append((row.ts, row.value))
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def place_after(place: int | tuple[int, int], rows: list[tuple[int, float]], following: int) -> int | tuple[int, int]:
    """Where a stateless cursor goes on after rows (read from place on) if the next point is at `following`: past the last time, or within it."""
    last = rows[-1][0]
    if following > last:
        return last + 1
    n = sum(t == last for t, _ in rows)
    return last, n + (place[1] if isinstance(place, tuple) and place[0] == last else 0)


def next_page(points: DataFrame, series: str, next_ts: int | tuple[int, int] | None, end: int, size: int, ties: Sequence[str] = ()) -> tuple[list[tuple[int, float]], int | tuple[int, int] | None]:
    """A stateless cursor: up to `size` points from next_ts on, and where to go on (None: at the end).

    That is a time, or a time and a number if a batch ends among equal timestamps: of the points at that time so many come before.  Points at one
    time are taken by value (and the columns `ties`), so that every call sees the same order.
    """
    if size <= 0:
        raise InvalidArguments("a cursor's batch has one point at least")
    at, skip = next_ts if isinstance(next_ts, tuple) else (next_ts, 0)
    if at is None or end < at:
        return [], None
    rows = range_scan(points, series, at, end, ordered=False).orderBy("ts", "value", F.col("value").cast("string"), *ties)  # as text, zeros differ by sign
    rows = [(r.ts, r.value) for r in rows.select("ts", "value").limit(skip + size + 1).offset(skip).collect()]
    rows, following = rows[:size], rows[size:]
    if following:
        return rows, place_after(next_ts, rows, following[0][0])
    more = len(rows) == size and rows[-1][0] < min(end, LONG_MAX)
    return rows, rows[-1][0] + 1 if more else None


def order_violations(rows: DataFrame, *, series: str | list[str], pos: str | list[str], ts: str, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """Rows whose timestamp isn't over the one before in input order, with that one as previous_ts."""
    keys = [series] if isinstance(series, str) else series
    order = [pos] if isinstance(pos, str) else pos
    return with_previous(rows, keys, order, ts, "previous_ts", chunk_points).where(F.col("previous_ts") >= F.col(ts))
