"""Points from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points_from(rows: DataFrame, *, series: str, ts: str, value: str) -> DataFrame:
    """(series, ts, value) of rows; a time column turns into microseconds since 1970 in UTC, an integer stays as it is."""
    kind = rows.schema[ts].dataType.typeName()
    column = F.col(ts)
    if kind == "timestamp_ntz":
        column = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)")
    elif kind == "timestamp":
        column = F.unix_micros(column)
    return rows.select(F.col(series).cast("string").alias("series"), column.cast("long").alias("ts"), F.col(value).cast("double").alias("value"))


def points_from_events(events: DataFrame) -> DataFrame:
    return points_from(events, series="event_type", ts="ts", value="value")
