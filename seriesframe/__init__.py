"""Strictly ordered numeric time series on Spark DataFrames: scans, lookups, aggregates, windows, chart envelopes and a snapshot store."""

from seriesframe.errors import (
    BatchError,
    BufferTooSmall,
    IntegrityError,
    InvalidArguments,
    NotIncreasing,
    SeriesError,
    SeriesNotFound,
    StaleHandle,
    StoreError,
    WriterBusy,
    WriterPoisoned,
)
from seriesframe.types import Aggregate, LookupMode, Point

__all__ = ["Aggregate", "BatchError", "BufferTooSmall", "IntegrityError", "InvalidArguments", "LookupMode", "NotIncreasing", "Point", "SeriesError", "SeriesNotFound", "StaleHandle", "StoreError", "WriterBusy", "WriterPoisoned"]
