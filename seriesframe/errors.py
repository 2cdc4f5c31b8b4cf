"""Errors, each with a stable status number."""

from __future__ import annotations


class SeriesError(Exception):
    status = -1


class InvalidArguments(SeriesError, ValueError):
    status = -2


class BatchError(InvalidArguments):
    """Columns of different lengths, or a batch that can't be read as points."""

    status = -3


class NotIncreasing(BatchError):
    """Timestamps that aren't strictly increasing, within a batch or against what is stored."""

    status = -4


class SeriesNotFound(InvalidArguments, KeyError):
    """A name that no published generation has."""

    status = -5


class StaleHandle(SeriesError):
    """A handle or iterator of an earlier snapshot."""

    status = -6


class WriterBusy(SeriesError):
    """Another writer holds the store."""

    status = -7


class WriterPoisoned(SeriesError):
    """An earlier failure: nothing more is published by this writer."""

    status = -8


class StoreError(SeriesError, OSError):
    status = -9


class IntegrityError(StoreError):
    """Stored data that don't match their manifest."""

    status = -10


class PageNotFound(StoreError):
    """No page covers the timestamp."""

    status = -11


class BufferTooSmall(SeriesError):
    """A result with more rows than its caller gave room for."""

    status = 1

    def __init__(self, required: int):
        super().__init__(f"{required} rows are needed")
        self.required = required
