"""Chunks of long series: runs of consecutive rows, so that no task needs to hold a whole series.

Cuts are taken at quantiles of each long series, so outliers and dense stretches don't matter.  They need not be values of the series:
a row's chunk is the number of cuts that aren't over it, which is monotonic and the same whenever it is computed.  Equal values share a chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a chunk, about.
CHUNK_POINTS = 1_000_000
#: Chunks of one series at most; those of a longer series get longer in proportion.
MOST_CHUNKS = 10_000
#: Cuts up to which their table is broadcast (8 bytes each).
BROADCAST_CUTS = 4_000_000

_CUTS, _CHUNK, _ROWS, _BEFORE, _KEY = "__cuts", "__chunk", "__rows", "__before", "__key"


@dataclass(frozen=True)
class Cuts:
    """The cuts of the long series (keys and a sorted array), and the bits of the largest number of cuts."""

    table: DataFrame
    bits: int


def chunk_cuts(rows: DataFrame, keys: list[str], by: str, chunk_points: int = CHUNK_POINTS) -> Cuts | None:
    """Where to cut the series (keys) of rows along a numeric column; None if no series is longer than a chunk."""
    own = F.ceil(F.col(_ROWS) / chunk_points)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(_ROWS))
    most, total = sizes.where(F.col(_ROWS) > chunk_points).agg(F.max(_ROWS), F.sum(own)).first()
    if most is None:
        return None
    m = min(MOST_CHUNKS, -(-most // chunk_points))
    shares = F.percentile_approx(by, [k / m for k in range(1, m)], max(10_000, 10 * m))
    step = F.greatest(F.lit(1), F.floor(F.lit(m) / own))  # a shorter series takes every so manieth cut
    table = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(_ROWS), shares.alias(_CUTS)).where(F.col(_ROWS) > chunk_points)
    table = table.select(*keys, F.array_distinct(F.filter(_CUTS, lambda _, i: (i + 1) % step == 0)).alias(_CUTS))
    return Cuts(F.broadcast(table) if 2 * total <= BROADCAST_CUTS else table, m.bit_length())


def numbered(rows: DataFrame, cuts: Cuts | None, keys: list[str], by: str, name: str) -> DataFrame:
    """rows with the number of their chunk, by binary search among the cuts of their series."""
    if cuts is None:
        return rows.withColumn(name, F.lit(0))
    steps = F.array(*[F.lit(2**k) for k in reversed(range(cuts.bits))])
    chunk = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(_CUTS, at + step - 1) <= F.col(by), at + step).otherwise(at))
    return rows.join(cuts.table, keys, "left").select(*rows.columns, chunk.alias(name))


def _with_chunk_table(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined to a table of their chunks; null keys match."""
    names = [*keys, _CHUNK]
    right = table.select(*[F.col(c).alias(f"{_KEY}{i}") for i, c in enumerate(names)], *[c for c in table.columns if c not in names])
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"{_KEY}{i}"))
    return rows.join(right, same).drop(*[f"{_KEY}{i}" for i in range(len(names))])


def with_places(rows: DataFrame, keys: list[str], by: str, name: str, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """rows with their place (from 0) in their series: places in chunks, and the rows of the chunks before."""
    rows = rows.drop(name)
    cuts = chunk_cuts(rows, keys, by, chunk_points)
    if cuts is None:
        return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(by)).cast("long") - 1)
    chunked = numbered(rows, cuts, keys, by, _CHUNK)
    earlier = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    counts = chunked.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias(_ROWS))
    counts = counts.select(*keys, _CHUNK, F.coalesce(F.sum(_ROWS).over(earlier), F.lit(0)).alias(_BEFORE))
    within = F.row_number().over(W.partitionBy(*keys, _CHUNK).orderBy(by)) - 1
    placed = _with_chunk_table(chunked.withColumn(_ROWS, within), counts, keys)
    return placed.select(*rows.columns, (F.col(_BEFORE) + F.col(_ROWS)).cast("long").alias(name))


def with_previous(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """rows with `value` of the row before in their series, in the given order (long series are cut along its first column, if that is a number)."""
    rows = rows.drop(name)
    numeric = dict(rows.dtypes)[order[0]] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    cuts = chunk_cuts(rows, keys, order[0], chunk_points) if numeric else None
    if cuts is None:
        return rows.withColumn(name, F.lag(value).over(W.partitionBy(*keys).orderBy(*order)))
    chunked = numbered(rows, cuts, keys, order[0], _CHUNK)
    ends = chunked.groupBy(*keys, _CHUNK).agg(F.max_by(F.struct(value), F.struct(*order)).alias(_BEFORE))
    ends = ends.withColumn(_BEFORE, F.lag(_BEFORE).over(W.partitionBy(*keys).orderBy(_CHUNK)))
    # a struct, so that a null value before isn't taken for the start of a chunk
    inside: Column = F.lag(F.struct(value)).over(W.partitionBy(*keys, _CHUNK).orderBy(*order))
    joined = _with_chunk_table(chunked.withColumn(_ROWS, inside), ends, keys)
    return joined.select(*rows.columns, F.coalesce(_ROWS, _BEFORE)[value].alias(name))
