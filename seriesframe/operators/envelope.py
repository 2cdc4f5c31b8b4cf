"""Chart envelopes: per bucket, the original first, lowest, highest and last sample, with the breaks of the line between samples.

Buckets are inclusive, ordered and disjoint.  Points are assigned to buckets by a vectorised search of the bucket starts; buckets of long
series are cut into cells (bucket and chunk), so that a task holds neither a series nor a wide bucket.  Time gaps and NaNs between the
chosen samples are told from running counts, taken within cells and added up over the (few) cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesframe.errors import InvalidArguments
from seriesframe.functions.scalars import distance, wide
from seriesframe.operators.chunks import CHUNK_POINTS, chunk_cuts, numbered
from seriesframe.operators.scan import in_range, of_series
from seriesframe.types import check_long, check_ulong

ROLES = ("first", "minimum", "maximum", "last")
BREAKS = ("query_start", "empty_bucket", "excluded_interval", "time_gap", "nan")


def check_bounds(bounds: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, component) of each bucket; a component ends where the next bucket doesn't follow at once."""
    out: list[tuple[int, int, int]] = []
    component = 0
    for start, end in bounds:
        check_long("start", start), check_long("end", end)
        if end < start or out and start <= out[-1][1]:
            raise InvalidArguments("bounds must be ordered and disjoint, each with start <= end")
        component += bool(out) and start != out[-1][1] + 1
        out.append((start, end, component))
    return out


def viewport(start: int, end: int, buckets: int) -> list[tuple[int, int]]:
    """The range in `buckets` bounds of balanced widths (fewer if it has fewer timestamps)."""
    check_long("start", start), check_long("end", end)
    if buckets <= 0:
        raise InvalidArguments("one bucket at least")
    span = end - start + 1
    if span <= 0:
        return []
    n = min(buckets, span)
    return [(start + span * k // n, start + span * (k + 1) // n - 1) for k in range(n)]


def _assigned(rows: DataFrame, bounds: list[tuple[int, int, int]]) -> DataFrame:
    starts, ends = np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64)

    @F.pandas_udf("int")
    def place(ts: pd.Series) -> pd.Series:
        t = ts.to_numpy(np.int64)
        at = np.searchsorted(starts, t, "right") - 1
        return pd.Series(np.where((at >= 0) & (t <= ends[np.maximum(at, 0)]), at, -1).astype(np.int32))

    return rows.withColumn("bucket", place("ts")).where("bucket >= 0")


def _over(later: Column, earlier: Column, max_gap: int | None) -> Column:
    if max_gap is None:
        return F.lit(False)
    return F.coalesce(distance(later, earlier) > wide(max_gap), F.lit(False))


def samples(points: DataFrame, bounds: Sequence[tuple[int, int]], *, max_gap: int | None = None, series: str | None = None, chunk_points: int = CHUNK_POINTS) -> tuple[DataFrame, DataFrame]:
    """(buckets, samples): non-empty buckets with their counts and flags, and the chosen samples with roles and breaks, for each series."""
    checked = check_bounds(bounds)
    if max_gap is not None:
        check_ulong("max_gap", max_gap)
    rows = of_series(points, series).select("series", "ts", "value")
    if not checked:
        rows = rows.where(F.lit(False)).withColumn("bucket", F.lit(0))
    else:
        rows = _assigned(rows.where(in_range(checked[0][0], checked[-1][1])), checked)
    component = F.element_at(F.array(*[F.lit(c) for _, _, c in checked] or [F.lit(0)]), F.col("bucket") + 1)
    rows = numbered(rows, chunk_cuts(rows, ["series"], "ts", chunk_points), ["series"], "ts", "chunk")
    time = W.partitionBy("series", "bucket", "chunk").orderBy("ts")
    running = time.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("isn", F.isnan("value")).withColumn("gap_in", _over(F.col("ts"), F.lag("ts").over(time), max_gap))
    rows = rows.withColumn("nan_in", F.sum(F.col("isn").cast("long")).over(running)).withColumn("gap_run", F.sum(F.col("gap_in").cast("long")).over(running))
    pt = F.struct("ts", "value", "nan_in", "gap_run")
    plain = F.when(~F.col("isn"), pt)
    value = F.when(~F.col("isn"), F.col("value") + 0.0)  # -0.0 and 0.0 are equal; the earlier one wins
    cells = rows.groupBy("series", "bucket", "chunk").agg(
        F.count(F.lit(1)).alias("stored_count"),
        F.count_if(~F.col("isn")).alias("numeric_count"),
        F.max("isn").alias("has_nan"),
        F.max("gap_in").alias("has_internal_time_gap"),
        F.max("nan_in").alias("nan_all"),
        F.max("gap_run").alias("gap_all"),
        F.min("ts").alias("b_first"),
        F.max("ts").alias("b_last"),
        F.min_by(pt, "ts").alias("p_first"),
        F.min_by(plain, F.when(~F.col("isn"), F.struct(value, "ts"))).alias("p_minimum"),
        F.max_by(plain, F.when(~F.col("isn"), F.struct(value, F.bitwise_not("ts")))).alias("p_maximum"),
        F.max_by(pt, "ts").alias("p_last"),
    )
    over = W.partitionBy("series").orderBy("bucket", "chunk")
    earlier = over.rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("component", component)
    edge = (F.lag("component").over(over) == F.col("component")) & _over(F.col("b_first"), F.lag("b_last").over(over), max_gap)
    cells = cells.withColumn("edge", F.coalesce(edge, F.lit(False)).cast("long")).withColumn("joins", F.coalesce(F.lag("bucket").over(over) == F.col("bucket"), F.lit(False)))
    cells = cells.withColumn("nan_base", F.coalesce(F.sum("nan_all").over(earlier), F.lit(0)))
    cells = cells.withColumn("gap_base", F.coalesce(F.sum(F.col("gap_all") + F.col("edge")).over(earlier), F.lit(0)) + F.col("edge"))

    def based(role: str) -> Column:
        p = F.col(f"p_{role}")
        return F.when(p.isNotNull(), F.struct(p.ts.alias("ts"), p.value.alias("value"), (F.col("nan_base") + p.nan_in).alias("nans"), (F.col("gap_base") + p.gap_run).alias("gaps")))

    lowest, highest = F.col("p_minimum"), F.col("p_maximum")
    reduced = cells.groupBy("series", "bucket").agg(
        F.sum("stored_count").alias("stored_count"),
        F.sum("numeric_count").alias("numeric_count"),
        F.max("has_nan").alias("has_nan"),
        F.max(F.col("has_internal_time_gap") | (F.col("joins") & (F.col("edge") == 1))).alias("has_internal_time_gap"),
        F.first("component").alias("component"),
        F.min_by(based("first"), "b_first").alias("p_first"),
        F.min_by(based("minimum"), F.when(lowest.isNotNull(), F.struct(lowest.value + 0.0, lowest.ts))).alias("p_minimum"),
        F.max_by(based("maximum"), F.when(highest.isNotNull(), F.struct(highest.value + 0.0, F.bitwise_not(highest.ts)))).alias("p_maximum"),
        F.max_by(based("last"), "b_last").alias("p_last"),
    )
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"p_{r}").alias("p")) for r in ROLES])
    chosen = reduced.select("series", "bucket", "component", F.explode(roles).alias("x")).where("x.p is not null")
    chosen = chosen.groupBy("series", "bucket", F.col("x.p.ts").alias("ts")).agg(
        F.first("x.p.value").alias("value"),
        F.first("component").alias("component"),
        F.first("x.p.nans").alias("nans"),
        F.first("x.p.gaps").alias("gaps"),
        *[F.max(F.col("x.role") == r).alias(f"is_{r}") for r in ROLES],
    )
    line = W.partitionBy("series").orderBy("ts")
    before = {c: F.lag(c).over(line) for c in ("bucket", "component", "nans", "gaps", "value")}
    chosen = chosen.select("*", *[b.alias(f"l_{c}") for c, b in before.items()])
    start = F.col("l_bucket").isNull()
    not_start = lambda c: F.when(start, F.lit(False)).otherwise(c)
    chosen = chosen.select(
        "series", "bucket", "ts", "value", *[f"is_{r}" for r in ROLES],
        start.alias("break_query_start"),
        not_start(F.col("bucket") - F.col("l_bucket") > 1).alias("break_empty_bucket"),
        not_start(F.col("component") != F.col("l_component")).alias("break_excluded_interval"),
        not_start(F.col("gaps") > F.col("l_gaps")).alias("break_time_gap"),
        F.when(start, F.isnan("value")).otherwise(F.isnan("l_value") | (F.col("nans") > F.col("l_nans"))).alias("break_nan"),
    )
    counts = reduced.select("series", "bucket", "stored_count", "numeric_count", "has_nan", "has_internal_time_gap")
    return counts, chosen


def envelope(points: DataFrame, series: str, bounds: Sequence[tuple[int, int]], *, max_gap: int | None = None) -> DataFrame:
    """A row for each bucket, empty ones included, with its samples by time."""
    counts, chosen = samples(points, bounds, max_gap=max_gap, series=series)
    sample = F.struct(
        "ts", "value",
        F.struct(*[F.col(f"is_{r}").alias(r) for r in ROLES]).alias("roles"),
        F.struct(*[F.col(f"break_{b}").alias(b) for b in BREAKS]).alias("break_before"),
    )
    lists = chosen.groupBy("bucket").agg(F.sort_array(F.collect_list(sample)).alias("samples"))  # four samples at most
    grid = points.sparkSession.range(len(bounds)).select(F.col("id").cast("int").alias("bucket"))
    empty = F.array().cast("array<struct<ts:bigint,value:double,roles:struct<first:boolean,minimum:boolean,maximum:boolean,last:boolean>,break_before:struct<query_start:boolean,empty_bucket:boolean,excluded_interval:boolean,time_gap:boolean,nan:boolean>>>")
    joined = grid.join(counts.drop("series"), "bucket", "left").join(lists, "bucket", "left")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    return joined.select(
        "bucket",
        F.coalesce("stored_count", zero).alias("stored_count"),
        F.coalesce("numeric_count", zero).alias("numeric_count"),
        F.coalesce(F.size("samples"), F.lit(0)).alias("sample_count"),
        F.coalesce("has_nan", no).alias("has_nan"),
        F.coalesce("has_internal_time_gap", no).alias("has_internal_time_gap"),
        F.coalesce("samples", empty).alias("samples"),
    )
