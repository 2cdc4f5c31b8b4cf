"""Queries over the driver's tables, one for each operator, with the SQL that should give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesframe.operators import aggregate as A
from seriesframe.operators import envelope as E
from seriesframe.operators import scan as S
from seriesframe.operators.lookup import lookup, lookup_batch
from seriesframe.plans.covered import covered_aggregate
from seriesframe.sources.points import points_from_events
from seriesframe.types import LookupMode

#: A range inside the events' month, in microseconds.
START, END = 1_704_500_000_000_000, 1_705_700_000_000_000
RESOLUTION = 37_000_000_000
GAP = 3_000_000_000
CHART = E.viewport(START, START + 40 * RESOLUTION, 24)
#: Chart bounds with an excluded interval after every fifth bucket.
BOUNDS = [b for k, b in enumerate(CHART) if k % 6 != 5]

_EV = "ev AS (SELECT event_type AS series, epoch_us(ts) AS ts, value FROM events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_from_events(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value"))


def _rounded(frame: DataFrame, column: str = "sum") -> DataFrame:
    """Sums depend on the order of additions in their last bits."""
    return frame.withColumn(column, F.round(column, 2))


def _nulls(frame: DataFrame) -> DataFrame:
    """NaN as null, to compare with SQL."""
    return frame.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


def range_scan(spark, d):
    return S.range_scan(points(spark, d), "view", START, END)


def range_count(spark, d):
    return S.range_count(points(spark, d), "view", START, END)


def point_get(spark, d):
    p = points(spark, d)
    at = p.where("series = 'click'").agg(F.min("ts")).first()[0]
    return S.point_get(p, "click", at)


def range_prefix(spark, d):
    return S.range_prefix(points(spark, d), "view", START, END, 100)


def cursor_batches(spark, d):
    return S.cursor_batches(points(spark, d), "view", START, END, 256).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def latest_timestamp(spark, d):
    return S.latest_timestamp(points(spark, d))


def catalog_summary(spark, d):
    return _rounded(A.catalog_summary(points(spark, d)), "v_sum")


def range_aggregate(spark, d):
    return _rounded(A.range_aggregate(points(spark, d), "view", START, END))


def aggregate_by_series(spark, d):
    return _rounded(A.aggregate_by_series(points(spark, d), START, END))


def aggregate_empty(spark, d):
    return _nulls(A.range_aggregate(points(spark, d), "view", 0, 1))


def windows_dense(spark, d):
    return _nulls(_rounded(A.windows(points(spark, d), "view", START, END, RESOLUTION)))


def windows_prefix(spark, d):
    return _nulls(_rounded(A.windows(points(spark, d), "view", START, END, RESOLUTION, capacity=7)))


def windows_by_series(spark, d):
    return _rounded(A.sparse_windows(points(spark, d), START, END, RESOLUTION))


def _targets(spark, d):
    """Every order id as a query at a time of the events' month, spread over the series."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("query_id"))
    names = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "error")))
    return orders.select("query_id", F.element_at(names, (F.col("query_id") % 5 + 1).cast("int")).alias("series"), (F.lit(1_704_060_000_000_000) + F.col("query_id") * 40_000_000 % 2_610_000_000_000).alias("target"))


_TARGETS = "q AS (SELECT o_orderkey AS query_id, ['click', 'view', 'purchase', 'signup', 'error'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS series, 1704060000000000 + o_orderkey * 40000000 % 2610000000000 AS target FROM orders)"


def _batch(mode, limit=None):
    def run(spark, d):
        return lookup_batch(points(spark, d), _targets(spark, d), mode=mode, max_distance=limit)

    return run


def lookup_exact(spark, d):
    """The series' own timestamps, and as many that miss by one."""
    p = points(spark, d)
    asked = p.select((F.col("ts") % 1_000_003).alias("query_id"), "series", (F.col("ts") + F.col("ts") % 2).alias("target"))
    return lookup_batch(p, asked, mode=LookupMode.EXACT)


def lookup_scalar(spark, d):
    """One target in the four modes, by pushed-down top-1 scans."""
    p = points(spark, d)
    out = [lookup(p, "view", START, m).select(F.lit(m.name.lower()).alias("mode"), "ts", "value") for m in LookupMode]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def page_summaries(spark, d):
    return _rounded(A.page_summaries(points(spark, d), 512), "v_sum")


def summary_merge(spark, d):
    return _rounded(A.merge_summaries(A.page_summaries(points(spark, d), 512), "series"), "v_sum")


def covered_boundary_aggregate(spark, d):
    p = points(spark, d)
    return _rounded(covered_aggregate(p, A.page_summaries(p, 512), "view", START, END))


def envelope_stats(spark, d):
    return E.envelope(points(spark, d), "view", BOUNDS, max_gap=GAP).drop("samples")


def envelope_samples(spark, d):
    return E.samples(points(spark, d), BOUNDS, max_gap=GAP, series="view")[1].drop("series")


def order_violations(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderpriority", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    return S.order_violations(orders, series="o_orderpriority", pos="o_orderkey", ts="ts")


_SIX = "count(*) AS count, min(value) AS minimum, max(value) AS maximum, round(sum(value), 2) AS sum, arg_min(value, ts) AS first, arg_max(value, ts) AS last"
_SUMMARY = "min(ts) AS ts_min, max(ts) AS ts_max, count(*) AS point_count, min(value) AS v_min, max(value) AS v_max, round(sum(value), 2) AS v_sum, arg_min(value, ts) AS v_first, arg_max(value, ts) AS v_last"
_RANGE = f"series = 'view' AND ts BETWEEN {START} AND {END}"
_PAGES = f"{_EV}, paged AS (SELECT *, (row_number() OVER (PARTITION BY series ORDER BY ts) - 1) // 512 AS page_no FROM ev)"


def _lookup_sql(choice: str, limit: int | None = None) -> str:
    ok = f"abs(target - {{}}) <= {limit}" if limit is not None else "true"
    pick = {"predecessor": ("p_ts", "p_value"), "successor": ("s_ts", "s_value"), "nearest": (None, None)}[choice]
    if choice == "nearest":
        closer = "s_ts IS NULL OR target - p_ts <= s_ts - target"
        pick = (f"CASE WHEN {closer} THEN p_ts ELSE s_ts END", f"CASE WHEN {closer} THEN p_value ELSE s_value END")
    return f"""WITH {_EV}, {_TARGETS},
p AS (SELECT q.query_id, q.series, q.target, e.ts AS p_ts, e.value AS p_value FROM q ASOF LEFT JOIN ev e ON q.series = e.series AND q.target >= e.ts),
s AS (SELECT q.query_id, e.ts AS s_ts, e.value AS s_value FROM q ASOF LEFT JOIN ev e ON q.series = e.series AND q.target <= e.ts),
f AS (SELECT query_id, series, target, {pick[0]} AS ts, {pick[1]} AS value FROM p JOIN s USING (query_id))
SELECT query_id, series, target, CASE WHEN {ok.format('ts')} THEN ts END AS ts, CASE WHEN {ok.format('ts')} THEN value END AS value FROM f"""


def _windows_sql(count: int) -> str:
    return f"""WITH {_EV}, g AS (SELECT (ts - {START}) // {RESOLUTION} AS bucket, {_SIX} FROM ev WHERE {_RANGE} GROUP BY 1)
SELECT b.bucket, {START} + b.bucket * {RESOLUTION} AS window_start, least({START} + (b.bucket + 1) * {RESOLUTION} - 1, {END}) AS window_end,
coalesce(count, 0) AS count, minimum, maximum, coalesce(sum, 0.0) AS sum, first, last FROM (SELECT unnest(range({count})) AS bucket) b LEFT JOIN g USING (bucket)"""


_BOUNDS_SQL = "bounds(bucket, b_start, b_end, component) AS (VALUES " + ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(E.check_bounds(BOUNDS))) + ")"
_CHART = f"""WITH {_EV}, {_BOUNDS_SQL},
p AS (SELECT bucket, component, ts, value, ts - lag(ts) OVER (PARTITION BY component ORDER BY ts) > {GAP} AS gap, ts - lag(ts) OVER (PARTITION BY bucket ORDER BY ts) > {GAP} AS gap_in FROM ev JOIN bounds ON ts BETWEEN b_start AND b_end WHERE series = 'view'),
r AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS gaps FROM p),
b AS (SELECT bucket, count(*) AS n, count(*) AS m, min(ts) AS f, max(ts) AS l, arg_min(ts, (value, ts)) AS lo, arg_min(ts, (-value, ts)) AS hi, coalesce(bool_or(gap_in), false) AS g FROM p GROUP BY bucket)"""
_STATS_SQL = f"""{_CHART}
SELECT CAST(bounds.bucket AS INTEGER) AS bucket, coalesce(n, 0) AS stored_count, coalesce(m, 0) AS numeric_count, CAST(coalesce(len(list_distinct([f, l, lo, hi])), 0) AS INTEGER) AS sample_count, false AS has_nan, coalesce(g, false) AS has_internal_time_gap
FROM bounds LEFT JOIN b USING (bucket)"""
_SAMPLES_SQL = f"""{_CHART},
e AS (SELECT r.bucket, r.component, r.ts, r.value, r.gaps, r.ts = f AS is_first, r.ts = lo AS is_minimum, r.ts = hi AS is_maximum, r.ts = l AS is_last FROM r JOIN b USING (bucket) WHERE r.ts IN (f, l, lo, hi)),
x AS (SELECT *, lag(bucket) OVER (ORDER BY ts) AS lb, lag(component) OVER (ORDER BY ts) AS lc, lag(gaps) OVER (ORDER BY ts) AS lg FROM e)
SELECT CAST(bucket AS INTEGER) AS bucket, ts, value, is_first, is_minimum, is_maximum, is_last, lb IS NULL AS break_query_start, coalesce(bucket - lb > 1, false) AS break_empty_bucket,
coalesce(component <> lc, false) AS break_excluded_interval, coalesce(gaps > lg, false) AS break_time_gap, false AS break_nan FROM x"""

QUERIES = {f.__name__: f for f in (
    range_scan, range_count, point_get, range_prefix, cursor_batches, latest_timestamp, catalog_summary, range_aggregate, aggregate_by_series, aggregate_empty,
    windows_dense, windows_prefix, windows_by_series, lookup_exact, lookup_scalar, page_summaries, summary_merge, covered_boundary_aggregate, envelope_stats, envelope_samples, order_violations,
)}
QUERIES |= {"lookup_predecessor": _batch(LookupMode.PREDECESSOR), "lookup_successor": _batch(LookupMode.SUCCESSOR), "lookup_nearest": _batch(LookupMode.NEAREST), "lookup_tolerance": _batch(LookupMode.NEAREST, 100_000_000)}

_N = A.windows_required(START, END, RESOLUTION)
ORACLE_SQL = {
    "range_scan": f"WITH {_EV} SELECT series, ts, value FROM ev WHERE {_RANGE}",
    "range_count": f"WITH {_EV} SELECT count(*) AS count FROM ev WHERE {_RANGE}",
    "point_get": f"WITH {_EV} SELECT series, ts, value FROM ev WHERE series = 'click' AND ts = (SELECT min(ts) FROM ev WHERE series = 'click')",
    "range_prefix": f"WITH {_EV} SELECT series, ts, value FROM ev WHERE {_RANGE} ORDER BY ts LIMIT 100",
    "cursor_batches": f"WITH {_EV}, n AS (SELECT ts, (row_number() OVER (ORDER BY ts) - 1) // 256 AS batch FROM ev WHERE {_RANGE}) SELECT batch, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM n GROUP BY batch",
    "latest_timestamp": f"WITH {_EV} SELECT series, max(ts) AS ts FROM ev GROUP BY series",
    "catalog_summary": f"WITH {_EV} SELECT series, {_SUMMARY} FROM ev GROUP BY series",
    "range_aggregate": f"WITH {_EV} SELECT {_SIX} FROM ev WHERE {_RANGE}",
    "aggregate_by_series": f"WITH {_EV} SELECT series, {_SIX} FROM ev WHERE ts BETWEEN {START} AND {END} GROUP BY series",
    "aggregate_empty": "SELECT CAST(0 AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS minimum, CAST(NULL AS DOUBLE) AS maximum, CAST(0 AS DOUBLE) AS sum, CAST(NULL AS DOUBLE) AS first, CAST(NULL AS DOUBLE) AS last",
    "windows_dense": _windows_sql(_N),
    "windows_prefix": _windows_sql(7),
    "windows_by_series": f"WITH {_EV} SELECT series, (ts - {START}) // {RESOLUTION} AS bucket, {_SIX} FROM ev WHERE ts BETWEEN {START} AND {END} GROUP BY ALL",
    "lookup_exact": f"WITH {_EV}, q AS (SELECT ts % 1000003 AS query_id, series, ts + ts % 2 AS target FROM ev) SELECT q.query_id, q.series, q.target, e.ts, e.value FROM q LEFT JOIN ev e ON e.series = q.series AND e.ts = q.target",
    "lookup_scalar": f"""WITH {_EV}, v AS (SELECT ts, value FROM ev WHERE series = 'view'), p AS (SELECT ts, value FROM v WHERE ts <= {START} ORDER BY ts DESC LIMIT 1), s AS (SELECT ts, value FROM v WHERE ts >= {START} ORDER BY ts LIMIT 1),
        n AS (SELECT * FROM (SELECT * FROM p UNION ALL SELECT * FROM s) ORDER BY abs(ts - {START}), ts LIMIT 1)
        SELECT 'exact' AS mode, ts, value FROM v WHERE ts = {START} UNION ALL SELECT 'predecessor', ts, value FROM p UNION ALL SELECT 'successor', ts, value FROM s UNION ALL SELECT 'nearest', ts, value FROM n""",
    "lookup_predecessor": _lookup_sql("predecessor"),
    "lookup_successor": _lookup_sql("successor"),
    "lookup_nearest": _lookup_sql("nearest"),
    "lookup_tolerance": _lookup_sql("nearest", 100_000_000),
    "page_summaries": f"WITH {_PAGES} SELECT series, page_no, {_SUMMARY} FROM paged GROUP BY ALL",
    "summary_merge": f"WITH {_EV} SELECT series, {_SUMMARY} FROM ev GROUP BY series",
    "covered_boundary_aggregate": f"WITH {_EV} SELECT {_SIX} FROM ev WHERE {_RANGE}",
    "envelope_stats": _STATS_SQL,
    "envelope_samples": _SAMPLES_SQL,
    "order_violations": "SELECT * FROM (SELECT o_orderpriority, o_orderkey, epoch_us(o_orderdate) AS ts, lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS previous_ts FROM orders) WHERE previous_ts >= ts",
}
