"""Queries over events with NaNs, infinities, negative zeros and the ends of the time domain, and over series that are cut into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesframe import queries as Q
from seriesframe.operators import aggregate as A
from seriesframe.operators import envelope as E
from seriesframe.operators import scan as S
from seriesframe.operators.lookup import lookup_batch
from seriesframe.sources.store import Reader, Writer
from seriesframe.store_queries import _folder
from seriesframe.streaming.ingest import follow
from seriesframe.types import LONG_MAX, LONG_MIN, LookupMode

NAN, INF = float("nan"), float("inf")
ENDS = [("view", LONG_MIN, NAN), ("view", LONG_MAX, 7.5), ("click", LONG_MIN, -0.0), ("click", 0, NAN), ("only_nan", 5, NAN), ("only_nan", 6, NAN)]
LIMIT = 2**63
#: Rows of a chunk in the queries that cut series; small, so that even the smallest tables' series are cut.
CHUNK = 50

_MIN_SQL = f"(-{LONG_MAX} - 1)"
_ENDS_SQL = ", ".join(f"('{s}', {_MIN_SQL if t == LONG_MIN else f'CAST({t} AS BIGINT)'}, CAST('{v}' AS DOUBLE))" for s, t, v in ENDS)
_SP = f"""ev AS (SELECT event_type AS series, epoch_us(ts) AS ts, CASE WHEN epoch_us(ts) % 17 = 0 THEN CAST('nan' AS DOUBLE) WHEN epoch_us(ts) % 19 = 0 THEN CAST('inf' AS DOUBLE)
WHEN epoch_us(ts) % 23 = 0 AND event_type <> 'view' AND epoch_us(ts) % 19 <> 0 THEN CAST('-0.0' AS DOUBLE) ELSE value END AS value FROM events UNION ALL VALUES {_ENDS_SQL})"""


def special_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, view = F.col("ts"), F.col("series") == "view"
    value = F.when(ts % 17 == 0, F.lit(NAN)).when(ts % 19 == 0, F.lit(INF)).when((ts % 23 == 0) & ~view, F.lit(-0.0)).otherwise(F.col("value"))
    return Q.points(spark, sf_dir).withColumn("value", value).unionByName(spark.createDataFrame(ENDS, "series string, ts long, value double"))


def _plain(frame: DataFrame) -> DataFrame:
    """Comparable with SQL: NaN as null, sums of finite values rounded, negative zeros as zeros."""
    if "sum" in frame.columns:
        frame = frame.withColumn("sum", F.when(F.abs("sum") < INF, F.round("sum", 2)).otherwise(F.col("sum")))
    return frame.select(*[F.when(~F.isnan(c), F.col(c) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


def special_aggregates(spark, d):
    return _plain(A.aggregate_by_series(special_points(spark, d)))


def special_windows(spark, d):
    """The whole 64-bit domain in 16 windows, and the events' own range in fine ones."""
    p = special_points(spark, d)
    wide = A.windows(p, "view", LONG_MIN, LONG_MAX, 2**60).withColumn("kind", F.lit("domain"))
    return _plain(wide.unionByName(A.windows(p, "view", Q.START, Q.END, Q.RESOLUTION).withColumn("kind", F.lit("events"))))


def special_envelope_stats(spark, d):
    return E.envelope(special_points(spark, d), "view", Q.BOUNDS, max_gap=Q.GAP).drop("samples")


def special_envelope_samples(spark, d):
    return _plain(E.samples(special_points(spark, d), Q.BOUNDS, max_gap=Q.GAP, series="view", chunk_points=CHUNK)[1].drop("series"))


def special_lookups(spark, d):
    """Nearest points within half the domain, for targets at its ends, at 0 and among the events; ts as text, as some readers take longs with nulls for doubles."""
    key = F.col("query_id") % 4
    q = Q._targets(spark, d).withColumn("target", F.when(key == 0, F.lit(LONG_MIN)).when(key == 1, F.lit(LONG_MAX)).when(key == 2, F.lit(0)).otherwise(F.col("target")))
    return _plain(lookup_batch(special_points(spark, d), q, mode=LookupMode.NEAREST, max_distance=LIMIT, chunk_points=CHUNK)).withColumn("ts", F.col("ts").cast("string"))


def chunked_pages(spark, d):
    return Q._rounded(A.page_summaries(Q.points(spark, d), 512, chunk_points=CHUNK), "v_sum")


def chunked_order_violations(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderpriority", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    return S.order_violations(orders, series="o_orderpriority", pos="o_orderkey", ts="ts", chunk_points=CHUNK)


def store_batches_followed(spark, d):
    """Special points through append_batch in two generations and a compaction; then what the second one has added."""
    path = _folder(spark)
    with Writer(spark, path, create=True, ties=True) as w:
        for low, high in ((LONG_MIN, Q.START - 1), (Q.START, LONG_MAX)):
            for series in ("click", "view"):
                w.append_many(series, ((r.ts, r.value) for r in S.range_scan(special_points(spark, d), series, low, high).toLocalIterator()))
            first = w.checkpoint() if low == LONG_MIN else first
        w.checkpoint()
        w.compact()
    return _plain(follow(spark, path, since=first))


def store_cursor(spark, d):
    """Every batch of a stateless cursor over a series of a store: its number, points and ends."""
    path = _folder(spark)
    with Writer(spark, path, create=True, ties=True) as w:
        w.append_frame(Q.points(spark, d))
        w.checkpoint()
    reader, at, out = Reader(spark, path), Q.START, []
    while at is not None:
        batch, at = reader.cursor_next("view", at, Q.END, 256)
        if batch:
            out.append((len(out), len(batch), batch[0][0], batch[-1][0]))
    return spark.createDataFrame(out, "batch long, n long, first_ts long, last_ts long")


QUERIES = {f.__name__: f for f in (special_aggregates, special_windows, special_envelope_stats, special_envelope_samples, special_lookups, chunked_pages, chunked_order_violations, store_batches_followed, store_cursor)}

_NUM = "FILTER (NOT isnan(value))"
_SUM = f"sum(value) {_NUM}"
_SIX = f"""count(*) AS count, min(value) {_NUM} + 0.0 AS minimum, max(value) {_NUM} + 0.0 AS maximum, CASE WHEN {_SUM} IS NULL THEN 0.0 WHEN isinf({_SUM}) THEN {_SUM} ELSE round({_SUM}, 2) + 0.0 END AS sum,
CASE WHEN NOT isnan(arg_min(value, ts)) THEN arg_min(value, ts) + 0.0 END AS first, CASE WHEN NOT isnan(arg_max(value, ts)) THEN arg_max(value, ts) + 0.0 END AS last"""


def _windows_sql(kind: str, start: str, end: str, resolution: int, count: int) -> str:
    s = f"CAST({start} AS HUGEINT)"
    return f"""SELECT b.bucket, CAST({s} + b.bucket::HUGEINT * {resolution} AS BIGINT) AS window_start, CAST(least({s} + (b.bucket::HUGEINT + 1) * {resolution} - 1, {end}) AS BIGINT) AS window_end,
coalesce(count, 0) AS count, minimum, maximum, coalesce(sum, 0.0) AS sum, first, last, '{kind}' AS kind FROM (SELECT unnest(range({count})) AS bucket) b
LEFT JOIN (SELECT CAST((ts::HUGEINT - {s}) // {resolution} AS BIGINT) AS bucket, {_SIX} FROM ev WHERE series = 'view' AND ts BETWEEN {start} AND {end} GROUP BY 1) g USING (bucket)"""


_CHART = f"""WITH {_SP}, {Q._BOUNDS_SQL},
p AS (SELECT bucket, component, ts, value, isnan(value) AS isn, ts - lag(ts) OVER (PARTITION BY component ORDER BY ts) > {Q.GAP} AS gap, ts - lag(ts) OVER (PARTITION BY bucket ORDER BY ts) > {Q.GAP} AS gap_in
    FROM ev JOIN bounds ON ts BETWEEN b_start AND b_end WHERE series = 'view'),
r AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS gaps, sum(CASE WHEN isn THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS nans FROM p),
b AS (SELECT bucket, count(*) AS n, count(*) FILTER (NOT isn) AS m, min(ts) AS f, max(ts) AS l, arg_min(ts, (value, ts)) FILTER (NOT isn) AS lo, arg_min(ts, (-value, ts)) FILTER (NOT isn) AS hi,
    coalesce(bool_or(gap_in), false) AS g, bool_or(isn) AS h FROM p GROUP BY bucket)"""
_STATS_SQL = f"""{_CHART}
SELECT CAST(bounds.bucket AS INTEGER) AS bucket, coalesce(n, 0) AS stored_count, coalesce(m, 0) AS numeric_count,
CAST(coalesce(len(list_distinct([f, l, lo, hi])), 0) AS INTEGER) AS sample_count, coalesce(h, false) AS has_nan, coalesce(g, false) AS has_internal_time_gap FROM bounds LEFT JOIN b USING (bucket)"""
_SAMPLES_SQL = f"""{_CHART},
e AS (SELECT r.bucket, r.component, r.ts, r.value, r.gaps, r.nans, r.ts = f AS is_first, coalesce(r.ts = lo, false) AS is_minimum, coalesce(r.ts = hi, false) AS is_maximum, r.ts = l AS is_last FROM r JOIN b USING (bucket) WHERE r.ts IN (f, l, lo, hi)),
x AS (SELECT *, lag(bucket) OVER o AS lb, lag(component) OVER o AS lc, lag(gaps) OVER o AS lg, lag(nans) OVER o AS ln, lag(value) OVER o AS lv FROM e WINDOW o AS (ORDER BY ts))
SELECT CAST(bucket AS INTEGER) AS bucket, ts, CASE WHEN NOT isnan(value) THEN value + 0.0 END AS value, is_first, is_minimum, is_maximum, is_last, lb IS NULL AS break_query_start, coalesce(bucket - lb > 1, false) AS break_empty_bucket,
coalesce(component <> lc, false) AS break_excluded_interval, coalesce(gaps > lg, false) AS break_time_gap, CASE WHEN lb IS NULL THEN isnan(value) ELSE isnan(lv) OR nans > ln END AS break_nan FROM x"""
_LOOKUPS_SQL = f"""WITH {_SP}, {Q._TARGETS},
t AS (SELECT query_id, series, CASE query_id % 4 WHEN 0 THEN {_MIN_SQL} WHEN 1 THEN {LONG_MAX} WHEN 2 THEN 0 ELSE target END AS target FROM q),
p AS (SELECT t.query_id, t.series, t.target, e.ts AS p_ts, e.value AS p_value FROM t ASOF LEFT JOIN ev e ON t.series = e.series AND t.target >= e.ts),
s AS (SELECT t.query_id, e.ts AS s_ts, e.value AS s_value FROM t ASOF LEFT JOIN ev e ON t.series = e.series AND t.target <= e.ts),
c AS (SELECT *, s_ts IS NULL OR target::HUGEINT - p_ts <= s_ts::HUGEINT - target AS closer FROM p JOIN s USING (query_id)),
f AS (SELECT query_id, series, target, CASE WHEN closer THEN p_ts ELSE s_ts END AS ts, CASE WHEN closer THEN p_value ELSE s_value END AS value FROM c)
SELECT query_id, series, target, CASE WHEN ok THEN CAST(ts AS VARCHAR) END AS ts, CASE WHEN ok AND NOT isnan(value) THEN value + 0.0 END AS value FROM (SELECT *, abs(target::HUGEINT - ts) <= {LIMIT} AS ok FROM f)"""
ORACLE_SQL = {
    "special_aggregates": f"WITH {_SP} SELECT series, {_SIX} FROM ev GROUP BY series",
    "special_windows": f"WITH {_SP} {_windows_sql('domain', _MIN_SQL, str(LONG_MAX), 2**60, 16)} UNION ALL {_windows_sql('events', str(Q.START), str(Q.END), Q.RESOLUTION, Q._N)}",
    "special_envelope_stats": _STATS_SQL,
    "special_envelope_samples": _SAMPLES_SQL,
    "special_lookups": _LOOKUPS_SQL,
    "chunked_pages": Q.ORACLE_SQL["page_summaries"],
    "chunked_order_violations": Q.ORACLE_SQL["order_violations"],
    "store_batches_followed": f"WITH {_SP} SELECT series, ts, CASE WHEN NOT isnan(value) THEN value + 0.0 END AS value FROM ev WHERE series IN ('click', 'view') AND ts >= {Q.START}",
    "store_cursor": Q.ORACLE_SQL["cursor_batches"],
}
