"""Queries that go through the store: each builds one from `events` in the shared folder, and reads it back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesframe.queries import _EV, _SIX, _SUMMARY, END, START, _rounded, points
from seriesframe.sources.store import Reader, Writer, verify


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="seriesframe-") if spark.sparkContext.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_stores"
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


def _built(spark: SparkSession, sf_dir: str, parts: int = 1) -> str:
    """A store with all events, published in as many generations by time."""
    path = _folder(spark)
    rows = points(spark, sf_dir)
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    with Writer(spark, path, create=True, ties=True) as w:
        for k in range(parts):
            a, b = (low + (high + 1 - low) * j // parts for j in (k, k + 1))
            w.append_frame(rows.where((F.col("ts") >= a) & (F.col("ts") < b)))
            w.checkpoint()
    return path


def store_round_trip(spark, d) -> DataFrame:
    return Reader(spark, _built(spark, d)).points()


def store_catalog(spark, d) -> DataFrame:
    return _rounded(Reader(spark, _built(spark, d, 2)).catalog().drop("series_id"), "v_sum")


def store_aggregate(spark, d) -> DataFrame:
    """Through page summaries, and points at the range's ends only."""
    a = Reader(spark, _built(spark, d, 2)).aggregate("view", START, END)
    return _rounded(spark.createDataFrame([tuple(a)], "count long, minimum double, maximum double, sum double, first double, last double"))


def verify_report(spark, d) -> DataFrame:
    return verify(spark, _built(spark, d, 2)).select("checkpoint", "series_count", "record_count", "logical_size", "trailing_bytes", "oldest_timestamp", "newest_timestamp")


def generations(spark, d) -> DataFrame:
    """What each generation shows: number, and points visible."""
    path = _folder(spark)
    rows = points(spark, d)
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    out = []
    with Writer(spark, path, create=True, ties=True) as w:
        reader = Reader(spark, path)
        out.append((reader.generation, 0))
        for k in range(3):
            a, b = (low + (high + 1 - low) * j // 3 for j in (k, k + 1))
            w.append_frame(rows.where((F.col("ts") >= a) & (F.col("ts") < b)))
            w.checkpoint()
            reader.refresh()
            out.append((reader.generation, reader.points().count()))
    return spark.createDataFrame(out, "generation long, visible long")


QUERIES = {f.__name__: f for f in (store_round_trip, store_catalog, store_aggregate, verify_report, generations)}
ORACLE_SQL = {
    "store_round_trip": f"WITH {_EV} SELECT series, ts, value FROM ev",
    "store_catalog": f"WITH {_EV} SELECT series, {_SUMMARY} FROM ev GROUP BY series",
    "store_aggregate": f"WITH {_EV} SELECT {_SIX} FROM ev WHERE series = 'view' AND ts BETWEEN {START} AND {END}",
    "verify_report": f"WITH {_EV} SELECT CAST(3 AS BIGINT) AS checkpoint, count(DISTINCT series) AS series_count, count(*) AS record_count, 16 * count(*) AS logical_size, CAST(0 AS BIGINT) AS trailing_bytes, min(ts) AS oldest_timestamp, max(ts) AS newest_timestamp FROM ev",
    "generations": f"WITH {_EV}, b AS (SELECT min(ts) AS low, max(ts) AS high FROM ev) SELECT CAST(k + 1 AS BIGINT) AS generation, (SELECT count(*) FROM ev WHERE ts < low + (high + 1 - low) * k // 3) AS visible FROM b, (SELECT unnest(range(4)) AS k)",
}
