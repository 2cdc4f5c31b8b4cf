"""Structured Streaming into a store: one generation for each micro-batch, at most once.

Late data aren't dropped: a batch that doesn't go on after what is stored fails the query, or its offending series go to a reject sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seriesframe.operators.scan import order_violations
from seriesframe.sources.store import CATALOG, STORED, Reader, Writer


def split_late(points: DataFrame, catalog: DataFrame, *, pos: str | None = None, ties: bool = False) -> tuple[DataFrame, DataFrame]:
    """(series that go on in order, series that don't) of a batch: a batch of a series is taken whole or not at all."""
    ordered = points.withColumn("_pos", F.col(pos) if pos else F.col("ts"))
    wrong = order_violations(ordered, series="series", pos="_pos", ts="ts")
    bad = (wrong.where("previous_ts > ts") if ties else wrong).select("series").distinct()
    late = points.groupBy("series").agg(F.min("ts").alias("head")).join(catalog.select("series", "ts_max"), "series").where("head <= ts_max").select("series")
    refused = bad.union(late).distinct()
    return points.join(refused, "series", "left_anti"), points.join(refused, "series", "left_semi")


def batch_writer(path: str, *, codec: str = "compressed", durability: str = "disk", pos: str | None = None, reject: Callable[[DataFrame, int], None] | None = None, name: str = "stream") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch.  A batch that is published already is skipped, so replays add nothing.

    Manifests keep the last batch of each stream (by name), whoever publishes next; a batch of refused rows only is noted too.  reject is called
    before its batch is published, so it may see a batch again after a crash in between.
    """

    def write(frame: DataFrame, number: int) -> None:
        spark = frame.sparkSession
        mark = f"{name}:{number}"
        with Writer(spark, path, codec=codec) as writer:
            if writer.reader.manifest.get("batches", {}).get(name, -1) >= number:
                return
            points = frame
            if reject is not None:
                points, refused = split_late(frame, writer.reader.catalog(), pos=pos, ties=writer.ties)
                reject(refused, number)
            if points.limit(1).count():
                writer.append_frame(points, pos=pos)
            writer.checkpoint(durability=durability, batch=mark)

    return write


def ingest(points: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None, **options) -> StreamingQuery:
    """Start writing a stream of points (series, ts, value) into the store at path."""
    writer = points.writeStream.foreachBatch(batch_writer(path, **options)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def follow(spark: SparkSession, path: str, *, since: int = 1) -> DataFrame:
    """Points that generations after `since` have added, also where compaction has joined them with earlier ones.

    Segments hold points of a range of generations.  Of one that has earlier ones too, the points over each series' last timestamp as of
    `since` are new, as series only grow.
    """
    reader = Reader(spark, path)
    segments = [s for s in reader.manifest["segments"] if s["last"] > since]
    columns = ["series", "ts", "value"]
    new = reader._table("data", [s["name"] for s in segments if s["first"] > since], STORED).select(*columns)
    mixed = [s["name"] for s in segments if s["first"] <= since]
    if not mixed:
        return new
    then = reader.at(since)
    old = reader._table("catalog", [then["catalog"]] if then["catalog"] else [], CATALOG).select("series_id", "ts_max")
    rest = reader._table("data", mixed, STORED).join(old, "series_id", "left").where("ts_max is null or ts > ts_max").select(*columns)
    return new.unionByName(rest)
