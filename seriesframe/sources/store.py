"""The snapshot store: series in immutable Parquet segments, published by generations.

    store/_manifests/gen=<N>.json   small: what generation N consists of, its predecessor's digest, its own digest
    store/_current                  the newest manifest's number and digest, replaced atomically
    store/data/<segment>/           points of one checkpoint, range-partitioned and sorted by (series_id, ts)
    store/pages/<segment>/          a summary of each page (4088 points at most) of that segment
    store/catalog/gen=<N>/          a summary of each series as of generation N

Readers pin one generation: they read the files that its manifest names and nothing else.  A checkpoint writes all data before its
manifest, and the manifest before the pointer; a crash in between leaves files that nothing names.  If the pointer or the newest
manifest is damaged, readers fall back to the newest one that is sound; if none is, they fail.

Manifests hold the SHA-256 of every file that they name (data, pages and catalog), taken by Spark from what was written; verify() takes them again.
Frames are written once to store/staged/ before they are checked, so that what is checked is what is published.

Timestamps of a series increase strictly, unless the store was created with ties: then points of one generation may share timestamps and
all are kept, in no order among themselves; a later generation still begins after what is published.

Values keep their bits: Spark's writer makes all NaNs alike, so each NaN's bits are kept in nan_bits.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesframe import errors as err
from seriesframe.functions.aggregates import merge_exprs, summary_exprs
from seriesframe.operators import aggregate as A
from seriesframe.operators import envelope as E
from seriesframe.operators import scan as S
from seriesframe.operators.lookup import lookup, lookup_batch
from seriesframe.plans.covered import covered_aggregate, covered_windows, in_runs
from seriesframe.sources.files import Files, Lock
from seriesframe.types import PAGE_POINTS, Aggregate, LookupMode, Point, check_long, check_name, check_ulong

STORED = "series_id int, series string, ts long, value double, nan_bits long, page_no long"
PAGES = "series_id int, series string, page_no long, ts_min long, ts_max long, point_count long, v_min double, v_max double, v_sum double, v_first double, v_last double, segment string, codec string"
CATALOG = "series_id int, series string, ts_min long, ts_max long, point_count long, v_min double, v_max double, v_sum double, v_first double, v_last double"
FILE_POINTS = 20_000_000  # of one data file, at most: files stay far below 2 GB
#: Points that a stateless cursor reads at a time, and cursors whose points are kept, at most.
READ_AHEAD, CURSORS_AHEAD = 16_384, 8
CODECS = {"raw": "none", "compressed": "zstd"}
_BATCH = T.StructType([T.StructField("series", T.StringType(), False), T.StructField("pos", T.LongType(), False), T.StructField("ts", T.LongType(), False), T.StructField("value", T.DoubleType(), False), T.StructField("nan_bits", T.LongType())])


def _digest(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _seal(body: dict) -> bytes:
    return json.dumps(body | {"sha256": _digest(body)}, sort_keys=True).encode()


def _unseal(data: bytes) -> dict | None:
    try:
        body = json.loads(data)
        digest = body.pop("sha256")
    except (ValueError, KeyError, AttributeError):
        return None
    return body | {"sha256": digest} if _digest(body) == digest else None


def digests(spark: SparkSession, path: str, folders: Sequence[str]) -> dict[str, dict[str, str]]:
    """SHA-256 of each data file of each folder, taken on the executors; a row for each file comes to the driver."""
    out: dict[str, dict[str, str]] = {f: {} for f in folders}
    if folders:
        files = spark.read.format("binaryFile").load([f"{path}/{f}" for f in folders])
        for name, sha in files.select("path", F.sha2("content", 256)).collect():
            folder, base = "/".join(name.split("/")[-3:-1]), name.rsplit("/", 1)[1]
            out[folder][base] = sha
    return out


def elect(files: Files) -> dict:
    """The newest sound manifest: the pointer's, or else the newest whose digest and predecessor's digest hold."""
    numbers = sorted((int(n[4:-5]) for n in files.names("_manifests") if n.startswith("gen=") and n.endswith(".json")), reverse=True)
    if not numbers:
        raise err.StoreError("no store is there")

    def load(n: int) -> dict | None:
        with suppress(err.StoreError):
            m = _unseal(files.read(f"_manifests/gen={n}.json"))
            return m if m and m["generation"] == n else None
        return None

    pointer = None
    with suppress(err.StoreError):
        pointer = _unseal(files.read("_current")) if files.exists("_current") else None
    if pointer:
        m = load(pointer["generation"])
        if m and m["sha256"] == pointer["manifest"]:
            return m
    for n in numbers:
        m = load(n)
        if m is None:
            continue
        before = load(n - 1) if n > 1 else None
        if n == 1 or before is not None and before["sha256"] == m["previous"] or before is None and n - 1 not in numbers:
            return m
    raise err.IntegrityError("manifests are there, but none is sound")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, np.float64).view(np.int64)


@F.arrow_udf(T.LongType())
def _nan_bits(value: pa.Array) -> pa.Array:
    v = value.to_numpy(zero_copy_only=False)
    return pa.array(_bits(v), mask=~np.isnan(v))


@F.arrow_udf(T.DoubleType())
def _with_bits(value: pa.Array, bits: pa.Array) -> pa.Array:
    v = value.to_numpy(zero_copy_only=False).copy()
    known = bits.is_valid().to_numpy(zero_copy_only=False)
    v.view(np.int64)[known] = bits.fill_null(0).to_numpy(zero_copy_only=False)[known]
    return pa.array(v)


@dataclass(frozen=True)
class SeriesHandle:
    series: str
    series_id: int
    epoch: int
    owner: int


@dataclass(frozen=True)
class Profile:
    lookup_ns: int
    read_ns: int
    count: int


class Reader:
    """One pinned generation; refresh() moves on to a newer one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, path)
        self._closed, self.epoch = False, 0
        self._adopt(elect(self.files))

    def _adopt(self, manifest: dict) -> None:
        self.manifest = manifest
        self.generation = manifest["generation"]
        self.epoch += 1
        self._known: dict[str, tuple] = {}
        self._ahead: dict[tuple, tuple] = {}  # points read for the next calls of stateless cursors, by number of the series, place and end

    def _alive(self) -> None:
        if self._closed:
            raise err.StoreError("the reader is closed")

    def close(self) -> None:
        self._closed = True

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def refresh(self) -> bool:
        """Adopt a strictly newer generation; handles and iterators of the old one turn stale."""
        self._alive()
        manifest = elect(self.files)
        if manifest["generation"] <= self.generation:
            return False
        self._adopt(manifest)
        return True

    def at(self, generation: int) -> dict:
        """The manifest of an earlier generation."""
        m = _unseal(self.files.read(f"_manifests/gen={generation}.json"))
        if m is None or m["generation"] != generation:
            raise err.IntegrityError(f"the manifest of generation {generation} is damaged")
        return m

    # ---- tables of this generation

    def _table(self, folder: str, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}/{n}" for n in names])

    def catalog(self) -> DataFrame:
        """A summary of each series."""
        self._alive()
        c = self.manifest["catalog"]
        return self._table("catalog", [c] if c else [], CATALOG)

    def pages(self) -> DataFrame:
        self._alive()
        return self._table("pages", [s["name"] for s in self.manifest["segments"]], PAGES)

    def stored(self) -> DataFrame:
        self._alive()
        return self._table("data", [s["name"] for s in self.manifest["segments"]], STORED)

    def points(self, *, exact_bits: bool = False) -> DataFrame:
        """(series, ts, value) of all series; with exact_bits, NaNs as they were written."""
        return self.stored().select("series", "ts", _with_bits("value", "nan_bits").alias("value") if exact_bits else F.col("value"))

    # ---- series

    def _summary(self, series: str):
        """The catalog's row of a published series."""
        self._alive()
        check_name(series)
        if series not in self._known:
            row = self.catalog().where(F.col("series") == series).first()
            if row is None:
                raise err.SeriesNotFound(series)
            if len(self._known) >= 10_000:
                self._known.clear()
            self._known[series] = row
        return self._known[series]

    def prepare(self, series: str) -> SeriesHandle:
        return SeriesHandle(series, self._summary(series).series_id, self.epoch, id(self))

    def _resolve(self, series: str | SeriesHandle):
        if isinstance(series, SeriesHandle):
            if series.owner != id(self):
                raise err.InvalidArguments("the handle belongs to another reader")
            if series.epoch != self.epoch:
                raise err.StaleHandle(series.series)
            series = series.series
        return self._summary(series)

    def _own(self, row, *, exact_bits: bool = False) -> DataFrame:
        """Points of one series; the number prunes row groups, as data are sorted by it."""
        rows = self.stored().where(F.col("series_id") == row.series_id)
        value = _with_bits("value", "nan_bits").alias("value") if exact_bits else F.col("value")
        return rows.select("series", "ts", value)

    def latest_timestamp(self, series: str | SeriesHandle) -> int:
        return self._resolve(series).ts_max

    def codec_counts(self, series: str | SeriesHandle) -> dict[str, int]:
        row = self._resolve(series)
        found = dict(self.pages().where(F.col("series_id") == row.series_id).groupBy("codec").count().collect())
        return {c: found.get(c, 0) for c in CODECS}

    # ---- scans

    def range_frame(self, series: str | SeriesHandle, start: int, end: int, *, exact_bits: bool = False) -> DataFrame:
        return S.range_scan(self._own(self._resolve(series), exact_bits=exact_bits), None, start, end, ordered=False).orderBy("ts")

    def range(self, series: str | SeriesHandle, start: int, end: int) -> list[Point]:
        return [Point(r.ts, r.value) for r in self.range_frame(series, start, end, exact_bits=True).select("ts", "value").collect()]

    def range_into(self, series: str | SeriesHandle, start: int, end: int, capacity: int) -> tuple[list[Point], int]:
        """The first `capacity` points, and how many there are in all."""
        if capacity < 0:
            raise err.BatchError("capacity is negative")
        required = self.count(series, start, end)
        rows = self.range_frame(series, start, end, exact_bits=True).select("ts", "value").limit(capacity).collect() if capacity and required else []
        return [Point(r.ts, r.value) for r in rows], required

    def range_checked(self, series: str | SeriesHandle, start: int, end: int, capacity: int) -> list[Point]:
        """All points, or BufferTooSmall with the number needed."""
        rows, required = self.range_into(series, start, end, capacity)
        if required > capacity:
            raise err.BufferTooSmall(required)
        return rows

    def count(self, series: str | SeriesHandle, start: int, end: int) -> int:
        """From summaries where pages are covered; points are read at the range's ends only."""
        row = self._resolve(series)
        check_long("start", start), check_long("end", end)
        if end < start or end < row.ts_min or start > row.ts_max:
            return 0
        if start <= row.ts_min and end >= row.ts_max:
            return row.point_count
        pages = in_runs(self.pages().where((F.col("series_id") == row.series_id) & (F.col("ts_max") >= start) & (F.col("ts_min") <= end)))
        whole, part = pages.agg(F.sum(F.when((F.col("low") >= start) & (F.col("high") <= end), F.col("point_count"))), F.count_if((F.col("low") < start) | (F.col("high") > end))).first()
        cut = pages.where((F.col("low") < start) | (F.col("high") > end)).select("low", "high").distinct().collect() if part else []
        total = whole or 0
        for low, high in cut:
            total += self._own(row).where(S.in_range(max(low, start), min(high, end))).count()
        return total

    def iter_range(self, series: str | SeriesHandle, start: int, end: int, *, batch_size: int = 1024) -> Iterator[Point]:
        """Points by time; arguments are checked at once, the series with the first point, and the snapshot before every point."""
        check_long("start", start), check_long("end", end)
        if isinstance(batch_size, bool) or not isinstance(batch_size, int) or batch_size <= 0:
            raise err.InvalidArguments("batch_size must be a positive integer")
        epoch = self.epoch

        def run():
            fresh = self._resolve(series)
            own = self._own(fresh, exact_bits=True)
            for batch in S.iterate(own, fresh.series, start, end, batch_size):
                for p in batch:
                    self._alive()
                    if self.epoch != epoch:
                        raise err.StaleHandle(fresh.series)
                    yield Point(*p)

        return run()

    def cursor(self, series: str | SeriesHandle, start: int, end: int, size: int) -> Iterator[list[Point]]:
        row = self._resolve(series)
        epoch = self.epoch
        for batch in S.iterate(self._own(row, exact_bits=True), row.series, start, end, size):
            if self.epoch != epoch:
                raise err.StaleHandle(row.series)
            yield [Point(*p) for p in batch]

    def cursor_next(self, series: str | SeriesHandle, next_ts: int | tuple[int, int] | None, end: int, size: int) -> tuple[list[Point], int | tuple[int, int] | None]:
        """A stateless cursor's batch from a place on, and the next place: a time, or within equal timestamps that time and how many of them to skip.

        Points are read READ_AHEAD at a time; those after the batch are kept, for the cursor's next call, by place (few cursors at once, others read again).
        """
        row = self._resolve(series)
        if size <= 0 or next_ts is None or not isinstance(next_ts, tuple) and end < next_ts:
            return S.next_page(self._own(row), row.series, next_ts, end, size)
        rows, after = self._ahead.pop((row.series_id, next_ts, end), ([], next_ts))
        if len(rows) <= size and after is not None:
            own = self.stored().where(F.col("series_id") == row.series_id).select("series", "ts", _with_bits("value", "nan_bits").alias("value"), "nan_bits")
            more, after = S.next_page(own, row.series, after, end, max(size + 1, READ_AHEAD), ("nan_bits",))
            rows = rows + more
        batch, rest = rows[:size], rows[size:]
        if not rest:
            return [Point(*p) for p in batch], after
        place = S.place_after(next_ts, batch, rest[0][0])
        while len(self._ahead) >= CURSORS_AHEAD:
            self._ahead.pop(next(iter(self._ahead)))
        self._ahead[(row.series_id, place, end)] = (rest, after)
        return [Point(*p) for p in batch], place

    def range_text(self, series: str | SeriesHandle, start: int, end: int, path: str) -> None:
        """Lines "timestamp value", in order, as text files under path."""
        from seriesframe.functions.scalars import plain_number

        @F.pandas_udf("string")
        def line(ts: pd.Series, value: pd.Series) -> pd.Series:
            return pd.Series([f"{t} {plain_number(v)}" for t, v in zip(ts, value, strict=True)], dtype=object)

        self.range_frame(series, start, end).select(line("ts", "value").alias("value")).write.text(path)

    def borrow_page(self, series: str | SeriesHandle, ts: int):
        """The uncompressed page whose span holds ts, as an Arrow table (ts, value) by time."""
        row = self._resolve(series)
        check_long("ts", ts)
        page = self.pages().where((F.col("series_id") == row.series_id) & (F.col("ts_min") <= ts) & (F.col("ts_max") >= ts)).first()
        if page is None:
            raise err.PageNotFound(f"no page of {row.series} holds {ts}")
        if page.codec != "raw":
            raise err.PageNotFound(f"the page of {row.series} that holds {ts} is compressed")
        rows = self._table("data", [page.segment], STORED).where((F.col("series_id") == row.series_id) & (F.col("page_no") == page.page_no) & S.in_range(page.ts_min, page.ts_max))
        return rows.select("ts", _with_bits("value", "nan_bits").alias("value")).orderBy("ts").toArrow()

    def profile_range(self, series: str | SeriesHandle, start: int, end: int) -> Profile:
        t0 = time.perf_counter_ns()
        self._resolve(series)
        t1 = time.perf_counter_ns()
        n = self.count(series, start, end)
        return Profile(t1 - t0, time.perf_counter_ns() - t1, n)

    # ---- lookups, aggregates, windows, charts

    def lookup(self, series: str | SeriesHandle, target: int, mode: LookupMode, max_distance: int | None = None) -> Point | None:
        check_long("target", target)
        mode = LookupMode(mode)
        if max_distance is not None:
            check_ulong("max_distance", max_distance)
        row = self._resolve(series)
        own = self.pages().where(F.col("series_id") == row.series_id)
        at = {LookupMode.EXACT: [own.where((F.col("ts_min") <= target) & (F.col("ts_max") >= target))]}
        at[LookupMode.PREDECESSOR] = [own.where(F.col("ts_min") <= target).orderBy(F.desc("ts_min"))]
        at[LookupMode.SUCCESSOR] = [own.where(F.col("ts_max") >= target).orderBy("ts_max")]
        at[LookupMode.NEAREST] = at[LookupMode.PREDECESSOR] + at[LookupMode.SUCCESSOR]
        spans = {(p.segment, p.ts_min, p.ts_max) for pages in at[mode] if (p := pages.select("segment", "ts_min", "ts_max").first())}
        if not spans:
            return None
        # the page or two that hold the answer, and nothing else
        rows = [self._table("data", [segment], STORED).where((F.col("series_id") == row.series_id) & S.in_range(low, high)) for segment, low, high in sorted(spans)]
        held = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        found = lookup(held.select("series", "ts", "value", "nan_bits"), row.series, target, mode, max_distance).first()
        if found is None:
            return None
        return Point(found.ts, found.value if found.nan_bits is None else struct.unpack("<d", struct.pack("<q", found.nan_bits))[0])

    def lookup_batch(self, queries: DataFrame, **options) -> DataFrame:
        return lookup_batch(self.points(), queries, **options)

    def aggregate(self, series: str | SeriesHandle, start: int, end: int) -> Aggregate:
        """From the catalog if the range covers the series, else from page summaries and the points at the range's ends."""
        row = self._resolve(series)
        check_long("start", start), check_long("end", end)
        if end >= start and start <= row.ts_min and end >= row.ts_max:
            return Aggregate(row.point_count, row.v_min, row.v_max, row.v_sum, row.v_first, row.v_last)
        pages = self.pages().where(F.col("series_id") == row.series_id)
        return Aggregate(*covered_aggregate(self._own(row), pages, row.series, start, end).first())

    def windows(self, series: str | SeriesHandle, start: int, end: int, resolution: int, capacity: int | None = None) -> tuple[DataFrame, int]:
        """The first `capacity` dense windows (default: all), and how many there are."""
        row = self._resolve(series)
        required = A.windows_required(start, end, resolution)
        pages = self.pages().where(F.col("series_id") == row.series_id)
        return covered_windows(self._own(row), pages, row.series, start, end, resolution, capacity), required

    def envelope(self, series: str | SeriesHandle, bounds: Sequence[tuple[int, int]], *, max_gap: int | None = None, capacity: int | None = None) -> tuple[DataFrame | None, dict]:
        """(buckets, progress); with too small a capacity nothing is read."""
        row = self._resolve(series)
        E.check_bounds(bounds)
        if capacity is not None and capacity < len(bounds):
            return None, {"required": len(bounds), "written": 0, "complete": False}
        return E.envelope(self._own(row), row.series, bounds, max_gap=max_gap), {"required": len(bounds), "written": len(bounds), "complete": True}


class Writer:
    """The store's single writer: points are staged, and each checkpoint publishes a generation."""

    def __init__(self, spark: SparkSession, path: str, *, codec: str = "compressed", create: bool | None = None, batch_size: int = 4096, ties: bool | None = None):
        if codec not in CODECS:
            raise err.InvalidArguments(f"codec must be one of {', '.join(CODECS)}")
        if isinstance(batch_size, bool) or not isinstance(batch_size, int) or batch_size <= 0:
            raise err.InvalidArguments("batch_size must be a positive integer")
        self.spark, self.path, self.codec, self.batch_size = spark, path.rstrip("/"), codec, batch_size
        self.files = Files(spark, path)
        there = bool(self.files.names("_manifests")) if self.files.exists() else False
        if create is True and there:
            raise err.StoreError("the store exists")
        if create is False and not there:
            raise err.StoreError("no store is there")
        if there and ties is not None and ties != elect(self.files).get("ties", False):
            raise err.StoreError("whether timestamps may be equal is settled when a store is created")
        self.files.make("_manifests")
        self._lock = Lock(self.files)
        self.poisoned, self.closed = False, False
        try:
            if not there:
                self._publish({"generation": 1, "previous": None, "segments": [], "catalog": None, "catalog_files": {}, "series_count": 0, "point_count": 0, "batches": {}} | ({"ties": True} if ties else {}), sync=False)
            self.reader = Reader(spark, path)
        except Exception:
            self._lock.release()
            raise
        self.ties = self.reader.manifest.get("ties", False)
        self._tails: dict[str, int | None] = {}
        self._begun: set[str] = set()  # series whose tail is staged
        self._staged: list[tuple[str, np.ndarray, np.ndarray]] = []
        self._frames: list[tuple[str, DataFrame, DataFrame]] = []  # folder, points, and the last timestamp of each series
        self.generation = self.reader.generation

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        self.abort() if kind else self.close()

    def _ready(self) -> None:
        if self.closed:
            raise err.StoreError("the writer is closed")
        if self.poisoned:
            raise err.WriterPoisoned("an earlier operation failed")

    def _tail(self, series: str) -> int | None:
        if series not in self._tails:
            try:
                self._tails[series] = self.reader.latest_timestamp(series)
            except err.SeriesNotFound:
                self._tails[series] = None
            tails = [int(t[-1]) for name, t, _ in self._staged if name == series]
            tails += [r.tail for _, _, f in self._frames for r in f.where(F.col("series") == series).collect()]
            if tails:
                self._tails[series] = max(tails)
                self._begun.add(series)
        return self._tails[series]

    def prepare(self, series: str, max_points: int) -> None:
        """Room for points is Spark's affair; arguments are checked, and the series stays unpublished until it has a point."""
        self._ready()
        check_name(series)
        if isinstance(max_points, bool) or not isinstance(max_points, int) or max_points <= 0:
            raise err.InvalidArguments("max_points must be a positive integer")

    def append(self, series: str, ts: int, value: float) -> None:
        self.append_batch(series, [ts], [value])

    def append_batch(self, series: str, ts: Sequence[int], values: Sequence[float]) -> None:
        """All or nothing: checked before anything is staged."""
        self._ready()
        if len(ts) != len(values):
            raise err.BatchError("as many values as timestamps")
        if not len(ts):
            return
        check_name(series)
        if not isinstance(ts, np.ndarray):
            for t in ts:
                check_long("ts", t)
        t, v = np.asarray(ts, np.int64), np.asarray(values, np.float64)
        tail = self._tail(series)
        early = np.less if self.ties else np.less_equal
        if early(t[1:], t[:-1]).any() or tail is not None and (int(t[0]) < tail or int(t[0]) == tail and not (self.ties and series in self._begun)):
            raise err.NotIncreasing(f"timestamps of {series} must increase")
        self._staged.append((series, t.copy(), v.copy()))
        self._tails[series] = int(t[-1])
        self._begun.add(series)

    def append_many(self, series: str, points: Iterable[tuple[int, float]]) -> None:
        """Any number of points, submitted by batch_size: each batch is all or nothing."""
        batch: list[tuple[int, float]] = []
        for p in points:
            batch.append(p)
            if len(batch) == self.batch_size:
                self.append_batch(series, *map(list, zip(*batch, strict=True)))
                batch = []
        if batch:
            self.append_batch(series, *map(list, zip(*batch, strict=True)))

    def append_frame(self, points: DataFrame, *, pos: str | None = None) -> None:
        """Points (series, ts, value) of any size, checked by Spark before they are staged.

        With pos, timestamps must increase in its order; without, the rows have no order of their own, and equal timestamps are refused, but for stores with ties.
        """
        self._ready()
        rows = points.select("series", "ts", "value", F.col(pos).alias("pos") if pos else F.col("ts").alias("pos"), _nan_bits("value").alias("nan_bits"))
        folder = f"staged/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.path}/{folder}/points")
            rows = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}/points")
            self._check_frame(rows, f"{self.path}/{folder}/tails", ordered=pos is not None or not self.ties)
        except Exception:
            self.files.delete(folder)
            raise
        tails = self.spark.read.schema("series string, head long, tail long").parquet(f"{self.path}/{folder}/tails")
        self._frames.append((folder, rows.select("series", "ts", "value", "nan_bits"), tails))
        self._tails.clear()

    def _check_frame(self, rows: DataFrame, tails: str, *, ordered: bool) -> None:
        if rows.where("series is null or series = '' or octet_length(series) > 65535 or ts is null or value is null").limit(1).count():
            raise err.BatchError("series, ts and value must be there, and names have 1 to 65535 bytes")
        rows.groupBy("series").agg(F.min("ts").alias("head"), F.max("ts").alias("tail")).write.parquet(tails)
        ends = self.spark.read.schema("series string, head long, tail long").parquet(tails)
        own = {s for s, _, _ in self._staged}
        if own and ends.where(F.col("series").isin(list(own))).limit(1).count() or any(ends.join(f.select("series"), "series", "left_semi").limit(1).count() for _, _, f in self._frames):
            raise err.BatchError("a series of the frame has staged points already: checkpoint first")
        late = ends.join(self.reader.catalog().select("series", "ts_max"), "series").where("head <= ts_max").limit(1).count()
        wrong = S.order_violations(rows, series="series", pos="pos", ts="ts") if ordered else rows
        if late or ordered and (wrong.where("previous_ts > ts") if self.ties else wrong).limit(1).count():
            raise err.NotIncreasing("timestamps must increase, also over what is stored")

    def _forget_frames(self) -> None:
        for folder, _, _ in self._frames:
            self.files.delete(folder)
        self._frames = []

    def checkpoint(self, *, durability: str = "memory", batch: str | None = None) -> int:
        """Publish what is staged as the next generation, and return its number; with nothing staged, no new generation.

        batch, as "stream:number", is kept in this and all later manifests as the stream's last batch; with it, a generation is published in any case.
        """
        self._ready()
        if durability not in ("memory", "disk"):
            raise err.InvalidArguments("durability is memory or disk")
        if not self._staged and not self._frames and batch is None:
            return self.generation
        try:
            manifest = self._write() if self._staged or self._frames else self._next()
            if batch is not None:
                stream, _, number = batch.rpartition(":")
                manifest["batches"] = manifest.get("batches", {}) | {stream: int(number)}
            self._publish(manifest, sync=durability == "disk")
        except Exception:
            self.poisoned = True
            raise
        self._forget_frames()
        self._staged = []
        self._begun.clear()
        self.reader.refresh()
        self.generation = self.reader.generation
        return self.generation

    def _rows(self) -> DataFrame:
        frames = [f for _, f, _ in self._frames]
        if self._staged:
            t = np.concatenate([x[1] for x in self._staged])
            v = np.concatenate([x[2] for x in self._staged])
            names = np.repeat(np.array([x[0] for x in self._staged], object), [len(x[1]) for x in self._staged])
            nan = np.isnan(v)
            table = pa.table({"series": pa.array(names, pa.string()), "pos": pa.array(np.arange(len(t))), "ts": pa.array(t), "value": pa.array(v), "nan_bits": pa.array(_bits(v), mask=~nan)})
            frames.append(self.spark.createDataFrame(table, _BATCH).select("series", "ts", "value", "nan_bits"))
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f)
        return rows

    def _next(self) -> dict:
        """The next manifest, with what the newest one names."""
        old = self.reader.manifest
        return {k: v for k, v in old.items() if k not in ("sha256", "batch")} | {"generation": self.generation + 1, "previous": old["sha256"]}

    def _segment(self, name: str, first: int) -> dict:
        """What the manifest says of a segment: its files, and the generations whose points it has, from first to the next one."""
        sha = digests(self.spark, self.path, [f"data/{name}", f"pages/{name}"])
        return {"name": name, "codec": self.codec, "files": self.files.sizes(f"data/{name}"), "sha256": sha[f"data/{name}"], "pages": sha[f"pages/{name}"], "first": first, "last": self.generation + 1}

    def _write(self) -> dict:
        old, n = self.reader.manifest, self.generation + 1
        segment = f"gen={n}-{uuid.uuid4().hex}"
        rows = self._rows()
        before = self.reader.catalog()
        known = before.select("series", "series_id")
        # new series are numbered by name, after the largest number so far
        fresh = rows.select("series").distinct().join(known, "series", "left_anti")
        base = old.get("series_count", 0)
        from pyspark.sql import Window as W

        numbered = fresh.withColumn("series_id", (F.row_number().over(W.orderBy("series")) - 1 + base).cast("int"))
        ids = known.unionByName(numbered)
        placed = rows.join(ids, "series").repartitionByRange("series_id", "ts").sortWithinPartitions("series_id", "ts")
        # pages are runs of a sorted partition, so that a long series needs no single task
        placed = placed.withColumn("page_no", F.floor(F.monotonically_increasing_id() / PAGE_POINTS).cast("long"))
        columns = [x.split()[0] for x in STORED.split(", ")]
        writer = placed.select(*columns).write.option("compression", CODECS[self.codec]).option("maxRecordsPerFile", FILE_POINTS)
        writer.parquet(f"{self.path}/data/{segment}")
        written = self.spark.read.schema(STORED).parquet(f"{self.path}/data/{segment}")
        pages = written.groupBy("series_id", "series", "page_no").agg(*summary_exprs())
        pages = pages.withColumn("segment", F.lit(segment)).withColumn("codec", F.lit(self.codec))
        pages.sortWithinPartitions("series_id", "ts_min").write.parquet(f"{self.path}/pages/{segment}")
        pages = self.spark.read.schema(PAGES).parquet(f"{self.path}/pages/{segment}")
        summary = [x.split()[0] for x in CATALOG.split(", ")]
        merged = before.unionByName(pages.select(*summary)).groupBy("series_id", "series").agg(*merge_exprs())
        name = f"gen={n}-{uuid.uuid4().hex}"
        merged.select(*summary).repartitionByRange("series").sortWithinPartitions("series").write.parquet(f"{self.path}/catalog/{name}")
        count, points = self.spark.read.schema(CATALOG).parquet(f"{self.path}/catalog/{name}").agg(F.count(F.lit(1)), F.sum("point_count")).first()
        return self._next() | {
            "catalog": name, "catalog_files": digests(self.spark, self.path, [f"catalog/{name}"])[f"catalog/{name}"], "series_count": count, "point_count": points,
            "segments": [*old["segments"], self._segment(segment, n)],
        }

    def _publish(self, manifest: dict, *, sync: bool) -> None:
        data = _seal(manifest)
        self.files.write(f"_manifests/gen={manifest['generation']}.json", data, sync=sync, new=True)
        self.files.write("_current", _seal({"generation": manifest["generation"], "manifest": json.loads(data)["sha256"]}), sync=sync)

    def compact(self) -> int:
        """Rewrite all segments as one, as a new generation with the same points."""
        self._ready()
        if self._staged or self._frames:
            raise err.InvalidArguments("checkpoint first")
        old, n = self.reader.manifest, self.generation + 1
        if len(old["segments"]) < 2:
            return self.generation
        segment = f"gen={n}-{uuid.uuid4().hex}"
        rows = self.reader.stored().drop("page_no").repartitionByRange("series_id", "ts").sortWithinPartitions("series_id", "ts")
        rows = rows.withColumn("page_no", F.floor(F.monotonically_increasing_id() / PAGE_POINTS).cast("long"))
        rows.write.option("compression", CODECS[self.codec]).option("maxRecordsPerFile", FILE_POINTS).parquet(f"{self.path}/data/{segment}")
        pages = self.spark.read.schema(STORED).parquet(f"{self.path}/data/{segment}").groupBy("series_id", "series", "page_no").agg(*summary_exprs())
        pages.withColumn("segment", F.lit(segment)).withColumn("codec", F.lit(self.codec)).write.parquet(f"{self.path}/pages/{segment}")
        body = self._next() | {"segments": [self._segment(segment, min(s.get("first", n) for s in old["segments"]))]}
        self._publish(body, sync=True)
        self.reader.refresh()
        self.generation = n
        return n

    def close(self) -> None:
        """Publish what is staged, and let others write."""
        if self.closed:
            return
        try:
            if self.poisoned:
                raise err.WriterPoisoned("an earlier operation failed: nothing is published")
            self.checkpoint()
        finally:
            self.closed = True
            self._lock.release()

    def abort(self) -> None:
        """Forget what is staged, and let others write."""
        if not self.closed:
            self._forget_frames()
            self._staged, self.closed = [], True
            self._lock.release()


def verify(spark: SparkSession, path: str) -> DataFrame:
    """One row of counts and bounds, after a check of everything: manifest, files and sizes, order, overlaps and summaries.

    Anything that doesn't hold raises IntegrityError; every file's SHA-256 is taken again on the executors, and points are compared with their
    pages by one aggregation.
    """
    reader = Reader(spark, path)
    m = reader.manifest
    ties = m.get("ties", False)
    for s in m["segments"]:
        if reader.files.sizes(f"data/{s['name']}") != s["files"]:
            raise err.IntegrityError(f"segment {s['name']} doesn't have the files and sizes of its manifest")
    named = {f"{kind}/{s['name']}": s[key] for s in m["segments"] for kind, key in (("data", "sha256"), ("pages", "pages"))}
    if m["catalog"]:
        named[f"catalog/{m['catalog']}"] = m["catalog_files"]
    try:
        there = digests(spark, reader.path, list(named))
    except Exception as e:
        raise err.IntegrityError(f"stored files can't be read: {type(e).__name__}: {str(e)[:300]}") from e
    for folder, files in named.items():
        if there[folder] != files:
            raise err.IntegrityError(f"files of {folder} aren't what was written")
    try:
        pages = reader.pages()
        real = reader.stored().withColumn("segment", F.element_at(F.split(F.input_file_name(), "/"), -2))
        real = real.groupBy("series_id", "series", "page_no", "segment").agg(*summary_exprs(), (F.count(F.lit(1)) if ties else F.count_distinct("ts")).alias("d"))
        names = ["ts_min", "ts_max", "point_count", "v_min", "v_max", "v_first", "v_last"]
        same = F.lit(True)
        for c in names:
            same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
        same = same & ((F.abs(F.col("x.v_sum") - F.col("y.v_sum")) <= 1e-6 * (1 + F.abs(F.col("x.v_sum")))) | F.col("x.v_sum").eqNullSafe(F.col("y.v_sum"))) & (F.col("x.d") == F.col("x.point_count"))
        both = real.alias("x").join(pages.alias("y"), ["series_id", "series", "page_no", "segment"], "full_outer")
        wrong = both.where(~F.coalesce(same, F.lit(False))).limit(1).count()
        from pyspark.sql import Window as W

        overlap = pages.withColumn("before", F.lag("ts_max").over(W.partitionBy("series_id").orderBy("ts_min", "ts_max"))).where("before > ts_min" if ties else "before >= ts_min").limit(1).count()
        count, points, oldest, newest = reader.catalog().agg(F.count(F.lit(1)), F.sum("point_count"), F.min("ts_min"), F.max("ts_max")).first()
        blocks, packed, stored = pages.agg(F.count(F.lit(1)), F.count_if(F.col("codec") == "compressed"), F.sum("point_count")).first()
    except err.SeriesError:
        raise
    except Exception as e:
        raise err.IntegrityError(f"stored data can't be read: {type(e).__name__}: {str(e)[:300]}") from e
    if wrong or overlap or (points or 0) != (stored or 0) or (points or 0) != m["point_count"] or count != m["series_count"]:
        raise err.IntegrityError("points, pages and catalog don't agree")
    named = sum(sum(s["files"].values()) for s in m["segments"])
    there = sum(reader.files.sizes("data").values())
    row = (m["generation"], count, points or 0, blocks, packed or 0, 16 * (points or 0), named, there - named, oldest, newest)
    return spark.createDataFrame([row], "checkpoint long, series_count long, record_count long, block_count long, compressed_blocks long, logical_size long, physical_size long, trailing_bytes long, oldest_timestamp long, newest_timestamp long")


def bits_of(value: float) -> int:
    return struct.unpack("<Q", struct.pack("<d", value))[0]


__all__ = ["Reader", "SeriesHandle", "Writer", "bits_of", "elect", "verify"]
