import json
import os
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesframe import cli
from seriesframe import errors as err
from seriesframe.sources import legacy
from seriesframe.sources.store import Reader, Writer, bits_of, verify
from seriesframe.streaming.ingest import batch_writer, follow, ingest
from seriesframe.types import LookupMode

NAN_BITS = 0x7FF8000000000123


def value(bits):
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def test_life_of_a_store(spark, path):
    with pytest.raises(err.StoreError):
        Reader(spark, path)
    w = Writer(spark, path, create=True, codec="raw")
    r = Reader(spark, path)
    assert r.generation == 1 and r.catalog().count() == 0
    w.prepare("empty", 10)
    w.append_batch("cpu", [1, 2, 3, 4], [4.0, 1.0, 8.0, 3.0])
    w.append_batch("bits", [-(2**63), 0, 2**63 - 1], [value(NAN_BITS), -0.0, 5e-324])
    for ts, v, kind in (([5, 5], [1.0, 2.0], err.NotIncreasing), ([4], [1.0], err.NotIncreasing), ([6], [], err.BatchError), ([True], [1.0], err.InvalidArguments), ([2**63], [1.0], err.InvalidArguments)):
        with pytest.raises(kind):
            w.append_batch("cpu", ts, v)
    with pytest.raises(err.InvalidArguments):
        w.append("", 1, 1.0)
    assert w.checkpoint(durability="disk") == 2 and w.checkpoint() == 2
    with pytest.raises(err.SeriesNotFound):
        r.prepare("cpu")
    assert r.refresh() is True and r.refresh() is False
    with pytest.raises(err.SeriesNotFound):
        r.prepare("empty")
    with pytest.raises(err.WriterBusy):
        Writer(spark, path)
    handle = r.prepare("cpu")
    assert tuple(r.aggregate(handle, 2, 4)) == (3, 1.0, 8.0, 12.0, 1.0, 3.0)
    assert r.count(handle, 0, 9) == 4 and r.count(handle, 2, 3) == 2 and r.count(handle, 5, 9) == 0 and r.count(handle, 3, 2) == 0
    assert r.range_into("cpu", 0, 9, 2) == ([(1, 4.0), (2, 1.0)], 4)
    with pytest.raises(err.BufferTooSmall) as e:
        r.range_checked("cpu", 0, 9, 2)
    assert e.value.required == 4
    assert [bits_of(p.value) for p in r.range("bits", -(2**63), 2**63 - 1)] == [NAN_BITS, 1 << 63, 1]
    assert bits_of(r.lookup("bits", -5, LookupMode.PREDECESSOR).value) == NAN_BITS
    assert r.borrow_page("cpu", 2).column("ts").to_pylist() == [1, 2, 3, 4] and r.codec_counts("cpu") == {"raw": 1, "compressed": 0}
    with pytest.raises(err.SeriesError):
        r.borrow_page("cpu", 99)
    assert r.latest_timestamp("cpu") == 4 and r.profile_range("cpu", 0, 9).count == 4
    rows, required = r.windows("cpu", 1, 4, 2, capacity=1)
    assert required == 2 and rows.count() == 1
    assert r.envelope("cpu", [(0, 9), (10, 12)], capacity=1) == (None, {"required": 2, "written": 0, "complete": False})
    frame, progress = r.envelope("cpu", [(0, 9)])
    assert progress["complete"] and frame.first().sample_count == 4
    page, at = r.cursor_next("cpu", 1, 9, 3)
    assert len(page) == 3 and at == 4 and [len(b) for b in r.cursor("cpu", 0, 9, 3)] == [3, 1]

    points = r.iter_range("cpu", 1, 9, batch_size=2)
    assert next(points) == (1, 4.0)
    with pytest.raises(err.InvalidArguments):
        r.iter_range("cpu", 1, 9, batch_size=0)
    w.append("cpu", 5, 9.0)
    w.checkpoint()
    assert r.refresh()
    with pytest.raises(err.StaleHandle):
        next(points)
    with pytest.raises(err.StaleHandle):
        r.count(handle, 5, 4)
    with pytest.raises(err.InvalidArguments):
        Reader(spark, path).count(r.prepare("cpu"), 0, 1)
    report = verify(spark, path).first()
    assert (report.checkpoint, report.series_count, report.record_count, report.trailing_bytes) == (3, 2, 8, 0)
    assert w.compact() == 4 and w.reader.count("cpu", 0, 9) == 5 and verify(spark, path).first().record_count == 8
    w.append("cpu", 6, 1.0)
    w.abort()
    assert Reader(spark, path).generation == 4


def test_faults(spark, path, monkeypatch):
    w = Writer(spark, path, create=True)
    w.append("a", 1, 1.0)
    w.checkpoint()
    w.append("a", 2, 2.0)
    monkeypatch.setattr(w, "_publish", lambda *a, **b: (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(OSError):
        w.checkpoint()
    with pytest.raises(err.WriterPoisoned):
        w.append("a", 3, 3.0)
    with pytest.raises(err.WriterPoisoned):
        w.close()
    assert Reader(spark, path).count("a", 0, 9) == 1  # files of the failed checkpoint are invisible
    with Writer(spark, path) as w:
        w.append("a", 2, 2.0)
    assert Reader(spark, path).generation == 3

    newest = f"{path}/_manifests/gen=3.json"
    good = open(newest, "rb").read()
    os.chmod(newest, 0o644)
    with open(newest, "wb") as f:
        f.write(good[:-20])
    assert not os.path.exists(f"{path}/_manifests/.gen=3.json.crc") or os.remove(f"{path}/_manifests/.gen=3.json.crc") is None
    assert Reader(spark, path).generation == 2  # torn: the one before counts
    body = json.loads(good)
    with open(newest, "wb") as f:
        f.write(json.dumps(body | {"previous": "0" * 64}).encode())
    assert Reader(spark, path).generation == 2
    for n in (1, 2, 3):
        at = f"{path}/_manifests/gen={n}.json"
        with open(at, "wb") as f:
            f.write(b"{}")
        if os.path.exists(crc := f"{path}/_manifests/.gen={n}.json.crc"):
            os.remove(crc)
    with pytest.raises(err.IntegrityError):
        Reader(spark, path)


def test_damage_is_found(spark, path):
    with Writer(spark, path, create=True) as w:
        w.append_batch("a", list(range(100)), np.arange(100.0))
    segment = Reader(spark, path).manifest["segments"][0]
    name = next(iter(segment["files"]))
    with open(f"{path}/data/{segment['name']}/{name}", "ab") as f:
        f.write(b"x")
    with pytest.raises(err.IntegrityError):
        verify(spark, path)


def test_frames(spark, path):
    rows = spark.createDataFrame([("s", i, float(i)) for i in range(50)] + [("t", 5, 1.0)], "series string, ts long, value double")
    with Writer(spark, path, create=True) as w:
        w.append_frame(rows)
        w.checkpoint()
        with pytest.raises(err.NotIncreasing):
            w.append_frame(rows)
        with pytest.raises(err.NotIncreasing):
            w.append_frame(spark.createDataFrame([("s", 60, 0, 1.0), ("s", 59, 1, 1.0)], "series string, ts long, pos long, value double"), pos="pos")
        w.append_many("u", ((i, 1.0) for i in range(10)))
    r = Reader(spark, path)
    assert r.count("s", 0, 99) == 50 and r.count("u", 0, 99) == 10


def test_command_line(spark, path, capsys):
    run = lambda *a: cli.main(list(a), spark)
    assert run("append", path, "cpu", "7", "5e-324", "raw") == 0 and run("append", path, "cpu", "8", "100") == 0
    assert run("range", path, "cpu", "0", "9") == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("7 0.000") and lines[1] == "8 100"
    assert run("verify", path) == 0 and run("inspect", path) == 0
    assert "records: 2" in capsys.readouterr().out
    assert run("append", path, "cpu", "8", "1") == 1 and run("range", path, "nope", "0", "1") == 1


def old_file(codec, broken=False):
    """A version 6 file with cpu at 100, 110, 120 = 42.5."""
    ts, vs = [100, 110, 120], [42.5] * 3
    if codec == 0:
        payload = b"".join(struct.pack("<qd", t, v) for t, v in zip(ts, vs, strict=True))
    else:
        deltas = bytes([10, 0])
        chunk = struct.pack("<Iq", 8 + len(deltas), 100) + deltas + struct.pack("<d", 42.5) + b"\0"
        payload = struct.pack("<IqI", 1, 100, 16) + chunk
    block = struct.pack("<4sB3xIIqqIIQ", b"CTBK", codec, 0, 3, 100, 120, len(payload), 48, legacy.fnv1a(payload)) + payload
    data = legacy.MAGIC + block
    footer = struct.pack("<8sB3xQQQI", b"CTIDX006", 0, 0, 0, 0, 1) + struct.pack("<IBHI", 0, 1, 3, 1) + b"cpu" + struct.pack("<QqqIIB", 5, 100, 120, 3, len(payload), codec)
    trailer = struct.pack("<8sQQQ", b"CTTRL006", len(data), len(footer), legacy.fnv1a(footer))
    data = bytearray(data + footer + trailer)
    if broken:
        data[5 + 48] ^= 1
    return bytes(data)


@pytest.mark.parametrize("codec", [0, 1])
def test_migration(spark, tmp_path, codec):
    source, target = str(tmp_path / "old"), str(tmp_path / "new")
    with open(source, "wb") as f:
        f.write(old_file(codec))
    assert legacy.migrate(spark, source, target) == 3
    assert Reader(spark, target).range("cpu", 0, 999) == [(100, 42.5), (110, 42.5), (120, 42.5)]
    with open(source, "wb") as f:
        f.write(old_file(codec, broken=True))
    with pytest.raises(err.IntegrityError):
        legacy.migrate(spark, source, str(tmp_path / "other"))
    assert not os.path.exists(tmp_path / "other")
    with pytest.raises(err.InvalidArguments):
        legacy.migrate(spark, source, source)


def test_streaming(spark, path, tmp_path):
    source = str(tmp_path / "in")
    schema = "series string, ts long, value double"
    for k in range(2):
        spark.createDataFrame([("s", 10 * k + i, 1.0) for i in range(5)], schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are taken by their time of change
    Writer(spark, path, create=True).close()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = ingest(stream, path, str(tmp_path / "checkpoint"))
    assert query.awaitTermination(300)
    r = Reader(spark, path)
    assert r.count("s", 0, 99) == 10 and r.generation == 3
    refused = []
    write = batch_writer(path, reject=lambda f, n: refused.extend(f.collect()), name="other")
    batch = spark.createDataFrame([("s", 3, 1.0), ("s", 99, 1.0), ("t", 1, 1.0)], schema)
    write(batch, 0)
    write(batch, 0)  # a replay adds nothing
    r.refresh()
    assert {x.series for x in refused} == {"s"} and r.count("t", 0, 9) == 1 and r.count("s", 0, 99) == 10
    assert follow(spark, path, since=3).count() == 1


def test_batches_after_frames(spark, path):
    """Staged frames count for later batches, in both orders; a frame is read once."""
    frame = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 2.0), ("b", 5, 3.0)], "series string, ts long, value double")
    with Writer(spark, path, create=True) as w:
        w.append_frame(frame)
        for ts in (10, 15, 20):
            with pytest.raises(err.NotIncreasing):
                w.append("a", ts, 9.0)
        w.append("a", 21, 9.0)
        with pytest.raises(err.NotIncreasing):
            w.append("a", 21, 9.0)
        w.append("c", 1, 0.0)
        with pytest.raises(err.BatchError):
            w.append_frame(frame.where("series = 'a'").withColumn("ts", F.col("ts") + 100))
        with pytest.raises(err.BatchError):
            w.append_frame(spark.createDataFrame([("c", 9, 1.0)], frame.schema))
        with pytest.raises(err.NotIncreasing):
            w.append_frame(spark.createDataFrame([("d", 9, 1.0), ("d", 9, 2.0)], frame.schema))
        w.checkpoint()
        with pytest.raises(err.NotIncreasing):
            w.append("b", 5, 1.0)
    assert [tuple(p) for p in Reader(spark, path).range("a", 0, 99)] == [(10, 1.0), (20, 2.0), (21, 9.0)]
    assert verify(spark, path).first().record_count == 5 and not os.listdir(f"{path}/staged")


def test_a_changed_byte_is_found(spark, path):
    with Writer(spark, path, create=True, codec="raw") as w:
        w.append_batch("a", list(range(1000)), [float(k) for k in range(1000)])
    for folder in ("data", "pages", "catalog"):
        name = next(os.path.join(d, f) for d, _, files in os.walk(f"{path}/{folder}") for f in files if f.endswith(".parquet"))
        with open(name, "rb") as f:
            data = bytearray(f.read())
        place = data.find(struct.pack("<d", 500.0)) if folder == "data" else len(data) // 3
        assert place > 0
        data[place + 3] ^= 1
        before = open(name, "rb").read()
        os.remove(os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc"))
        with open(name, "wb") as f:
            f.write(data)
        with pytest.raises(err.IntegrityError):
            verify(spark, path)
        with open(name, "wb") as f:
            f.write(before)
    assert verify(spark, path).count() == 1


def test_following_a_compacted_store(spark, path):
    with Writer(spark, path, create=True) as w:
        w.append_batch("a", [1, 2], [1.0, 2.0])
        w.append("b", 1, 1.0)
        assert w.checkpoint() == 2
        w.append("a", 3, 3.0)
        assert w.checkpoint() == 3
        w.append("c", 1, 4.0)
        w.append("a", 9, 5.0)
        assert w.checkpoint() == 4 and w.compact() == 5
        w.append("a", 10, 6.0)
        w.checkpoint()
    new = {k: sorted((r.series, r.ts) for r in follow(spark, path, since=k).collect()) for k in (1, 2, 3, 4, 5, 6)}
    last = [("a", 10)]
    assert new[6] == [] and new[5] == new[4] == last and new[3] == sorted([("c", 1), ("a", 9), *last]) and new[2] == sorted([("a", 3), *new[3]])
    assert new[1] == sorted([("a", 1), ("a", 2), ("b", 1), *new[2]])


def test_streams_keep_their_marks(spark, path):
    """Marks of several streams outlive other checkpoints; batches of refused rows only are noted too."""
    schema = "series string, ts long, value double"
    refused = []
    one = batch_writer(path, name="one", reject=lambda frame, k: refused.append((k, frame.count())))
    two = batch_writer(path, name="two")
    one(spark.createDataFrame([("a", 1, 1.0)], schema), 0)
    two(spark.createDataFrame([("b", 1, 1.0)], schema), 0)
    with Writer(spark, path) as w:
        w.append("z", 1, 1.0)
    one(spark.createDataFrame([("a", 1, 1.0)], schema), 0)
    two(spark.createDataFrame([("b", 1, 1.0)], schema), 0)
    one(spark.createDataFrame([("a", 1, 7.0)], schema), 1)
    one(spark.createDataFrame([("a", 1, 7.0)], schema), 1)
    assert refused == [(0, 0), (1, 1)]
    r = Reader(spark, path)
    assert sorted((p.series, p.ts, p.value) for p in r.points().collect()) == [("a", 1, 1.0), ("b", 1, 1.0), ("z", 1, 1.0)] and r.manifest["batches"] == {"one": 1, "two": 0}


def test_lookups_and_windows_by_pages(spark, path, monkeypatch):
    """Against plain loops over points, in several pages and segments, with NaNs, infinities and the ends of the 64-bit domain."""
    from seriesframe.plans import covered
    from seriesframe.sources import store

    monkeypatch.setattr(store, "PAGE_POINTS", 7)
    ts = [-(2**63), -500, *range(0, 300, 3), 1000, 2**63 - 1]
    odd = [float("nan"), float("inf"), -0.0, float("-inf"), 2.5]
    points = [(t, odd[k % 5] if k % 3 == 0 else float(k)) for k, t in enumerate(ts)]
    with Writer(spark, path, create=True) as w:
        for part in (points[:40], points[40:45], points[45:]):
            w.append_batch("a", [t for t, _ in part], [v for _, v in part])
            w.append_batch("b", [t // 2 for t, _ in part], [0.0] * len(part))
            w.checkpoint()
    r = Reader(spark, path)
    assert r.pages().count() > 30
    for target in (-(2**63), -(2**63) + 1, -1, 0, 121, 122, 299, 650, 651, 2**63 - 2, 2**63 - 1):
        before, after = max((t for t in ts if t <= target), default=None), min((t for t in ts if t >= target), default=None)
        near = before if after is None or before is not None and target - before <= after - target else after
        want = {LookupMode.EXACT: target if target in ts else None, LookupMode.PREDECESSOR: before, LookupMode.SUCCESSOR: after, LookupMode.NEAREST: near}
        for mode, t in want.items():
            found = r.lookup("a", target, mode)
            assert (found and found.ts) == t and (t is None or bits_of(found.value) == bits_of(dict(points)[t]))
    same = lambda a, b: a == b or a != a and b != b
    for limit in (covered.RANGES, 2):
        monkeypatch.setattr(covered, "RANGES", limit)
        for start, end, size in ((0, 299, 60), (-7, 260, 21), (5, 1200, 2)):
            frame, required = r.windows("a", start, end, size)
            got = {x.bucket: x for x in frame.collect()}
            assert required == len(got) == (end - start) // size + 1
            for k, x in got.items():
                inside = [(t, v) for t, v in points if start + k * size <= t <= min(end, start + k * size + size - 1)]
                numbers = [v for _, v in inside if v == v]
                nan = float("nan")
                want = (len(inside), min(numbers, default=nan), max(numbers, default=nan), sum(numbers), inside[0][1] if inside else nan, inside[-1][1] if inside else nan)
                assert all(same(a, b) for a, b in zip((x["count"], x.minimum, x.maximum, x.sum, x["first"], x["last"]), want, strict=True))


@pytest.fixture
def thrice(spark, tmp_path):
    """A folder with the smallest tables' events, each three times under other event ids, as `events`."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = events.count()
    copies = events.crossJoin(spark.range(3).withColumnRenamed("id", "k"))
    folder = str(tmp_path / "thrice")
    copies.withColumn("event_id", F.col("event_id") + F.col("k") * rows).drop("k").write.parquet(f"{folder}/events.parquet")
    return folder, copies.count()


def same_as_sql(spark, folder, name):
    """Rows of a store query and of its SQL."""
    import duckdb

    from seriesframe import special_queries, store_queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got = (store_queries.QUERIES | special_queries.QUERIES)[name](spark, folder)
    want = con.execute((store_queries.ORACLE_SQL | special_queries.ORACLE_SQL)[name])
    order = [d[0] for d in want.description]
    text = lambda rows: sorted(map(repr, rows))
    assert text(map(tuple, got.select(*order).collect())) == text(want.fetchall())


def test_generations_with_equal_timestamps(spark, thrice):
    same_as_sql(spark, thrice[0], "generations")


def test_ties_are_a_choice(spark, path):
    tied = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 1.0), ("a", 2, 2.0)], "series string, ts long, value double")
    with Writer(spark, path, create=True) as w, pytest.raises(err.NotIncreasing):
        w.append_frame(tied)
    with pytest.raises(err.StoreError):
        Writer(spark, path, ties=True)
    with Writer(spark, f"{path}2", create=True, ties=True) as w:
        w.append_frame(tied)
        assert w.checkpoint() == 2
        with pytest.raises(err.NotIncreasing):  # a later generation begins after what is published
            w.append_frame(tied)
        with pytest.raises(err.NotIncreasing):
            w.append("a", 2, 9.0)
        pos = tied.withColumn("pos", -F.col("ts")).withColumn("ts", F.col("ts") + 9)
        with pytest.raises(err.NotIncreasing):
            w.append_frame(pos, pos="pos")
    with Writer(spark, f"{path}2") as w:
        assert w.ties and w.reader.points().count() == 3


def test_aggregates_with_equal_timestamps(spark, thrice, path):
    same_as_sql(spark, thrice[0], "store_aggregate")
    t = sorted([k // 3 for k in range(20_000)] + [4000] * 9_000)
    with Writer(spark, path, create=True, ties=True) as w:
        w.append_batch("a", t, [1.0] * len(t))
    r = Reader(spark, path)
    for low, high in ((0, 9999), (1, 9999), (1362, 4000), (1363, 3999), (4000, 4000), (3000, 5000), (4001, 6000)):
        n = sum(low <= x <= high for x in t)
        assert r.count("a", low, high) == n and r.aggregate("a", low, high)[:4] == (n, 1.0, 1.0, float(n))
        windows = {w.bucket: w["count"] for w in r.windows("a", low, high, 1500)[0].collect()}
        assert windows == {b: sum(low + 1500 * b <= x < low + 1500 * (b + 1) and x <= high for x in t) for b in windows}


def test_catalog_with_equal_timestamps(spark, thrice):
    same_as_sql(spark, thrice[0], "store_catalog")


def test_cursor_with_equal_timestamps(spark, thrice, path, monkeypatch):
    from seriesframe.sources import store

    same_as_sql(spark, thrice[0], "store_cursor")
    t, v = [1, 2, 2, 2, 2, 2, 3, 4, 4], [0.0, -0.0, 0.0, value(NAN_BITS), float("nan"), -0.0, 1.0, 2.0, 1.0]
    with Writer(spark, path, create=True, ties=True) as w:
        w.append_batch("a", t, v)
    for ahead in (1, 4, 100):
        monkeypatch.setattr(store, "READ_AHEAD", ahead)
        r = Reader(spark, path)
        for size in (1, 2, 4, 9):
            at, seen = 1, []
            while at is not None:
                rows, at = r.cursor_next("a", at, 4, size)
                seen += rows
            assert [p.ts for p in seen] == t and sorted(bits_of(p.value) for p in seen) == sorted(map(bits_of, v))
    assert r.cursor_next("a", (2, 3), 4, 3)[1] == 4 and r.cursor_next("a", (2, 1), 4, 2)[1] == (2, 3)


def test_verify_with_equal_timestamps(spark, thrice, path):
    same_as_sql(spark, thrice[0], "verify_report")
    # equal timestamps on both sides of a page's end, and whole pages of one
    with Writer(spark, path, create=True, ties=True) as w:
        w.append_batch("a", [5] * 10_000 + [6], [1.0] * 10_001)
    assert verify(spark, path).first().record_count == 10_001


def test_batches_followed_with_equal_timestamps(spark, thrice, path):
    same_as_sql(spark, thrice[0], "store_batches_followed")
    with Writer(spark, path, create=True, ties=True, batch_size=2) as w:
        w.append_many("a", [(1, 1.0), (1, 2.0), (1, 3.0), (2, 4.0)])
        with pytest.raises(err.NotIncreasing):
            w.append("a", 1, 0.0)
        w.checkpoint()
        with pytest.raises(err.NotIncreasing):
            w.append("a", 2, 0.0)


def test_round_trip_with_equal_timestamps(spark, thrice):
    same_as_sql(spark, thrice[0], "store_round_trip")
