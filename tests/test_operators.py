import itertools
import math
import struct

import pytest
from pyspark.sql import functions as F

from seriesframe import errors as err
from seriesframe.functions.scalars import encode_record, plain_number
from seriesframe.operators import aggregate as A
from seriesframe.operators import envelope as E
from seriesframe.operators import scan as S
from seriesframe.operators.lookup import lookup, lookup_batch
from seriesframe.plans.covered import covered_aggregate
from seriesframe.types import LookupMode

LOW, HIGH = -(2**63), 2**63 - 1
NAN = float("nan")


def value(bits):
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


def frame(spark, rows):
    return spark.createDataFrame(rows, "series string, ts long, value double")


def test_scan_prefix_and_batches(spark):
    p = frame(spark, [("cpu", 2 * i, float(i)) for i in range(19)] + [("other", 1, 0.0)])
    assert [r.ts for r in S.range_scan(p, "cpu", 6, 30).collect()] == list(range(6, 31, 2))
    assert S.range_count(p, "cpu", 6, 30).first()[0] == 13
    assert S.range_count(p, "cpu", 30, 6).first()[0] == 0
    assert [r.ts for r in S.range_prefix(p, "cpu", 6, 30, 2).collect()] == [6, 8]
    batches = list(S.iterate(p, "cpu", 6, 30, 5))
    assert [len(b) for b in batches] == [5, 5, 3]
    at, seen = 6, []
    while at is not None:
        rows, at = S.next_page(p, "cpu", at, 30, 5)
        seen += rows
    assert seen == [x for b in batches for x in b]
    with pytest.raises(err.InvalidArguments):
        list(S.iterate(p, "cpu", 0, 1, 0))
    edge = frame(spark, [("a", HIGH - 1, 1.0), ("a", HIGH, 2.0)])
    assert S.next_page(edge, "a", HIGH - 1, HIGH, 2) == ([(HIGH - 1, 1.0), (HIGH, 2.0)], None)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    frame(spark, [("a", i, 1.0) for i in range(10)]).write.parquet(path)
    plan = S.range_count(spark.read.parquet(path), "a", 2, 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2)" in plan and "EqualTo(series,a)" in plan and "value" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_aggregates(spark):
    p = frame(spark, [("cpu", 1, 4.0), ("cpu", 2, 1.0), ("cpu", 3, 8.0), ("cpu", 4, 3.0), ("n", 1, NAN), ("n", 2, 5.0), ("n", 3, -1.0), ("z", 1, -0.0)])
    assert tuple(A.range_aggregate(p, "cpu", 2, 4).first()) == (3, 1.0, 8.0, 12.0, 1.0, 3.0)
    empty = tuple(A.range_aggregate(p, "cpu", 9, 10).first())
    assert empty[0] == 0 and empty[3] == 0.0 and all(math.isnan(empty[k]) for k in (1, 2, 4, 5))
    n = tuple(A.range_aggregate(p, "n", 1, 3).first())
    assert n[:4] == (3, -1.0, 5.0, 4.0) and math.isnan(n[4]) and n[5] == -1.0
    only = tuple(A.range_aggregate(p, "n", 1, 1).first())
    assert only[0] == 1 and math.isnan(only[1]) and only[3] == 0.0
    assert math.copysign(1, A.range_aggregate(p, "z", 1, 1).first()["sum"]) == 1
    assert {r.series: r["count"] for r in A.aggregate_by_series(p).collect()} == {"cpu": 4, "n": 3, "z": 1}
    merged = {r.series: r for r in A.merge_summaries(A.page_summaries(p, 2), "series").collect()}
    for r in A.catalog_summary(p).collect():
        assert all(x == y or x != x and y != y for x, y in zip(r, merged[r.series], strict=True))


@pytest.mark.parametrize("start,end", [(0, 99), (3, 17), (4, 7), (5, 5), (7, 3), (40, 50), (-5, -1)])
def test_covered_aggregate(spark, start, end):
    p = frame(spark, [("a", i, float(i % 7) if i % 5 else NAN) for i in range(30)] + [("b", 1, 1.0)])
    got, want = covered_aggregate(p, A.page_summaries(p, 4), "a", start, end).first(), A.range_aggregate(p, "a", start, end).first()
    assert all(x == y or x != x and y != y for x, y in zip(got, want, strict=True))


def test_windows(spark):
    p = frame(spark, [("a", -50 + 7 * i, float(i % 29)) for i in range(60)])
    rows = A.windows(p, "a", -43, 300, 25).orderBy("bucket").collect()
    assert len(rows) == A.windows_required(-43, 300, 25) == 14 and rows[-1].window_end == 300
    for r in rows:
        own = [(t, v) for _, t, v in p.collect() if r.window_start <= t <= r.window_end]
        assert r["count"] == len(own) and abs(r["sum"] - sum(v for _, v in own)) < 1e-6
    assert A.windows(p, "a", -43, 300, 25, capacity=2).count() == 2
    assert A.windows(p, "a", 10, 9, 5).count() == 0
    with pytest.raises(err.InvalidArguments):
        A.windows(p, "a", 0, 1, 0)
    with pytest.raises(err.InvalidArguments):
        A.windows(p, "a", LOW, HIGH, 1)
    edge = frame(spark, [("a", LOW, 1.0), ("a", 0, 2.0), ("a", HIGH, 3.0)])
    got = A.windows(edge, "a", LOW, HIGH, 2**62).orderBy("bucket").collect()
    assert [(r.window_start, r["count"]) for r in got] == [(LOW, 1), (LOW + 2**62, 0), (0, 1), (2**62, 1)] and got[-1].window_end == HIGH
    assert A.windows(edge, "a", LOW, HIGH, 2**64 - 1).collect()[0]["count"] >= 2
    several = A.windows(p.union(frame(spark, [("b", 0, 1.0)])), ["a", "b", "c"], 0, 9, 5)
    assert several.count() == 6


POINTS = [LOW, LOW + 1, -100, -10, 0, 10, 100, HIGH - 1, HIGH]
TARGETS = [LOW, LOW + 1, LOW + 2, -101, -100, -99, -55, -10, -5, -1, 0, 1, 5, 10, 55, 99, 100, 101, HIGH - 2, HIGH - 1, HIGH]


def brute(points, target, mode, limit):
    best = None
    for t in points:
        ok = {0: t == target, 1: t <= target, 2: t >= target, 3: True}[mode]
        if ok and (best is None or abs(t - target) < abs(best - target)):
            best = t
    return best if best is not None and (limit is None or abs(best - target) <= limit) else None


@pytest.mark.parametrize("chunk", [1_000_000, 2])
def test_lookup_batch(spark, chunk):
    p = frame(spark, [("signal", t, float(k)) for k, t in enumerate(POINTS)] + [("single", LOW, -0.0)])
    limits = [None, 0, 1, 2, 9, 2**64 - 1, 45, 44, 46]
    asked = [(s, t, m, x) for s, ts in (("signal", TARGETS), ("single", [HIGH]), ("none", [0])) for t in ts for m in range(4) for x in limits]
    from decimal import Decimal

    q = spark.createDataFrame([(k, s, t, m, None if x is None else Decimal(x)) for k, (s, t, m, x) in enumerate(asked)], "query_id int, series string, target long, mode int, max_distance decimal(20,0)")
    got = {r.query_id: r.ts for r in lookup_batch(p, q, chunk_points=chunk).collect()}
    stored = {"signal": POINTS, "single": [LOW], "none": []}
    assert got == {k: brute(stored[s], t, m, x) for k, (s, t, m, x) in enumerate(asked)}


def test_lookup_one(spark):
    p = frame(spark, [("pressure", 1000, 0.0), ("pressure", 1010, -0.0), ("pressure", 1030, NAN)])
    at = lambda m, x=None: [r.ts for r in lookup(p, "pressure", 1020, m, x).collect()]
    assert at(LookupMode.NEAREST, 10) == [1010] and at(LookupMode.PREDECESSOR, 9) == [] and at(LookupMode.SUCCESSOR) == [1030] and at(LookupMode.EXACT) == []
    with pytest.raises(err.InvalidArguments):
        lookup(p, "pressure", True, LookupMode.EXACT)
    with pytest.raises(err.InvalidArguments):
        lookup(p, "pressure", 2**63, LookupMode.EXACT)


def chart(points, bounds, gap):
    """The envelope by one walk over all points of a series: (counts by bucket, samples in order)."""
    nan = lambda v: v != v
    inside = [(t, v, next(k for k, (a, b) in enumerate(bounds) if a <= t <= b)) for t, v in points if any(a <= t <= b for a, b in bounds)]
    comp = [0]
    for (_, e), (s, _) in itertools.pairwise(bounds):
        comp.append(comp[-1] + (s != e + 1))
    wide = lambda i: i > 0 and comp[inside[i][2]] == comp[inside[i - 1][2]] and gap is not None and inside[i][0] - inside[i - 1][0] > gap
    counts, out, last = {}, [], None
    for k in range(len(bounds)):
        own = [i for i, x in enumerate(inside) if x[2] == k]
        num = [i for i in own if not nan(inside[i][1])]
        counts[k] = (len(own), len(num), len(own) != len(num), any(wide(i) for i in own[1:]))
        if not own:
            continue
        roles = {"first": own[0], "last": own[-1]}
        if num:
            roles["minimum"] = min(num, key=lambda i: (inside[i][1], inside[i][0]))
            roles["maximum"] = min(num, key=lambda i: (-inside[i][1], inside[i][0]))
        for i in sorted(set(roles.values())):
            if last is None:
                flags = (True, False, False, False, nan(inside[i][1]))
            else:
                j = last
                flags = (False, k - inside[j][2] > 1, comp[k] != comp[inside[j][2]], any(wide(x) for x in range(j + 1, i + 1)), any(nan(inside[x][1]) for x in range(j, i + 1)))
            out.append((k, inside[i][0], *[roles.get(r) == i for r in E.ROLES], *flags))
            last = i
    return counts, out


@pytest.mark.parametrize("chunk", [1_000_000, 1])
def test_envelope_against_a_walk(spark, chunk):
    """All histories of up to 4 of 5 values, under three geometries and three gaps; one series each, in one job for each setting."""
    pool = [0.0, -0.0, 1.0, -1.0, NAN]
    histories = [h for n in range(5) for h in itertools.product(range(5), repeat=n)]
    rows = [(str(k), 4 * i, pool[v]) for k, h in enumerate(histories) for i, v in enumerate(h)]
    p = frame(spark, rows).cache()
    for bounds, gap in zip([[(-10, 30)], [(-10, 0), (1, 3), (4, 30)], [(-10, 0), (8, 30)]], [0, 4, None], strict=True):
        counts, found = E.samples(p, bounds, max_gap=gap, chunk_points=chunk)
        got: dict = {}
        for r in found.orderBy("series", "ts").collect():
            got.setdefault(r.series, []).append((r.bucket, r.ts, *[r[f"is_{x}"] for x in E.ROLES], *[r[f"break_{x}"] for x in E.BREAKS]))
        have = {(r.series, r.bucket): (r.stored_count, r.numeric_count, r.has_nan, r.has_internal_time_gap) for r in counts.collect()}
        for k, h in enumerate(histories):
            want_counts, want = chart([(4 * i, pool[v]) for i, v in enumerate(h)], bounds, gap)
            assert got.get(str(k), []) == want, (h, bounds, gap)
            for b, c in want_counts.items():
                assert have.get((str(k), b), (0, 0, False, False)) == c, (h, bounds, gap)
    p.unpersist()


def test_envelope_product_fixture(spark):
    bits = [0x0, 0x408F400000000000, 0xC08F400000000000, 0x8000000000000000, 0x1, 0x8000000000000001, 0x7FF8000000000123, 0xFFF0000000000000, 0x7FF0000000000000, 0x7FF0000000000011]
    offsets = [0, 1, 2, 3, 4, 12, 13, 14, 15, 19]
    p = frame(spark, [("a", 20 * k + o, value(b)) for k in range(1200) for o, b in zip(offsets, bits, strict=True)])
    bounds = [(20 * k + 5, 20 * k + 10) if k % 13 == 0 else (20 * k + 1, 20 * k + 19) if k % 17 == 0 else (20 * k, 20 * k + 19) for k in range(1200)]
    assert E.samples(p, bounds, max_gap=6)[1].count() == 4428
    whole = E.envelope(p, "a", bounds, max_gap=6)
    assert whole.count() == 1200 and whole.agg(F.sum("sample_count")).first()[0] == 4428


def test_envelope_domain(spark):
    p = frame(spark, [("a", LOW, -0.0), ("a", HIGH, NAN)])
    for gap, wide in ((2**64 - 1, False), (2**64 - 2, True)):
        r = E.envelope(p, "a", [(LOW, HIGH)], max_gap=gap).first()
        assert r.has_internal_time_gap is wide and r.has_nan and r.samples[1].break_before.time_gap is wide
    for bad in ([(2, 1)], [(0, 2), (2, 3)], [(5, 6), (0, 1)]):
        with pytest.raises(err.InvalidArguments):
            E.envelope(p, "a", bad)
    assert E.viewport(0, 9, 3) == [(0, 2), (3, 5), (6, 9)] and E.viewport(0, 1, 5) == [(0, 0), (1, 1)] and E.viewport(1, 0, 2) == []


@pytest.mark.parametrize("chunk", [1, 3, 7])
def test_long_series_in_chunks(spark, chunk):
    """Pages, batches and previous rows of series that are cut give what uncut ones give: outliers, ties of cuts, null keys and nulls included."""
    rows = [("long", t, float(t % 11)) for t in [LOW, LOW + 1, *range(0, 400, 7), 10**15, 2**62 + 1, 2**62 + 2, HIGH]] + [("b", 5, 1.0), (None, 3, 2.0), (None, 1, NAN)]
    p = frame(spark, rows)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert same(A.page_summaries(p, 4, chunk_points=chunk), A.page_summaries(p, 4))
    for start, end in ((LOW, HIGH), (0, 100), (5, 4)):
        assert same(S.cursor_batches(p, "long", start, end, 3, chunk_points=chunk), S.cursor_batches(p, "long", start, end, 3))
    moved = [(k, n, i // 2, i % 2, None if i % 13 == 5 else (i * 7) % 23) for n, k in ((60, "a"), (9, None)) for i in range(n)]
    q = spark.createDataFrame(moved, "series string, n int, pos long, sub int, ts long")
    assert same(S.order_violations(q, series=["series", "n"], pos=["pos", "sub"], ts="ts", chunk_points=chunk), S.order_violations(q, series=["series", "n"], pos=["pos", "sub"], ts="ts"))
    assert S.order_violations(q, series="series", pos=["pos", "sub"], ts="ts", chunk_points=chunk).count() > 5


def test_order_violations(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 1, 3), ("a", 2, 3), ("a", 3, 2), ("b", 0, 9)], "series string, pos long, ts long")
    assert [(r.pos, r.previous_ts) for r in S.order_violations(rows, series="series", pos="pos", ts="ts").orderBy("pos").collect()] == [(2, 3), (3, 3)]


def test_scalars():
    assert encode_record(1, 2.0) == struct.pack("<qd", 1, 2.0)
    assert plain_number(100.0) == "100" and plain_number(0.1) == "0.1" and plain_number(1e21) == "1" + "0" * 21 and plain_number(5e-324).startswith("0.000") and plain_number(5e-324).endswith("5")


@pytest.mark.parametrize("start,end", [(0, 99), (1, 5), (2, 2), (3, 7), (6, 9), (9, 3), (4, 4)])
def test_covered_aggregate_with_equal_timestamps(spark, start, end):
    p = frame(spark, [("a", k // 3, float(k // 3)) for k in range(30)] + [("a", 4, 4.0)] * 9)
    for size in (1, 2, 4, 7):
        got, want = covered_aggregate(p, A.page_summaries(p, size), "a", start, end).first(), A.range_aggregate(p, "a", start, end).first()
        assert all(x == y or x != x and y != y for x, y in zip(got, want, strict=True))


def test_exact_batch_gives_every_point_at_the_target(spark):
    p = frame(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("a", 2, 3.0), ("b", 2, 9.0)])
    q = spark.createDataFrame([(1, "a", 2, 0), (1, "a", 2, 0), (2, "a", 3, 0), (3, "c", 2, 0), (4, "b", 2, 1)], "query_id int, series string, target long, mode int")
    want = [(1, 2.0), (1, 2.0), (1, 3.0), (1, 3.0), (2, None), (3, None)]
    plain = lookup_batch(p, q.where("mode = 0").drop("mode"), mode=LookupMode.EXACT).collect()
    assert sorted((r.query_id, r.value) for r in plain if r.value) + [(r.query_id, None) for r in sorted(plain) if r.value is None] == want
    mixed = lookup_batch(p, q).collect()
    assert sorted(map(repr, ((r.query_id, r.value) for r in mixed))) == sorted(map(repr, [*want, (4, 9.0)]))
