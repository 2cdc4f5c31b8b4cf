"""The pipeline's stages, each on its predecessor's result, against brute force."""

import os
import re
import zlib

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp
    from seriesframe.llm import queries
    from tests.llm.test_texts import WORD, shingle_set, slow_components

    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "near_dedup", "substring_dedup", "source_mix", "tokens"]
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        seen.append({r.doc_id: r for r in docs.collect()})
        if k < len(cp.STAGES) - 1:
            assert tuple(docs.columns) == cp.COLUMNS
    whole = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    quality, near, short, mixed, tokens = seen
    accepted = {r.doc_id for r in queries.op2_quality_qda(spark, SF).collect() if r.predicted == 1}
    assert set(quality) == accepted and all(quality[i].text == whole[i].text for i in quality)
    assert set(near) == {i for i, _, c in slow_components([(i, r.text) for i, r in quality.items()]) if i == c}
    assert all(near[i].text == whole[i].text for i in near) and any(shingle_set(r.text) for r in near.values())
    assert set(short) == set(near) == set(mixed) == set(tokens)
    import collections

    words = {i: WORD.findall(r.text) for i, r in near.items()}
    count = collections.Counter(tuple(w[a : a + 35]) for w in words.values() for a in range(len(w) - 34))
    for i, w in words.items():
        gone = {k for a in range(len(w) - 34) if count[tuple(w[a : a + 35])] > 1 for k in range(a, a + 35)}
        want = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else near[i].text
        assert short[i].text == want and short[i].n_chars == len(want)
        assert mixed[i] == short[i]
        assert tokens[i].exact and tokens[i].n_tokens == len(tokens[i].ids)
    assert re.fullmatch("[0-9a-f]{64}", next(iter(tokens.values())).decoded_sha256) and zlib.crc32(b"0") % 4 in range(4)


@pytest.fixture
def small_splits(spark):
    """Settings under which Spark's reader doesn't keep the order of files, and writes several."""
    new = {"spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_tokens_keep_the_order_of_files(spark, tmp_path, small_splits):
    import corpus_pipeline as cp

    out, n = str(tmp_path / "mixed"), 0
    for k, count in enumerate((3, 400, 1, 90, 0, 250)):  # files of unequal sizes, one of them with several splits
        rows = [(i, f"text {i} " + str(zlib.crc32(str(i).encode())) * (1 + i % 20), "en", "a", 50) for i in range(n, n + count)]
        n += count
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{out}/{k}")
    os.makedirs(f"{out}/all")
    for k in range(6):
        for name in os.listdir(f"{out}/{k}"):
            if name.startswith("part-"):
                os.rename(f"{out}/{k}/{name}", f"{out}/all/part-{99997 + k:05d}-x-c000.snappy.parquet")
    docs = spark.read.parquet(f"{out}/all")
    got = cp.tokens(spark, docs, "").collect()
    assert [(r.doc_id, r.position) for r in got] == [(i, i) for i in range(n)]
    plain = spark.createDataFrame([(i, f"t{i}", "en", "a", 2) for i in range(100)], docs.schema)
    assert [(r.doc_id, r.position) for r in cp.tokens(spark, plain, "").collect()] == [(i, i) for i in range(100)]


def test_order_of_the_run(spark, small_splits, monkeypatch):
    """run() against the schedule slot by slot; its first three stages are held by test_stages."""
    import collections
    import hashlib

    import corpus_pipeline as cp
    from seriesframe.llm import mixing
    from tests.llm.test_models import slow_schedule

    monkeypatch.setattr(cp, "STAGES", cp.STAGES[-2:])
    got = cp.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_source = collections.defaultdict(list)
    for r in sorted(docs.select("doc_id", "source").collect(), key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest()):
        by_source[r.source].append(r.doc_id)
    turns, want, slots = collections.Counter(), [], slow_schedule(mixing.tempered_weights(docs))
    while len(want) < len(got):
        for s in slots:
            want += by_source[s][8 * turns[s] : 8 * turns[s] + 8]
            turns[s] += 1
    assert len(by_source) > 1 and [r.doc_id for r in got] == want and [r.position for r in got] == list(range(len(want)))


def test_repeated_ids(spark):
    import corpus_pipeline as cp

    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text, "en", "b", 5), (3, "other words here", "en", "a", 5), (None, text, "en", "a", 5), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0) for r in cp.near_dedup(spark, docs, "").collect()) == [0, 0, 1, 3]
    empty = docs.limit(0)
    for _, stage in cp.STAGES[1:]:
        assert stage(spark, empty, "").count() == 0


def test_odd_rows(spark, tmp_path):
    """Every stage on nulls in any column, empty and very long texts, repeated rows and ids, clashing columns, and an empty table."""
    import corpus_pipeline as cp
    from tests.llm.test_texts import WORD, slow_dedup

    whole = spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()
    passage = " ".join(f"p{k}" for k in range(60))
    long_ = " ".join(f"w{k}" for k in range(120_000))
    rows = [tuple(r) for r in whole] + [tuple(whole[0]), tuple(whole[0])]
    rows += [(9001, None, None, None, None), (9002, "", "en", None, 0), (9003, long_ + " " + passage, "en", "a", 7), (9004, "x y z " + passage, None, "a", None), (None, "words of a row without id", "en", "b", 3), (None, None, None, None, None), (None, None, None, None, None)]
    rows += [(9005, "one text", "en", "a", 1), (9005, "another text", "en", "a", 1), (9005, "one text", "en", "b", 1)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    clash = {c: 1 for c in ("_score", "_predicted", "id", "runs", "_runs", "mix_slot", "_s", "position", "ids", "exact", "_h", "_n")}
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash)
    docs = spark.createDataFrame([(*r, *clash.values()) for r in rows], schema).repartition(3)
    out = {}
    for name, stage in cp.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = [tuple(r) for r in spark.read.parquet(path).collect()]
        if name != "tokens":
            assert spark.read.parquet(path).columns == names
        assert stage(spark, docs.limit(0), SF).count() == 0
    scored = {(r.doc_id, r.text): r.predicted for r in __import__("seriesframe.llm.quality", fromlist=["x"]).score(docs, _model(spark, docs), keep=["doc_id", "text"]).collect()}
    assert sorted(out["quality"], key=str) == sorted((r for r in rows if scored[r[0], r[1]]), key=str)
    near = out["near_dedup"]
    assert sum(r[0] is None for r in near) == 3 and len([r for r in near if r[0] == 9005]) == 1 and len({r[0] for r in near}) - 1 == len([r for r in near if r[0] is not None])
    assert {9001, 9002, 9003, 9004, whole[0].doc_id} <= {r[0] for r in near}
    want = {(i, n, gone) for i, n, gone, _ in slow_dedup([(r[0], r[1]) for r in rows], 35)}
    for r in out["substring_dedup"]:
        kept = len(WORD.findall(r[1] or ""))
        assert any(i == r[0] and n - gone == kept for i, n, gone in want)
    assert sorted(out["source_mix"], key=str) == sorted(rows, key=str)
    assert sorted(str((r[0], r[1])) for r in out["tokens"]) == sorted(str((r[0], r[3])) for r in rows) and all(r[-1] for r in out["tokens"])
    assert sorted(r[2] for r in out["tokens"]) == list(range(len(rows)))


def _model(spark, docs):
    from seriesframe.llm import quality, training
    from seriesframe.llm.queries import PER_CLASS

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return quality.fit(training.labelled(docs, labels, label="quality", per_class=PER_CLASS, skip=(4, 2)))


def test_repeated_ids_keep_the_least(spark):
    """The row that stays doesn't depend on the order of rows."""
    import hashlib

    import corpus_pipeline as cp

    rows = [(1, f"text number {k % 7} here", "en", "ab"[k % 2], k % 3) for k in range(40)]
    want = min(rows, key=lambda r: (hashlib.md5(r[1].encode()).hexdigest(), *r[1:]))
    for n in (1, 5):
        docs = spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
        assert [tuple(r) for r in cp.near_dedup(spark, docs, SF).collect()] == [want]
