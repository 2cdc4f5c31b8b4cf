"""Dedup, fingerprints and tokens against brute force."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest

from seriesframe.llm import fingerprint, neardup, queries, spm, substring
from seriesframe.llm.fmindex import FMIndex, repeated_windows, suffix_array

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for k, (i, _) in enumerate(rows):
        for j in range(k):
            a, b = sets[k], sets[j]
            if a and b and i is not None and rows[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(rows[j][0])
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def test_near_duplicates(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(15):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 40, 150]))]
        for _ in range(rng.choice([1, 1, 2, 5, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, "a b c"), (5003, "A B"), (5004, "a b"), (5005, rows[3][1]), (5005, rows[9][1]), rows[2], rows[2]]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, n int").repartition(4)
    out = neardup.classify(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == slow_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in out)
    assert neardup.classify(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in queries.ORACLE_SQL])
def test_query_matches_sql(spark, compare, tmp_path, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF, tmp_path)


def test_texts_of_a_template(spark):
    """20,000 texts that share 3 of 4 shingles (similarity 0.6) in one bucket: no pair of them is made, whatever their number."""
    rows = [(k, f"a b c d e f g w{k}") for k in range(20_000)] + [(30_000, "a b c d e f g w7 x"), (30_001, "a b c d e f g w7 x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r.doc_id: r.component_id for r in neardup.classify(docs).collect()}
    want = dict.fromkeys([7, 30_000, 30_001], 7)  # 4 of 5
    assert len(out) == len(rows) and all(c == want.get(i, i) for i, c in out.items())


def test_buckets_of_several_components(spark):
    """Members of one bucket that a prefix filter must bring together, in large and small components, against all pairs."""
    rng = random.Random(11)
    base = [f"t{i}" for i in range(24)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 5)}"
        rows.append((k * 31 % 997, " ".join(w[: rng.choice([8, 12, 16, 24, 24])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.classify(docs).collect()), key=str) == slow_components(rows)


def test_very_long_texts(spark):
    """Texts of many pieces, twice and nearly twice, with one that holds a part of them."""
    rng = random.Random(12)
    long_ = [rng.choice("abcdefgh") + str(rng.randint(0, 9999)) for _ in range(150_000)]
    other = list(long_)
    other[70_000] = "zz"
    rows = [(1, " ".join(long_)), (2, " ".join(long_)), (3, " ".join(other)), (4, " ".join(long_[1000:1100])), (5, "few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.classify(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert sorted((tuple(r) for r in substring.digests(docs).collect()), key=str) == slow_dedup(rows, 35)
    got = {r.doc_id: r for r in fingerprint.compare_neighbours(docs, matched=fingerprint.matches(docs)).collect()}
    assert got[1].fingerprint == got[2].fingerprint and got[2].match_jaccard == 1.0 and got[3].match_id == 1 and got[3].match_jaccard > 0.99 and got[4].match_id is None


def slow_dedup(rows, window):
    texts = [WORD.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = {k for a in range(len(w) - window + 1) if count[tuple(w[a : a + window])] > 1 for k in range(a, a + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,anchor,split,words", [(6, 3, 1, 5), (35, 8, 2000, 2000)])
def test_substrings(spark, monkeypatch, window, anchor, split, words):
    rng = random.Random(5)
    vocabulary = [f"é{i}" if i % 3 else f"w{i}" for i in range(words)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(window, 3 * window))] for _ in range(6)]
    rows = []
    for d in range(100):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(vocabulary) for _ in range(rng.randint(0, window))]
            if rng.random() < 0.4:
                p = rng.choice(passages)
                w += p[rng.randint(0, window // 2) : len(p) - rng.randint(0, window // 3)]
        rows.append((d, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(900, None), (901, ""), (None, "a b"), (3, rows[8][1]), rows[20], rows[20], (902, "x " * 200)]
    docs = spark.createDataFrame([(i, t, "clash", 1, 2, 3) for i, t in rows], "doc_id long, text string, runs string, _runs int, _ID int, _th int").repartition(4)
    options = {"window": window, "anchor": anchor, "split_above": split, "shard_words": 700}
    assert sorted((tuple(r) for r in substring.digests(docs, **options).collect()), key=str) == slow_dedup(rows, window)
    if window == 6:
        kept = substring.remove(docs, **options)
        assert kept.columns == docs.columns and {r[2:] for r in kept.collect()} == {("clash", 1, 2, 3)} and kept.count() == len(rows)
        monkeypatch.setattr(substring, "TASKS", 2)  # many shards in a task
        monkeypatch.setattr(substring, "SHARDS_IN_TASK", 5)
        assert sorted((tuple(r) for r in substring.digests(docs, **options).collect()), key=str) == slow_dedup(rows, window)
        assert substring.digests(docs.limit(0), **options).count() == 0


def test_banding_misses_few():
    """A pair at similarity 0.75 has no half key in common in one of the two collections: as rarely as with 16 halves of 2 minima."""
    none = (1 - 0.75**neardup.MINIMA) ** neardup.HALVES
    assert 1 - (1 - none) ** 2 <= 1 - (1 - (1 - 0.75**2) ** 16) ** 2 < 4e-6
    assert 2 * neardup.HALVES * neardup.MINIMA <= len(fingerprint._A)


def test_index():
    rng = np.random.default_rng(0)
    for _ in range(20):
        window, symbols = int(rng.choice([3, 5, 8])), int(rng.choice([2, 4, 50]))
        items = [rng.integers(1, symbols + 1, rng.integers(0, 4 * window)) for _ in range(12)]
        seq = np.concatenate([np.concatenate([s, [0]]) for s in items])
        ends = np.cumsum([len(s) + 1 for s in items]) - 1
        begin = ends - [len(s) for s in items]
        count = collections.Counter(tuple(s[i : i + window]) for s in items for i in range(len(s) - window + 1))
        got = repeated_windows(FMIndex(seq), seq, begin, ends, window)
        assert [g.tolist() for g in got] == [[count[tuple(s[i : i + window])] > 1 for i in range(len(s) - window + 1)] for s in items]
        whole = np.concatenate([seq + 1, [0]])
        assert suffix_array(whole).tolist() == sorted(range(len(whole)), key=lambda i: whole[i:].tolist())


def test_neighbours(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["a", "bé ", "c\n", "word ", "xy "]) for _ in range(rng.choice([0, 1, 2, 5, 50, 400])))) for i in range(150)] + [(7, "dup one two"), (7, "dup"), (None, "nil"), (400, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int").repartition(5)
    got = fingerprint.compare_neighbours(docs, part_bytes=3000).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    for k, (i, t) in enumerate(order):
        following, half = order[(k + 1) % len(order)][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = {}
    texts = {(i, len(t or "")): t or "" for i, t in rows}
    for r in got:
        by_text.setdefault(texts[r.doc_id, r.n_chars], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprint.compare_neighbours(docs.limit(0)).count() == 0


@pytest.mark.parametrize("with_null", [False, True])
def test_neighbours_of_large_ids(spark, with_null):
    """Ids that doubles don't hold, over many ranges: each row has its result, with the next document's text."""
    rng = random.Random(5)
    ids = sorted({rng.randrange(-(2**63), 2**63) for _ in range(300)} | {2**62 + k for k in range(300)} | {-(2**63), 2**63 - 1}, reverse=True)
    rows = [(i, f"text of {i} " * rng.choice([1, 3])) for i in ids] + [(None, "nil")] * with_null
    following = [rows[(k + 1) % len(rows)][1] for k in range(len(rows))]
    want = [(i, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for (i, t), n in zip(rows, following, strict=True)]
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string")
    got = fingerprint.compare_neighbours(docs, part_bytes=1000).collect()
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)


def test_likeness_estimates_jaccard():
    rng = random.Random(4)
    for share in (0.2, 0.5, 0.9):
        a = [str(rng.random()) for _ in range(3000)]
        b = a[: int(3000 * share)] + [str(rng.random()) for _ in range(3000 - int(3000 * share))]
        import pyarrow as pa

        s = fingerprint._arrow_signatures(pa.array([" ".join(a), " ".join(b)], pa.large_string()), 256)
        x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        assert abs(fingerprint.likeness(s[0], s[1]) - len(x & y) / len(x | y)) < 0.12


def exact_set(text):
    """Five-word shingles without lower-casing."""
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_matches(spark, monkeypatch):
    """Verified matches against all pairs; the neighbours' query carries them."""
    rng = random.Random(6)
    rows = []
    for _ in range(12):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(rng.choice([3, 20, 70]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "zz"
            rows.append((len(rows) * 17 % 503, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " "), (None, rows[0][1]), rows[4], (903, rows[4][1].replace(" ", "  ")), (904, "Upper Case"), (905, "upper case"), (rows[7][0], "another text of this id")]
    docs = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], "doc_id long, text string, h string, match_id int").repartition(3)
    got = {(r.doc_id, r.h): (r.match_id, r.match_jaccard) for r in fingerprint.matches(docs).collect()}
    near = lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b)
    matched = 0
    for i, t in rows:
        s, m = exact_set(t), got.get((i, hashlib.md5((t or "").encode()).hexdigest()))
        least = min((j for j, u in rows if j is not None and near(s, exact_set(u))), default=i)
        if i is None or least is None or not s or least == i:
            assert m is None
        elif m is None:  # no bucket had a nearer centre: every partner is one of its own class or reached through another
            raise AssertionError((i, t))
        else:
            assert m[0] >= least and any(j == m[0] and near(s, exact_set(u)) and abs(m[1] - len(s & exact_set(u)) / len(s | exact_set(u))) < 1e-12 for j, u in rows)
            matched += m[0] == least
    assert matched > 10
    out = fingerprint.compare_neighbours(docs, matched=fingerprint.matches(docs), part_bytes=2000).collect()
    assert len(out) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(hashlib.md5((t or "").encode()).hexdigest())
    for r in out:
        assert (r.match_id, r.match_jaccard) in [got.get((r.doc_id, h), (None, None)) for h in texts[r.doc_id]]
    assert sum(r.match_id is not None for r in out) == sum((i, hashlib.md5((t or "").encode()).hexdigest()) in got for i, t in rows)
    assert fingerprint.matches(docs.limit(0)).count() == 0
    from seriesframe.llm import tables

    monkeypatch.setattr(tables, "BROADCAST_IDS", 0)  # the other way to pick documents
    assert {(r.doc_id, r.h): (r.match_id, r.match_jaccard) for r in fingerprint.matches(docs).collect()} == got


@pytest.mark.parametrize("bucket", [fingerprint.BUCKET, 1])
def test_links_past_the_centre(spark, bucket):
    """Every pair that meets the threshold counts, also where the least of their bucket is like neither, in buckets of any size."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 10**9)}"
    head = [word() for _ in range(58)]  # not enough for a link: 54 shingles of 74
    texts = [" ".join(head + [word() for _ in range(10)]) for _ in range(100)]
    for _ in range(15):  # two shingles more are: 56 of 72
        more = [word(), word()]
        texts += [" ".join(head + more + [word() for _ in range(8)]) for _ in range(2)] * rng.choice([1, 1, 2])
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(9000, None), (9001, " "), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [(i, exact_set(t)) for i, t in rows]
    want = {}
    for i, s in sets:
        if i is not None:
            near = {j: len(s & u) / len(s | u) for j, u in sets if j not in (i, None) and s and u and 100 * len(s & u) >= 75 * len(s | u)}
            low = min([j for j in near if j < i], default=None)
            want[i] = (min([j for j, u in sets if j is not None and u == s and s] + [i]), len(near), low, near.get(low))
    assert sum(n > 0 for _, n, _, _ in want.values()) == len(texts) - 100
    links = fingerprint.links(docs, bucket=bucket)
    out = fingerprint.compare_neighbours(docs, matched=links, part_bytes=2000).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.match_id, r.match_jaccard) for r in out if r.doc_id is not None} == want
    assert [(r.class_id, r.n_links, r.match_id) for r in out if r.doc_id is None] == [(None, 0, None)]
    assert {r.doc_id: r.match_id for r in fingerprint.matches(docs, bucket=bucket).collect()} == {i: m for i, (_, _, m, _) in want.items() if m is not None}


@pytest.mark.parametrize("cell", [fingerprint.CELL, 500])
def test_links_are_no_rows(spark, monkeypatch, cell):
    """300 texts all linked with each other, in cells of one or many blocks: no table holds their 44,850 pairs, and all links count."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for k in range(300):
        w = list(base)
        w[rng.randrange(1, 100)] = f"x{k}"
        texts.append(" ".join(w))
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)] + [(5000, texts[7]), (5001, texts[7]), (6000, "alone"), (6001, None)]
    sets = [(i, exact_set(t)) for i, t in rows]
    want = {}
    for i, s in sets:
        near = {j: len(s & u) / len(s | u) for j, u in sets if j != i and s and 100 * len(s & u) >= 75 * len(s | u)}
        low = min([j for j in near if j < i], default=None)
        if near:
            want[i] = (min(j for j, u in sets if u == s), len(near), low, near.get(low))
    assert sum(n for _, n, _, _ in want.values()) > 80_000
    saved, save = {}, fingerprint.Workspace.save

    def counted(self, frame, name):
        out = save(self, frame, name)
        saved[name] = out.count()
        return out

    monkeypatch.setattr(fingerprint.Workspace, "save", counted)
    out = fingerprint.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), cell=cell).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.match_id, r.match_jaccard) for r in out} == want
    if cell == fingerprint.CELL:
        assert max(saved.values()) <= 304 * (fingerprint.SLOTS // fingerprint.BAND)
    else:
        assert saved["cells"] > 3000  # many blocks


def test_one_bucket_stays_linear(spark):
    """4,000 texts with one centre: candidates are as many as texts, not their square."""
    base = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(k, " ".join([*base, f"x{k}"])) for k in range(4000)], "doc_id long, text string")
    out = fingerprint.matches(docs).collect()
    assert len(out) == 3999 and {r.match_id for r in out} == {0} and min(r.match_jaccard for r in out) > 0.9


def test_signatures_by_brute_force():
    """Slots as minima over single hashes; texts longer than the pieces that are hashed at once too."""
    import pyarrow as pa

    rng = random.Random(8)
    texts = ["", "a", "a b c d", "a b c d e", " ".join(rng.choice("abc") for _ in range(50)), " ".join(str(rng.random()) for _ in range(fingerprint._PIECE + 1000)), "a b c d e"]
    data, offsets = fingerprint.tc.raw(pa.array(texts, pa.large_string()))
    h, first = fingerprint.shingles(data, offsets)
    s = fingerprint._arrow_signatures(pa.array(texts, pa.large_string()), 16)
    known = {}
    for k, t in enumerate(texts):
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        own = h[first[k] : first[k + 1]].tolist()
        assert len(own) == len(grams) and all(known.setdefault(g, x) == x for g, x in zip(grams, own, strict=True))
        for i in range(16):
            a, b = int(fingerprint._A[i]), int(fingerprint._B[i])
            assert int(s[k, i]) == min((((x * a + b) & (2**64 - 1)) >> 32 for x in set(own)), default=0xFFFFFFFF)
    assert len(set(known.values())) == len(known)
    one, two = fingerprint.set_hashes(*fingerprint.distinct(h, first))  # equal sets have equal hashes wherever they stand
    assert one.dtype == two.dtype == np.int64 and (one[3], two[3]) == (one[6], two[6]) and len(set(one)) == len(set(two)) == len(texts) - 1


@pytest.mark.skipif(not os.path.isfile(spm.MODEL_PATH), reason="no tokenizer files")
def test_tokens(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model, library = spm.load(), sentencepiece.SentencePieceProcessor(model_file=spm.MODEL_PATH)
    rng = random.Random(1)
    texts = ["", "a", " ", "  ", "   a  b    ", "\n", "\n\n\nabc", "<s></s><0x0A>", "日本語テキスト 梦 ", "😀 mixed 😀😀", "a" * 100, "\t\ttab", " " * 33 + "z" + " " * 7, "aaaa aaaaaa", "Ümlaut straße"]
    texts += ["".join(rng.choice("ab c  de\nth ingé梦😀_-.#") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    ids, at = spm.Encoder(model).encode(texts)
    for k, t in enumerate(texts):
        own = ids[at[k] : at[k + 1]].tolist()
        assert own == library.encode(t) and spm.decode(model, own) == t == (library.decode(own) or t)
    docs = spark.createDataFrame([(k, t, [1]) for k, t in enumerate([*texts[:20], None])], "doc_id long, text string, ids array<int>")
    out = spm.round_trip(docs, model).collect()
    assert len(out) == 21 and all(r.exact for r in out) and spm.encode_column(docs, model).columns == ["doc_id", "text", "ids"]
    back = spm.decode_column(spm.encode_column(docs, model).drop("text"), model).collect()
    assert sorted(r.text for r in back) == sorted([*texts[:20], ""])
    assert spm.round_trip(docs.limit(0), model).count() == 0


@pytest.mark.skipif(not os.path.isfile(spm.MODEL_PATH), reason="no tokenizer files")
def test_tokens_of_many_texts():
    """10,000 whole documents, runs of spaces, text without spaces, and a very long text, against the library."""
    import pyarrow.parquet as pq

    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=spm.MODEL_PATH)
    encoder, rng = spm.Encoder(spm.load()), random.Random(2)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()[:10_000]] if os.path.isdir("/root/testdata/sf0.1") else []
    texts += [" " * k + "the x" + " " * k + "1" for k in range(80)] + ["".join(rng.choice(["the", " ", "  ", " " * 9, "ing", "\n", "\t", "▁", "é"]) for _ in range(60)) for _ in range(500)]
    texts += ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000)), "ab" * 5000, " " * 5000]
    for a in range(0, len(texts), 2000):
        part = texts[a : a + 2000]
        ids, at = encoder.encode(part)
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == library.encode(part)
    whole = " ".join(texts[:800])  # one text of a few MB
    ids, at = encoder.encode([whole, ""])
    assert at[1] == at[2] == len(ids) and ids.tolist() == library.encode(whole)


@pytest.mark.skipif(not os.path.isfile(spm.MODEL_PATH), reason="no tokenizer files")
def test_tokens_with_little_memory(monkeypatch):
    """Forgetting words, pairs and steps changes nothing."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeinorst ,.") for _ in range(200)) for _ in range(60)]
    model = spm.load()
    want = [spm.Encoder(model).encode([t])[0].tolist() for t in texts[:20]]
    monkeypatch.setattr(spm, "BYTES_KEPT", 100)
    monkeypatch.setattr(spm, "PAIRS_KEPT", 10)
    monkeypatch.setattr(spm, "STEPS_KEPT", 5)
    small = spm.Encoder(model)
    assert [small.encode([t])[0].tolist() for t in texts[:20]] == want and len(small.index) < 100 and small.pieces.spare == 0


def test_unigram_against_all_segmentations():
    """The same search with summed scores, on a small model."""
    pieces = ["<unk>"] + [f"<0x{b:02X}>" for b in range(256)] + ["▁", "a", "b", "ab", "▁a", "ba", "aba", "bb"]
    rng = random.Random(0)
    model = spm.Model(pieces, [0.0] * 257 + [rng.uniform(-9, -1) for _ in range(8)], [2] + [6] * 256 + [1] * 8, 1, True)

    def best(word):
        if not word:
            return 0.0, []
        options = []
        for n in range(1, len(word) + 1):
            score, rest = best(word[n:])
            if word[:n] in model.ids:
                options.append((model.scores[model.ids[word[:n]]] + score, [model.ids[word[:n]], *rest]))
            elif n == 1:
                options.append((model.unknown_score + score, [model.byte_ids[b] for b in word[0].encode()] + rest))
        return max(options)

    words = sorted({"▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(60)})
    flat, ends = spm.encode_words(model, words)
    for w, ids in zip(words, np.split(flat, ends[:-1]), strict=True):
        score = sum(model.scores[i] if model.kinds[i] == 1 else model.unknown_score for i in ids)
        assert abs(score - best(w)[0]) < 1e-9 and spm.decode(model, ids) == w.replace("▁", " ")[1:]


def test_arrow_batches_are_bounded_by_bytes(spark):
    import pyarrow as pa

    from seriesframe.llm import tables

    key, size = "spark.sql.execution.arrow.maxBytesPerBatch", tables.BATCH_BYTES
    before = spark.conf.get(key)
    try:
        for given, then in (("64m", str(size)), (str(size), str(size)), ("1m", "1m"), ("2048k", "2048k"), ("1g", str(size))):
            spark.conf.set(key, given)
            tables.small_batches(spark)
            assert spark.conf.get(key) == then
        spark.conf.set(key, "64m")
        tables.small_batches(spark)
        texts = spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 10000) as text")
        sizes = texts.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
        assert len(sizes) > 2 and max(r.n for r in sizes) < size * 1.2
    finally:
        spark.conf.set(key, before)
