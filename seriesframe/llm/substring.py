"""Substring dedup: words of every passage of 35 words that occurs more than once are removed.

Words are [^\\x20\\x09-\\x0D]+, unchanged.  A window is 35 consecutive words of one document; a word goes if a window over it
occurs anywhere else too, in the same document included.  Windows are judged on the input.

1. Anchors.  In each window, the run of 8 words with the least hash is its anchor; equal windows have equal anchors.  Neighbouring windows
   with one anchor form a segment.  Anchors are counted over all documents; only segments whose anchor occurs again can hold a repeat.
2. Equal segments (128 bits of hashes of their anchor and words) are merged, with a count.
3. Segments with one anchor go to one shard.  A shard's words become a compressed FM-index (wavelet matrix of the
   Burrows-Wheeler transform) that knows each segment's count; all its segments are streamed through backward search, which gives the intervals
   whose windows occur twice or more.  Every repeat is found there, by its words.
   Anchors with very many different segments are split: their segments become single windows, sharded by their own words.
4. Flagged windows return to their documents by segment.

Shards have a bounded number of words, whatever the data; nothing unbounded is broadcast or collected.

Defined cases: a null or empty text has no words (n_words 0, the digest of the empty text); texts under 35 words lose nothing; texts
of any length are taken whole; repeated rows are documents like others, so their windows repeat; null ids are an id of their own; rows with one
id but different texts are judged apart; an empty table gives an empty result; other columns don't take part, and keep their names and values
whatever these are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesframe.llm import textcols as tc
from seriesframe.llm.fmindex import FMIndex, repeated_windows
from seriesframe.llm.tables import Workspace, unused

WINDOW = 35
ANCHOR = 8
SHARD_WORDS = 200_000
#: Up to TASKS shards have a task of their own; beyond, a task takes SHARDS_IN_TASK of them, one after another.
TASKS, SHARDS_IN_TASK = 2_000, 64
#: An anchor with more different segments than this is split into single windows.
SPLIT_ABOVE = 2_000


def _windows(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
    """Segments of all texts: (row, anchor hash, first window, number of windows, hash of the segment's words)."""
    starts, ends, first = tc.words(data, offsets)
    count = np.diff(first)
    inner = window - anchor + 1  # anchors' places within a window
    if not len(starts) or count.max() < window:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none, none.view(np.uint64)
    h = tc.span_hashes(data, starts, ends)
    g = tc.gram_hashes(h, anchor)
    # the place of the least g of each run of `inner`, the leftmost of equals: by doubling
    best = np.arange(len(g))
    span = 1
    while span < inner:
        move = min(span, inner - span)
        other = best[move:]
        best = np.where(g[other] < g[best[: len(other)]], other, best[: len(other)])
        span += move
    places = np.maximum(count - window + 1, 0)
    row = np.repeat(np.arange(len(count)), places)
    at = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places) + first[row]  # each window's first word
    place = best[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(at)))
    a = at[head]
    with np.errstate(over="ignore"):  # the words of a segment as a polynomial in their hashes
        p = tc._cached_powers(tc.BASE, len(h))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p, dtype=np.uint64)])
        b = a + n + window - 1
        words = tc.mix((sums[b] - sums[a]) * tc._cached_powers(tc.BASE_INVERSE, len(h))[a] + n.astype(np.uint64))
    return row[head], g[place[head]], a - first[row[head]], n, words


def _segments(window: int, anchor: int):
    def run(batches):
        for batch in batches:
            text = tc.column(batch, "_t")
            for a, b in tc.pieces(text):
                row, g, at, n, words = _windows(*tc.raw(text.slice(a, b - a)), window, anchor)
                if len(row):
                    keys = batch.slice(a, b - a).select(["id", "th"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(g.view(np.int64)), pa.array(words.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["id", "th", "g", "w", "at", "n"])

    return run


def _cut(window: int):
    """The words of the wanted segments, of each document one after another."""

    def run(batches):
        for batch in batches:
            text, wanted = tc.column(batch, "_t"), batch.column("segs")
            for i in range(batch.num_rows):
                data, offsets = tc.raw(text.slice(i, 1))
                starts, ends, _ = tc.words(data, offsets)
                out = []
                for x in wanted[i].as_py():
                    a, b = x["at"], x["at"] + x["n"] + window - 1
                    out.append((x["g"], x["w"], x["n"], b" ".join(_pieces(data[starts[a] : ends[b - 1]]))))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["g", "w", "n", "words"])

    return run


def _single(window: int):
    """Segments as single windows: (segment's key, place, hash and words of the window)."""

    def run(batches):
        for batch in batches:
            for g, w, n, many, words in zip(*(batch.column(c).to_pylist() for c in ("g", "w", "n", "many", "words")), strict=True):
                parts = words.split(b" ")
                out = [b" ".join(parts[k : k + window]) for k in range(n)]
                size = len(out)
                digests = [int.from_bytes(hashlib.blake2b(x, digest_size=16).digest(), "little") for x in out]
                yield pa.RecordBatch.from_arrays([
                    pa.array([g] * size, pa.int64()), pa.array([w] * size, pa.int64()), pa.array(range(size), pa.int32()), pa.array([many] * size, pa.int64()),
                    pa.array([(d & (2**64 - 1)) - 2**63 for d in digests], pa.int64()), pa.array([(d >> 64) - 2**63 for d in digests], pa.int64()), pa.array(out, pa.binary()),
                ], ["sg", "sw", "k", "many", "g", "w", "words"])

    return run


def _search(window: int):
    """Shard by shard, as a task's rows come: index the shard's segments, each with the number of its occurrences, and stream all through the index."""

    def flags(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        parts = [x[4].split(b" ") for x in rows]
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes + 1) - 1
        seq = np.zeros(int(ends[-1]) + 1, np.int64)  # 0 parts the segments
        flat = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for p in parts for w in p), np.int64, int(sizes.sum()))
        there = np.ones(len(seq), bool)
        there[ends] = False
        seq[there] = flat
        many = np.array([x[3] for x in rows])
        weight = np.repeat(many, sizes + 1)
        found = repeated_windows(FMIndex(seq, weight), seq, ends - sizes, ends, window)
        masks = np.array([int((f.astype(np.int64) << np.arange(len(f))).sum()) for f in found])
        keep = np.flatnonzero(masks)
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in keep], pa.int64()), pa.array([rows[i][1] for i in keep], pa.int64()), pa.array(masks[keep])], ["g", "w", "mask"])

    def run(batches):
        rows: list[tuple[int, int, int, int, bytes]] = []
        now = None
        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "g", "w", "n", "many", "words")), strict=True):
                if shard != now and rows:
                    yield flags(rows)
                    rows = []
                now = shard
                rows.append(tuple(row))
        if rows:
            yield flags(rows)

    return run


def _keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    id_ = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    return docs.select(id_.alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("_t"))


def _shard(n: int) -> Column:
    return F.pmod(F.xxhash64("g"), F.lit(n))


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(id, th, runs): of each document with repeats, arrays of (at, mask): bit k of mask says that the window at word at + k occurs elsewhere.

    id is doc_id (null as the least long) and th the text's xxhash64.
    """
    if window - anchor + 1 > 62:
        raise ValueError("a segment's windows must fit one mask of 62 bits: take longer anchors")
    work = Workspace(docs.sparkSession, "substring")
    rows = _keys(docs, doc_id, text)
    segments = work.save(rows.mapInArrow(tc.frugal(_segments(window, anchor)), "id long, th long, g long, w long, at int, n int"), "segments")
    # written before the join: so both its sides are plain exchanges, and Spark splits the partition of an anchor that many segments have
    again = work.save(segments.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("g"), "again")
    segments = work.save(segments.join(again, "g", "left_semi"), "candidates")

    # one text for each different segment: of the document with the least key that has it
    own = segments.groupBy("g", "w").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("id", "th", "at", "n")).alias("x"))
    own = work.save(own.select("g", "w", "many", "x.*"), "own")
    wanted = own.groupBy("id", "th").agg(F.collect_list(F.struct("g", "w", "at", "n")).alias("segs"))
    cut = rows.join(wanted, ["id", "th"]).select("_t", "segs").mapInArrow(tc.frugal(_cut(window)), "g long, w long, n int, words binary")
    different = cut.groupBy("g", "w").agg(F.first("n").alias("n"), F.first("words").alias("words")).join(own.select("g", "w", "many"), ["g", "w"])
    different = work.save(different, "different")

    split = different.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > split_above).select("g")
    split = work.save(split, "split")
    single = work.save(different.join(split, "g", "left_semi").mapInArrow(tc.frugal(_single(window)), "sg long, sw long, k int, many long, g long, w long, words binary"), "single")
    singles = single.groupBy("g", "w").agg(F.lit(1).alias("n"), F.sum("many").alias("many"), F.first("words").alias("words"))
    items = work.save(different.join(split, "g", "left_anti").select("g", "w", "n", "many", "words").unionByName(singles), "items")
    total = items.agg(F.sum(F.col("n") + window)).first()[0] or 0
    shards = int(max(1, -(-total // shard_words)))
    tasks = min(shards, max(TASKS, -(-shards // SHARDS_IN_TASK)))
    dealt = items.withColumn("shard", _shard(shards)).repartitionById(tasks, (F.col("shard") % tasks).cast("int")).sortWithinPartitions("shard", "g", "w")
    flags = work.save(dealt.mapInArrow(tc.frugal(_search(window)), "g long, w long, mask long"), "flags")

    back = single.select("sg", "sw", "k", "g", "w").join(flags.select("g", "w"), ["g", "w"]).groupBy("sg", "sw").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    flags = work.save(flags.join(split, "g", "left_anti").union(back.select("sg", "sw", "mask")), "all-flags")
    return work.last(segments.join(flags, ["g", "w"]).groupBy("id", "th").agg(F.collect_list(F.struct("at", "mask")).alias("runs")))


def _kept(data: np.ndarray, runs, window: int) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by spaces) of one text."""
    starts, ends, _ = tc.words(data, np.array([0, len(data)]))
    n = len(starts)
    if runs:
        at = np.array([x["at"] for x in runs])
        masks = np.array([x["mask"] for x in runs], np.int64)
        hits = np.concatenate([at[(masks >> k & 1).astype(bool)] + k for k in range(62) if (masks >> k & 1).any()])
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, hits, 1)
        np.add.at(cover, hits + window, -1)
        gone = np.cumsum(cover[:n]) > 0
    else:
        gone = np.zeros(n, bool)
    plain = data.copy()
    if gone.any():  # removed words turn into white space
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, starts[gone], 1)
        np.add.at(edge, ends[gone], -1)
        plain[np.cumsum(edge[:-1]) > 0] = 32
    return n, int(gone.sum()), b" ".join(_pieces(plain))


_TO_SPACE = bytes(32 if tc.IS_SPACE[b] else b for b in range(256))


def _pieces(data: np.ndarray) -> list[bytes]:
    return [x for x in data.tobytes().translate(_TO_SPACE).split(b" ") if x]


def _with_runs(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    """docs with the runs of each row, and the name of that column."""
    own = unused(docs, "_runs")
    keyed = docs.withColumns({f"{own}i": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))), f"{own}t": F.xxhash64(F.col(text))})
    joined = keyed.join(found.select(F.col("id").alias(f"{own}i"), F.col("th").alias(f"{own}t"), F.col("runs").alias(own)), [f"{own}i", f"{own}t"], "left")
    return joined.select(*docs.columns, own), own


def digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_t"))
    joined, own = _with_runs(rows, find(rows, doc_id="doc_id", text="_t", window=window, **options), "doc_id", "_t")

    def run(batches):
        for batch in batches:
            column, runs, out = tc.column(batch, "_t"), batch.column(own), []
            data, offsets = tc.raw(column)
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                n, gone, kept = _kept(data[a:b], runs[i].as_py(), window)
                out.append((n, gone, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(tc.frugal(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", window: int = WINDOW, **options) -> DataFrame:
    """All columns of docs; texts that hold repeats are their kept words joined by one space, others stay as they are.  n_chars follows the text."""
    columns = docs.columns
    joined, own = _with_runs(docs, find(docs, doc_id=doc_id, text=text, window=window, **options), doc_id, text)

    def run(batches):
        for batch in batches:
            column, runs, out = batch.column(text).to_pylist(), batch.column(own).to_pylist(), []
            for t, r in zip(column, runs, strict=True):
                out.append(_kept(np.frombuffer(t.encode(), np.uint8), r, window)[2].decode() if r and t else t)
            new = {text: pa.array(out, pa.string())}
            if n_chars in columns:
                new[n_chars] = pa.array([None if x is None else len(x) for x in out], pa.int64()).cast(batch.schema.field(n_chars).type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], columns)

    return joined.mapInArrow(tc.frugal(run), T.StructType([docs.schema[c] for c in columns]))
