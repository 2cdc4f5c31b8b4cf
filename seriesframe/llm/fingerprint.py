"""Document fingerprints: MinHash signatures, band joins and verified Jaccard similarities.

A text's shingles are its runs of five words (fewer words: the whole sequence as one).  Slot i of the
signature is the least value of a random universal hash (a_i x + b_i) mod 2**64, top 32 bits, over all
shingles; the likeness of two fingerprints is the share of equal slots, an estimate of the Jaccard similarity.  Bands of signatures are
joined in Spark, all members of a bucket with all, and the Jaccard similarities of what they bring together are verified on full sets (links).

Defined cases: a null text counts as empty; a text without words has a fingerprint of its own kind, with likeness 1 to
its like and 0 to all others; texts of any length are hashed whole, in pieces of bounded memory; repeated
rows each give their row; documents with equal ids follow each other in the order of their texts' digests;
null ids come last and match nothing; the next document of a single row is that row itself; an empty table gives an empty result; other
columns don't take part, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesframe.llm import textcols as tc
from seriesframe.llm.tables import Workspace, pick, release, small_batches

WORDS = 5
SLOTS = 64
BAND = 3  # slots of a band
CELL = 1 << 19  # shingles of a block of a bucket's classes; two blocks are verified at once
BUCKET = 4096  # classes of a band's bucket that are compared all with all, at most; those of larger ones meet by a prefix filter
PARTS = 200_000  # ranges of ids, at most (1.6 MB of cut points); a part is streamed, so a larger one takes longer, not more memory
_PIECE = 1 << 16  # shingles hashed at once: work areas that fit a cache

_rng = np.random.default_rng(20240601)
_A = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_EMPTY = np.uint32(0xFFFFFFFF)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): shingle hashes of row i are hashes[first[i]:first[i+1]], in text order, repeats included."""
    starts, ends, first = tc.words(data, offsets)
    count = np.diff(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    h = tc.span_hashes(data, starts, ends)
    grams = tc.gram_hashes(h, n)
    per_row = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_first = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(len(count)), per_row)
    at = np.arange(out_first[-1]) - out_first[row] + first[row]
    whole = count[row] >= n
    out = np.zeros(len(row), np.uint64)
    out[whole] = grams[at[whole]]
    with np.errstate(over="ignore"):
        for k in np.flatnonzero((count > 0) & (count < n)):  # a short text's words as one
            v = np.uint64(int(count[k]))
            for x in h[first[k] : first[k + 1]]:
                v = v * np.uint64(tc.BASE) + x
            out[out_first[k]] = tc.mix(np.array([v], np.uint64))[0]
    return out, out_first


def signatures(hashes: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """One row of `slots` 32-bit minima for each text; all slots full where a text has no shingle."""
    n = len(first) - 1
    out = np.full((n, slots), _EMPTY, np.uint32)
    some = np.flatnonzero(np.diff(first) > 0)
    row = 0
    with np.errstate(over="ignore"):
        while row < len(some):  # whole rows up to _PIECE shingles, or a part of one long row
            a = first[some[row]]
            last = int(np.searchsorted(first[some + 1], a + _PIECE, "right"))
            if last > row:
                at = (first[some[row:last]] - a).astype(np.int64)
                x = hashes[a : first[some[last - 1] + 1]]
                for i in range(slots):
                    out[some[row:last], i] = np.minimum.reduceat(((x * _A[i] + _B[i]) >> np.uint64(32)).astype(np.uint32), at)
                row = last
            else:
                for b in range(a, first[some[row] + 1], _PIECE):
                    x = hashes[b : min(b + _PIECE, first[some[row] + 1])]
                    for i in range(slots):
                        out[some[row], i] = min(out[some[row], i], ((x * _A[i] + _B[i]) >> np.uint64(32)).astype(np.uint32).min())
                row += 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots, row by row.  Texts without shingles are like each other only."""
    return (a == b).mean(axis=-1)


def _arrow_signatures(text: pa.Array, slots: int) -> np.ndarray:
    out = [signatures(*shingles(*tc.raw(text.slice(a, b - a))), slots) for a, b in tc.pieces(text, 1 << 20)]
    return np.concatenate(out) if out else np.zeros((0, slots), np.uint32)


def with_signature(docs: DataFrame, *, text: str = "text", slots: int = SLOTS, signature_col: str = "signature") -> DataFrame:
    """All columns of docs (but one named signature_col) with the signature as an array of longs."""
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c != signature_col]

    def run(batches):
        for batch in batches:
            s = _arrow_signatures(tc.column(batch, text), slots).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * slots, pa.int32()), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, signature_col])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField(signature_col, T.ArrayType(T.LongType()))]))


def _hash_all(slots: int, band: int):
    """Per text: digest, number of distinct shingles, a 128-bit hash of their set, its parity bitmap, and the keys of the signature's bands."""
    from seriesframe.llm.neardup import BITMAP  # which imports this module

    def run(batches):
        for batch in batches:
            text = tc.column(batch, "_t")
            for a, b in tc.pieces(text, 1 << 20):
                part = text.slice(a, b - a)
                h, first = distinct(*shingles(*tc.raw(part)))
                one, two = set_hashes(h, first)
                s = signatures(h, first, slots).astype(np.uint64)
                keys = np.zeros((b - a, slots // band), np.uint64)
                with np.errstate(over="ignore"):
                    keys += np.arange(slots // band, dtype=np.uint64)
                    for k in range(band):
                        keys = (keys ^ s[:, k : k + band * keys.shape[1] : band]) * np.uint64(tc.BASE)
                    keys = tc.mix(keys).view(np.int64)
                digests = [hashlib.md5(t.encode()).hexdigest() for t in part.to_pylist()]
                odd = np.zeros((b - a) * 64 * BITMAP, np.uint8)
                row = np.repeat(np.arange(b - a), np.diff(first))
                np.add.at(odd, row * 64 * BITMAP + (h & np.uint64(64 * BITMAP - 1)).astype(np.int64), np.uint8(1))
                bits = np.packbits(odd & np.uint8(1), bitorder="little").view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * (len(x) // (b - a)), pa.int32()), pa.array(x)) for x in (keys.ravel(), bits)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(digests), pa.array(np.diff(first)), pa.array(one), pa.array(two), *lists], ["id", "h", "n", "h1", "h2", "bands", "bits"])

    return run


def distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row of shingles()."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    h, row = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(first)))


def set_hashes(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's set (distinct()): sums of its mixed members."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(tc.mix(hashes ^ np.uint64(s)), dtype=np.uint64)]) for s in (0x1234567, 0x9ABCDEF0FEDC)]
        return tuple((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)


def _sets(batches):
    for batch in batches:
        text = tc.column(batch, "_t")
        for a, b in tc.pieces(text):
            h, first = distinct(*shingles(*tc.raw(text.slice(a, b - a))))
            one, two = set_hashes(h, first)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))], ["h1", "h2", "s"])


def _meet(bands: int, percent: int, cell: int):
    """Members x of each bucket of band k that can link with another one, in cells: rows of a class's place in a cell, and its later partners there as bits of places.

    Two members are partners in the first band that both share only, if sizes and parity bitmaps allow a link and not both are crowded.  A bucket's members are cut into blocks of
    about `cell` shingles; each pair of blocks is a cell.  So rows are at most members times blocks, never pairs.
    """
    from seriesframe.llm.neardup import BITMAP  # which imports this module

    names = ("h1", "h2", "id", "size")

    def run(batches):
        for batch in batches:
            lists = batch.column("x")
            first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            v = lists.flatten()
            facts = {c: v.field(c).to_numpy() for c in (*names, "n")}
            crowded = v.field("crowded").to_numpy(zero_copy_only=False)
            keys = v.field("bands").flatten().to_numpy().reshape(-1, bands)
            bits = v.field("bits").flatten().to_numpy().view(np.uint64).reshape(-1, BITMAP)
            n, out, waiting = facts["n"], [], 0
            for at, (key, k) in enumerate(zip(batch.column("key").to_pylist(), batch.column("k").to_pylist(), strict=True)):
                start, end = first[at], first[at + 1]
                partners = None
                for p in range(start, end, 128):
                    x, y = slice(p, min(p + 128, end)), slice(p, end)
                    near = np.arange(y.start, y.stop) > np.arange(x.start, x.stop)[:, None]
                    near &= np.minimum(n[x][:, None], n[y]) * 100 >= np.maximum(n[x][:, None], n[y]) * percent
                    near &= ~(crowded[x][:, None] & crowded[y])
                    for e in range(k):
                        near &= keys[x, e][:, None] != keys[y, e]
                    i, j = np.nonzero(near)
                    for c in range(0, len(i), 1 << 15):
                        a, b = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
                        apart = np.bitwise_count(bits[a + p] ^ bits[b + p]).sum(axis=1, dtype=np.int64)
                        total = n[a + p] + n[b + p]
                        near[a, b] = (total - apart) * (100 + percent) >= total * (2 * percent)
                    if near.any():
                        if partners is None:
                            partners = np.zeros((end - start, (end - start + 7) // 8), np.uint8)
                        partners[x.start - start : x.stop - start] = np.packbits(np.pad(near, ((0, 0), (p - start, 0))), axis=1)
                if partners is not None:
                    for c, places, later in cells(n[start:end], partners):
                        out.append((key, k, c, places + start, later))
                        waiting += later.nbytes + 64 * len(places)
                    if waiting > 1 << 20:
                        yield rows(facts, out)
                        out, waiting = [], 0
            if out:
                yield rows(facts, out)

    def cells(n: np.ndarray, partners: np.ndarray):
        """(cell, members, their later partners as bits) of a bucket."""
        block = (np.cumsum(n) - n) // cell
        blocks = np.unique(block)
        for i in blocks:
            own = np.flatnonzero(block == i)
            near = np.unpackbits(partners[own], axis=1, count=len(n)).view(bool)
            for j in blocks[blocks >= i]:
                there = np.flatnonzero(block == j)
                part = near[:, there]
                x, y = np.flatnonzero(part.any(axis=1)), np.flatnonzero(part.any(axis=0))
                if not len(x):
                    continue
                if i == j:
                    x = y = np.union1d(x, y)
                    places, later = own[x], part[np.ix_(x, y)]
                else:
                    places = np.concatenate([own[x], there[y]])
                    later = np.zeros((len(places), len(places)), bool)
                    later[: len(x), len(x) :] = part[np.ix_(x, y)]
                yield int(i) << 32 | int(j), places, np.packbits(later, axis=1)

    def rows(facts: dict, out: list) -> pa.RecordBatch:
        size = [len(x[3]) for x in out]
        at = np.concatenate([x[3] for x in out])
        of_cell = [pa.array(np.repeat(np.array([x[c] for x in out], np.int64), size)) for c in range(3)]
        return pa.RecordBatch.from_arrays([
            *of_cell, pa.array(np.concatenate([np.arange(m) for m in size])), *(pa.array(facts[c][at]) for c in names), pa.array([r.tobytes() for x in out for r in x[4]], pa.binary()),
        ], ["key", "k", "cell", "place", *names, "later"])

    return run


def _count(percent: int):
    """Cell by cell, as a task's rows come: each class that is linked in the cell, the least id that it is linked with there, their similarity, and the number of documents of the classes that it is linked with."""

    def linked(part: pa.RecordBatch) -> pa.RecordBatch:
        size, ids = part.column("size").to_numpy(), part.column("id").to_numpy()
        m = len(ids)
        if (part.column("place").to_numpy() != np.arange(m)).any():
            raise RuntimeError(f"sets are missing in the cell of classes {ids[:10].tolist()}")
        later = np.unpackbits(np.frombuffer(b"".join(part.column("later").to_pylist()), np.uint8).reshape(m, -1), axis=1, count=m).view(bool)
        sets = part.column("s")
        first = sets.offsets.to_numpy() - sets.offsets[0].as_py()
        n = np.diff(first)
        _, members = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        mark = np.zeros(len(members), bool)
        others, least, likeness = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max), np.full(m, np.inf)
        for x in np.flatnonzero(later.any(axis=1)):
            own, ys = members[first[x] : first[x + 1]], np.flatnonzero(later[x])
            mark[own] = True
            common = np.add.reduceat(mark[np.concatenate([members[first[y] : first[y + 1]] for y in ys])], np.cumsum(n[ys]) - n[ys], dtype=np.int64)
            mark[own] = False
            union = n[x] + n[ys] - common
            near = common * 100 >= union * percent
            if near.any():
                ys, jaccard = ys[near], common[near] / union[near]
                others[x] += size[ys].sum()
                others[ys] += size[x]
                k = np.lexsort((jaccard, ids[ys]))[0]
                least[x], likeness[x] = min((least[x], likeness[x]), (ids[ys[k]], jaccard[k]))
                less = (ids[x] < least[ys]) | ((ids[x] == least[ys]) & (jaccard < likeness[ys]))
                least[ys[less]], likeness[ys[less]] = ids[x], jaccard[less]
        some = np.flatnonzero(others)
        keys = [pa.array(part.column(c).to_numpy()[some]) for c in ("h1", "h2")]
        return pa.RecordBatch.from_arrays([*keys, pa.array(least[some]), pa.array(likeness[some]), pa.array(others[some])], ["h1", "h2", "match_id", "match_jaccard", "others"])

    def run(batches):
        parts, now = [], None
        for batch in batches:
            facts = [batch.column(c).to_numpy() for c in ("key", "k", "cell")]
            new = np.zeros(batch.num_rows, bool)
            for x in facts:
                new[1:] |= x[1:] != x[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                of = tuple(int(x[a]) for x in facts)
                if of != now and parts:
                    yield linked(whole(parts))
                    parts = []
                now = of
                parts.append(batch.slice(a, b - a))
        if parts:
            yield linked(whole(parts))

    def whole(parts: list) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return run


def _met_in_prefixes(members: DataFrame, sets: DataFrame, work: Workspace, percent: int) -> DataFrame:
    """(x, y): pairs of members (classes, as structs in x) that can link, each once or more; no pair that links is left out.

    Shingles are ordered by frequency, rare ones first; linked sets share one of their first n - ceil(percent * n) + 1 shingles.  The i and j shingles before the
    first that both have differ, which bounds i + j; so one of the two places is in the front part of its set (strong).
    """
    from seriesframe.llm.neardup import _possible

    parts = sets.join(members.select("x.h1", "x.h2"), ["h1", "h2"], "left_semi").select("h1", "h2", F.size("s").alias("n"), F.explode("s").alias("s"))
    counts = work.save(parts.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    # shingles of one member only come first in the order; how many there are follows from the rest
    common = parts.join(counts, "s").withColumn("r", F.row_number().over(W.partitionBy("h1", "h2", "n").orderBy(F.desc("df"), F.desc("s"))))
    prefix = common.where(F.col("r") > F.ceil(F.col("n") * percent / 100) - 1).select("h1", "h2", "s", (F.col("n") - F.col("r")).alias("i"))
    prefix = prefix.join(members.select("x", "x.h1", "x.h2"), ["h1", "h2"])
    # written before the join: so both its sides are plain exchanges, and Spark splits the partition of a frequent shingle
    prefix = work.save(prefix.select("s", "i", "x", (F.col("i") * (100 + percent) <= F.col("x.n") * (100 - percent)).alias("strong")), "prefix")
    a = prefix.select("s", F.col("i"), "x", F.col("strong").cast("int").alias("only"))  # weak ones meet strong ones only
    b = prefix.select(F.col("s"), F.col("i").alias("j"), F.col("x").alias("y"), F.explode(F.when(F.col("strong"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("only"))
    early = (F.col("i") + F.col("j")) * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    return a.join(b, ["s", "only"]).where(_before() & early & _possible(percent)).select("x", "y")


def _before() -> Column:
    """Whether x is the first of x and y: each pair of classes in one order only."""
    return (F.col("x.h1") < F.col("y.h1")) | ((F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") < F.col("y.h2")))


def links(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, band: int = BAND, percent: int = 75, bucket: int = BUCKET, cell: int = CELL) -> DataFrame:
    """(doc_id, h, class_id, n_links, match_id, match_jaccard) of each document that is linked: its Jaccard similarity to another one is percent or more.

    h is the md5 of the text.  Texts with equal shingle sets are one class, named by its least id (class_id), so that copies are never expanded; n_links
    counts all other documents that the document is linked with, copies too.  match_id is the least id among them, match_jaccard the similarity; both are null where
    the document's own id isn't greater.

    Signatures are cut into bands; all classes with an equal band are candidates of each other.  Buckets of over `bucket` classes aren't compared all with all: their classes meet
    by a prefix filter, which drops no link.  Sizes and parity bitmaps rule out pairs that can't link; the others are verified on full sets.  A pair at 0.75 shares no band
    of three slots of 64 with probability 1e-5; nothing else is left out.  Every link between classes is verified and counted, so k classes that are all linked
    with each other cost k * k / 2 comparisons; but where a pair shares a bucket that isn't larger, it is no row of any table: sets go to the cells of their buckets
    (`cell` shingles a block) and links are counted there, by class.  Documents without words or id are linked with nothing.
    """
    work = Workspace(docs.sparkSession, "matches")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).where("id is not null")
    hashed = work.save(rows.mapInArrow(_hash_all(slots, band), "id long, h string, n long, h1 long, h2 long, bands array<long>, bits array<long>").where("n > 0"), "hashed")
    classes = work.save(hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), *[F.first(c).alias(c) for c in ("n", "bands", "bits")]), "classes")
    named = classes.select("h1", "h2", F.posexplode("bands").alias("k", "key"))
    several = named.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = work.save(named.join(work.save(several, "several"), "key"), "met")
    facts = F.struct("h1", "h2", F.col("rep").alias("id"), "size", "n", "bits").alias("x")
    ends = [F.col(f"{c}.{k}").alias(f"{c}{k}") for c in "xy" for k in ("h1", "h2", "id", "size")]
    large = work.save(met.where(F.col("members") > bucket).select("h1", "h2").distinct(), "large")
    some_large = not large.isEmpty()
    known = classes.withColumn("crowded", F.lit(False))
    if some_large:
        known = classes.join(large.withColumn("crowded", F.lit(True)), ["h1", "h2"], "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    placed = met.where(F.col("members") <= bucket).join(known, ["h1", "h2"]).groupBy("key", "k").agg(F.collect_list(F.struct("h1", "h2", F.col("rep").alias("id"), "size", "n", "bands", "bits", "crowded")).alias("x"))
    cells = work.save(placed.mapInArrow(tc.frugal(_meet(slots // band, percent, cell)), "key long, k long, cell long, place long, h1 long, h2 long, id long, size long, later binary"), "cells")
    release(docs.sparkSession)  # before the sets are dealt
    wanted = cells.select("id")
    if some_large:
        crowded = work.save(classes.join(large, ["h1", "h2"], "left_semi").select(facts), "crowded")
        wanted = wanted.union(crowded.select("x.id"))
    sets = pick(rows, work.save(wanted.distinct(), "wanted")).mapInArrow(tc.frugal(_sets), "h1 long, h2 long, s array<long>").where("size(s) > 0").groupBy("h1", "h2").agg(F.first("s").alias("s"))
    if some_large:
        sets = work.save(sets, "sets")
    # a set goes to each cell of its class; links are counted there, and no pair is a row
    dealt = cells.join(sets, ["h1", "h2"]).repartition("key", "k", "cell").sortWithinPartitions("key", "k", "cell", "place")
    found = dealt.mapInArrow(tc.frugal(_count(percent)), "h1 long, h2 long, match_id long, match_jaccard double, others long")
    if some_large:
        pairs = work.save(_met_in_prefixes(crowded, sets, work, percent).select(*ends).distinct(), "pairs")
        both = pairs.join(sets.select(F.col("h1").alias("xh1"), F.col("h2").alias("xh2"), F.col("s").alias("_a")), ["xh1", "xh2"])
        both = both.join(sets.select(F.col("h1").alias("yh1"), F.col("h2").alias("yh2"), F.col("s").alias("_b")), ["yh1", "yh2"])
        # generated, so that no filter takes the intersection a second time
        both = both.withColumn("_n", F.explode(F.array(F.size(F.array_intersect("_a", "_b"))))).withColumn("_u", F.size("_a") + F.size("_b") - F.col("_n")).where(F.col("_n") * 100 >= F.col("_u") * percent)
        ways = [F.struct(F.col(f"{a}h1").alias("h1"), F.col(f"{a}h2").alias("h2"), F.col(f"{b}id").alias("match_id"), (F.col("_n") / F.col("_u")).alias("match_jaccard"), F.col(f"{b}size").alias("others")) for a, b in ("xy", "yx")]
        found = found.unionByName(both.select(F.explode(F.array(*ways)).alias("w")).select("w.*"))
    found = found.groupBy("h1", "h2").agg(F.min(F.struct("match_id", "match_jaccard")).alias("m"), F.sum("others").alias("others"))
    linked = classes.select("h1", "h2", "rep", "size").join(work.save(found, "found"), ["h1", "h2"], "left").where("size > 1 or m is not null")
    own = F.struct(F.col("rep").alias("match_id"), F.lit(1.0).alias("match_jaccard"))
    best = F.least(F.when(F.col("id") != F.col("rep"), own), "m")
    out = hashed.select("id", "h", "h1", "h2").join(work.save(linked, "linked"), ["h1", "h2"])
    out = out.select("id", "h", "rep", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.when(best.match_id < F.col("id"), best).alias("m"))
    return work.last(out.select(F.col("id").alias("doc_id"), "h", F.col("rep").alias("class_id"), "n_links", "m.match_id", "m.match_jaccard").distinct())


def matches(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, h, match_id, match_jaccard): of links(), the documents that are linked with one of a lesser id."""
    return links(docs, **options).where("match_id is not null").select("doc_id", "h", "match_id", "match_jaccard")


# ---- each document, its edited text and the next document ------------------------------------------------


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


def compare_neighbours(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, part_bytes: int = 8 << 20, matched: DataFrame | None = None) -> DataFrame:
    """Fingerprint every text and its edited text (see the query), and compare with the next document by descending id.

    Documents are dealt by ranges of ids, once.  Cut points are ids; the first document of each range goes to the range before it too,
    so that every task has its last document's successor.  Ranges follow quantiles of the ids, of which one sketch comes to the driver;
    the sketch works in doubles, so each range then ends at the greatest id that it really has (one more aggregate over the ids).  With more
    than PARTS times part_bytes of text, parts grow; the result is the same.

    matched: rows of links() or matches(), which are dealt alike and joined to their documents by merging; documents without one have no match, are a class of
    their own and linked with nothing.  Without links(), class_id and n_links are null.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, match_id long, match_jaccard double, class_id long, n_links long"
    low, high, size, nulls = rows.agg(F.min("doc_id"), F.max("doc_id"), F.sum(F.octet_length("text")), F.max(F.col("doc_id").isNull())).first()
    spark = docs.sparkSession
    if size is None:
        return spark.createDataFrame([], schema)
    parts = int(max(1, min(size // part_bytes + 1, PARTS)))
    cuts: list[int] = []

    def placed(points: np.ndarray):
        @F.pandas_udf("int")
        def place(ids: pd.Series) -> pd.Series:
            """Twice the range, and 1 more for a range's first document."""
            known = ids.to_numpy(np.int64)
            at = np.searchsorted(points, known, "left")
            cut = np.append(points, np.iinfo(np.int64).max)[at] == known
            return pd.Series((2 * at + (cut & (at < len(points)))).astype(np.int32))

        # without nulls, which would turn the ids of a batch into doubles
        return place(F.coalesce("doc_id", F.lit(np.iinfo(np.int64).min)))

    if parts > 1 and low is not None:
        shares = [k / parts for k in range(1, parts)]
        found = rows.agg(F.percentile_approx("doc_id", shares, max(1000, 10 * parts)).alias("q")).first().q
        ends = rows.select("doc_id", F.shiftright(placed(np.array(sorted(set(found)), np.int64)), 1).alias("_range")).groupBy("_range").agg(F.max("doc_id").alias("end"))
        cuts = sorted(r.end for r in ends.collect() if r.end is not None and low < r.end < high)
    # range k holds the ids over cut k-1, up to cut k; null ids are in range 0, behind all others
    rows = rows.withColumn("_at", placed(np.array(cuts, np.int64)))
    own = F.shiftright("_at", 1)
    first_of_all = F.col("doc_id") == F.lit(high) if high is not None else F.col("doc_id").isNull()
    wraps = F.when(F.coalesce(first_of_all, F.lit(False)), F.struct(F.lit(0).alias("part"), F.lit(2).alias("role")))
    heads = F.when(F.col("_at") % 2 == 1, F.struct((own + 1).alias("part"), F.lit(1).alias("role")))
    dealt = rows.withColumn("_to", F.explode(F.filter(F.array(F.struct(own.alias("part"), F.lit(0).alias("role")), heads, wraps), lambda x: x.isNotNull())))
    dealt = dealt.select("doc_id", "text", "_to.part", "_to.role", F.md5(F.col("text").cast("binary")).alias("_h"))
    none = {"match_id": "long", "match_jaccard": "double", "class_id": "long", "n_links": "long"}
    dealt = dealt.select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    if matched is not None:  # without text, before their documents
        at = F.shiftright(placed(np.array(cuts, np.int64)), 1)
        told = [F.col(c) if c in matched.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()]
        own = matched.select("doc_id", F.lit(None).cast("string").alias("text"), at.alias("part"), F.lit(0).alias("role"), F.col("h").alias("_h"), *told)
        dealt = dealt.unionByName(own)
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions(F.col("part"), F.col("role"), F.col("doc_id").desc_nulls_last(), F.col("_h"), F.col("text").isNotNull())

    counted = matched is not None and "n_links" in matched.columns

    def run(batches):
        def finish(rows: list[tuple[int | None, str, str, tuple]]) -> pa.RecordBatch:
            texts = pa.array([r[1] for r in rows], pa.large_string())
            edited = [_edited(r[1], r[2]) for r in rows]
            a = _arrow_signatures(texts, slots)
            b = _arrow_signatures(pa.array(edited, pa.large_string()), slots)
            c = np.empty_like(a)
            c[:-1] = a[1:]
            # the next text is mostly the next row; where it isn't, its signature is taken for itself
            odd = [i for i, r in enumerate(rows) if i + 1 == len(rows) or rows[i + 1][1] is not r[2]]
            c[odd] = _arrow_signatures(pa.array([rows[i][2] for i in odd], pa.large_string()), slots)
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([x.tobytes().hex() for x in a], pa.string()),
                pa.array([x.tobytes().hex() for x in b], pa.string()),
                pa.array(likeness(a, b)),
                pa.array(likeness(a, c)),
                pa.array([r[3][0] for r in rows], pa.int64()),
                pa.array([r[3][1] for r in rows], pa.float64()),
                pa.array([r[0] if counted and r[3][2] is None else r[3][2] for r in rows], pa.int64()),
                pa.array([0 if counted and r[3][3] is None else r[3][3] for r in rows], pa.int64()),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", *none])

        waiting: tuple[int | None, str, int, tuple] | None = None
        match: tuple = (None, "")  # the last match that came, with its document's id and digest
        helped = False

        def complete(part: int | None) -> None:
            """A row of the next range, or the end: the last row must have had its successor."""
            if waiting is not None and not helped and waiting[2] != part:
                raise RuntimeError(f"no next document for doc_id {waiting[0]}, the last of range {waiting[2]}")

        for batch in batches:
            done: list[tuple[int | None, str, str, tuple]] = []
            weight = 0
            for i, t, part, role, h, *m in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "role", "_h", *none)), strict=True):
                if t is None:
                    match = (i, h, *m)
                    continue
                if waiting is not None and waiting[2] == part and not helped:
                    done.append((waiting[0], waiting[1], t, waiting[3]))
                    weight += len(waiting[1])
                    if weight > tc.CHUNK_BYTES:
                        yield finish(done)
                        done, weight = [], 0
                if role == 0:
                    complete(part)
                    waiting, helped = (i, t, part, match[2:] if match[:2] == (i, h) else (None,) * len(none)), False
                else:
                    helped = True  # only the first helper of a range counts
            if done:
                yield finish(done)
        complete(None)

    return dealt.mapInArrow(run, schema)

