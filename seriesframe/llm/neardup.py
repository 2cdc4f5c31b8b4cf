"""Near-duplicate documents by tensored MinHash banding, verified on full shingle sets.

A document's set holds its distinct runs of five words (A-Z lower-cased; fewer words: the whole sequence as one).  Two
documents are linked if 100 * |intersection| >= 75 * |union|; a component is what links connect.

1. One pass hashes every text.  Equal sets become one class, so that copies are never expanded.
2. Two collections of M = 25 half keys each, of three minima each, give M * M = 625 table keys by pairing (the tensor trick: 150 minima
   instead of 3750).  A pair at similarity 0.75 shares no key with probability below 2.4e-6.  A key that only one class
   holds can't link, and it is known from its halves: half keys are counted first, and only classes that share a
   half key in both collections form pairs, of shared halves only.
3. In each table bucket, members are compared with two centres (its least and its largest id), never all with all.  Pairs whose sizes or parity
   bitmaps (1024 bits, which bound the symmetric difference from below) rule a link out go; the others are verified on full
   sets.  Links are merged into components.
4. Buckets of four members or more that still hold more than one component need more (smaller ones are all compared by then): their members
   are joined by a prefix filter.  With shingles ordered by frequency, linked sets share one of their first |x| - ceil(0.75 |x|) + 1
   shingles, so that only members of different components with a common rare shingle are compared, again behind sizes and
   bitmaps.  Two sets whose first common shingle stands far back in both can't be linked and never meet (texts that differ in few words
   of a short template), nor do members of a shingle's most frequent component.  This step drops no link, whatever a bucket's size.

All steps are joins and aggregations over keys; tables between them are written to the shared folder.

Defined cases: a null or empty text, or one without words, has n_shingles 0 and is its own component; rows with one id
are one node (their links are joined), and repeated rows each give their row; a null id is linked with nothing, has component_id null
and is kept; an empty table gives an empty result; other columns don't take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesframe.llm import textcols as tc
from seriesframe.llm.fingerprint import distinct, set_hashes, shingles, signatures
from seriesframe.llm.tables import Workspace, pick

HALVES = 25  # half keys of each collection
MINIMA = 3  # minima of a half key
BITMAP = 16  # longs of a parity bitmap
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sets(text: pa.Array):
    """(rows, hashes, first) piece by piece: sorted distinct shingle hashes of each text of the piece."""
    for a, b in tc.pieces(text, 1 << 20):
        data, offsets = tc.raw(text.slice(a, b - a))
        yield a, b, *distinct(*shingles(_LOWER[data], offsets))


def _hash_all(batches):
    """Per text: the number of shingles, a 128-bit hash of the set, and two collections of half keys."""
    for batch in batches:
        for a, b, h, first in _sets(tc.column(batch, "_t")):
            n = np.diff(first)
            one, two = set_hashes(h, first)
            s = signatures(h, first, 2 * HALVES * MINIMA).astype(np.uint64).reshape(b - a, 2, HALVES, MINIMA)
            with np.errstate(over="ignore"):
                keys = np.zeros(s.shape[:3], np.uint64)
                for k in range(MINIMA):
                    keys = (keys ^ s[..., k]) * np.uint64(tc.BASE)
                keys = tc.mix(keys).view(np.int64)
            row = np.repeat(np.arange(b - a), n)
            odd = np.bincount(row * 64 * BITMAP + (h & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=(b - a) * 64 * BITMAP) & 1
            bitmaps = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
            offsets = pa.array(np.arange(b - a + 1) * HALVES, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(keys[:, k]).ravel())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(n), pa.array(one), pa.array(two), *lists, pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * BITMAP, pa.int32()), pa.array(bitmaps))], ["id", "n", "h1", "h2", "u", "v", "bits"])


def _shingle_rows(batches):
    for batch in batches:
        for a, b, h, first in _sets(tc.column(batch, "_t")):
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))], ["id", "s"])


def _possible(percent: int, a: str = "x", b: str = "y") -> Column:
    """Whether sizes n and bitmaps of aliases a and b leave a link possible."""
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])) for k in range(BITMAP)), F.lit(0))
    return (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent) & ((total - apart) * (100 + percent) >= total * (2 * percent))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets pass."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("_b")), "b")
    both = both.where(F.greatest(F.size("_a"), F.size("_b")) * percent <= F.least(F.size("_a"), F.size("_b")) * 100)
    common = F.size(F.array_intersect("_a", "_b"))
    return both.where(common * 100 >= (F.size("_a") + F.size("_b") - common) * percent).select("a", "b")


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(id, label): for each node of edges (a, b), the least id that it can reach.

    Each round, nodes and their labels take the least label among neighbours, and labels are followed one step further.
    """
    both = work.save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = work.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("least"))
        joined = labels.join(seen, "id")
        hooks = joined.select("id", F.least("label", "least").alias("label")).union(joined.where("least < label").select(F.col("label").alias("id"), F.col("least").alias("label")))
        hooked = hooks.groupBy("id").agg(F.min("label").alias("label"))
        jump = hooked.select(F.col("id").alias("label"), F.col("label").alias("_next"))
        after = work.save(hooked.join(jump, "label", "left").select("id", F.least("label", F.coalesce("_next", "label")).alias("label")), "labels")
        changed = after.alias("x").join(labels.alias("y"), "id").where("x.label <> y.label").limit(1).count()
        if not changed:
            return after
        labels = after


def classify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    spark = docs.sparkSession
    work = Workspace(spark, "neardup")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("_t"))
    hashed = work.save(rows.mapInArrow(tc.frugal(_hash_all), "id long, n long, h1 long, h2 long, u array<long>, v array<long>, bits array<long>"), "hashed")
    some = hashed.where("n > 0 and id is not null")
    one = some.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.max("id").alias("other"), *[F.first(c).alias(c) for c in ("n", "u", "v", "bits")])
    classes = work.save(one, "classes")

    def shared(collection: str, among: DataFrame) -> DataFrame:
        """(id, half keys of the collection that another class has too)."""
        keys = among.select("id", F.explode(F.transform(collection, lambda x, k: x.bitwiseXOR(k.cast("long")))).alias("key"))
        # written before the join: so both its sides are plain exchanges, and Spark splits the partition of a frequent key
        several = work.save(keys.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key"), "shared")
        return keys.join(several, "key", "left_semi").groupBy("id").agg(F.collect_list("key").alias(collection))

    first = work.save(shared("u", classes), "first")
    left = work.save(classes.select("id", "v").join(first.select("id"), "id", "left_semi"), "left")
    halves = first.join(shared("v", left), "id")
    keyed = halves.select("id", F.explode("u").alias("u"), "v").select("id", "u", F.explode("v").alias("v"))
    keyed = keyed.select("id", F.xxhash64("u", "v").alias("key"))
    centres = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    buckets = work.save(keyed.join(work.save(centres, "centres"), "key"), "buckets")

    stars = buckets.select(F.col("id"), F.explode(F.array("low", "high")).alias("c")).where("id <> c")
    pairs = work.save(stars.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct(), "pairs")
    facts = classes.select("id", "n", "bits")
    near = pairs.join(facts.alias("x"), F.col("a") == F.col("x.id")).join(facts.alias("y"), F.col("b") == F.col("y.id")).where(_possible(percent)).select("a", "b")
    near = work.save(near.distinct(), "near")
    large = buckets.where("size > 3").select("id")
    wanted = work.save(near.select(F.col("a").alias("id")).union(near.select("b")).union(large).distinct(), "wanted")
    texts = pick(rows.where("id is not null"), wanted)
    sets = work.save(texts.mapInArrow(tc.frugal(_shingle_rows), "id long, s array<long>").where("size(s) > 0"), "sets")
    links = work.save(_linked(near, sets, percent), "verified")
    label = components(links, work)

    # larger buckets of several components: their members by prefix filter
    placed = buckets.where("size > 3").select("key", "id").join(label, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l < m").select("key")
    open_ = work.save(placed.join(mixed, "key", "left_semi").select("id", "label").distinct(), "open")
    parts = pick(sets, work.save(open_.select("id").distinct(), "open-ids")).select("id", F.size("s").alias("n"), F.explode("s").alias("s"))
    counts = parts.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # shingles of one member only come first in the order; how many there are follows from the rest
    common = parts.join(work.save(counts, "counts"), "s").withColumn("r", F.row_number().over(W.partitionBy("id", "n").orderBy(F.desc("df"), F.desc("s"))))
    # places count from the end: the prefix is what is left without the last ceil(percent * n) - 1 shingles
    prefix = common.where(F.col("r") > F.ceil(F.col("n") * percent / 100) - 1).select("id", "n", "s", (F.col("n") - F.col("r")).alias("i"))
    prefix = prefix.join(open_, "id").join(facts.select("id", F.col("n").cast("int").alias("n"), "bits"), ["id", "n"])
    # i and j shingles before the first one that two linked sets share differ: (i + j) (100 + percent) <= (n + m) (100 - percent), so one of the two is strong
    strong = F.col("i") * (100 + percent) <= F.col("n") * (100 - percent)
    prefix = work.save(prefix.select("id", "label", "n", "s", "bits", strong.alias("strong")), "prefix")
    # a shingle's members of its most frequent component aren't compared among themselves: one side of each pair is of another
    tops = prefix.groupBy("s", "label").agg(F.count(F.lit(1)).alias("_n")).groupBy("s").agg(F.max_by("label", F.struct("_n", "label")).alias("top"), F.count(F.lit(1)).alias("_l")).where("_l > 1").select("s", "top")
    placed = work.save(prefix.join(work.save(tops, "tops"), "s"), "placed")
    x = placed.where("label <> top").withColumn("only", F.col("strong").cast("int")).alias("x")  # weak ones meet strong ones only
    y = placed.withColumn("only", F.explode(F.when(F.col("strong"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))).alias("y")
    more = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.only") == F.col("y.only")) & (F.col("x.label") != F.col("y.label")) & _possible(percent))
    more = more.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct().join(near, ["a", "b"], "left_anti")
    links = links.union(_linked(work.save(more, "rest"), sets, percent))
    # rows of one id with several sets join the components of all of them
    several = some.groupBy("id").agg(F.countDistinct("h1", "h2").alias("_n")).where("_n > 1").select("id")
    twice = some.join(several, "id", "left_semi").join(classes.select("h1", "h2", F.col("id").alias("rep")), ["h1", "h2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    label = components(links.union(twice).distinct(), work)

    named = classes.select("h1", "h2", F.col("id").alias("rep")).join(label.select(F.col("id").alias("rep"), "label"), "rep", "left").select("h1", "h2", F.coalesce("label", "rep").alias("component"))
    out = hashed.select("id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
    return work.last(out)
