"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Weights are fractions a/D with one common denominator D (the sum of the a).  The documents of a source,
in an order drawn by hash, form blocks of equal numbers of documents.  Block i = 1, 2, ... of a source
with weight a/D may not be sent before its release floor((i-1) D / a) and must be sent by its deadline
ceil(i D / a).  In each slot the earliest deadline among the released blocks is sent first.  With weights
that sum to 1 this meets all deadlines, so that after every slot t each source has sent less than one block
more or less than t a / D.

The schedule repeats after D slots, so one period of D rows serves any number of documents: it is a fixed
table, whatever the data.  A document's place follows from its rank within its source, which needs no
sorting of a whole source: sources are cut into buckets by hash, buckets are counted and summed up, and
ranks are taken within buckets, so a source with a third of all rows is spread like any other.

Defined cases: a null source is a source of its own; null or empty texts count as documents; repeated rows
each have their own place (equal rows in any order among themselves); a source that runs out leaves its slots
empty, and the others keep their order (nothing is dropped or repeated); a source without a weight, or with
weight 0, comes after the horizon of all weighted ones; an empty table gives an empty result; columns of the input with the
names of the result's own columns are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesframe.llm.tables import unused

OUT = ("mix_slot", "mix_block", "mix_offset", "mix_release", "mix_deadline", "mix_position")


def tempered_weights(docs: DataFrame, *, source: str = "source", exponent: float = 0.7, denominator: int = 1000) -> dict[str | None, int]:
    """Weights in proportion to (documents of the source) ** exponent, as integers that sum to denominator.

    Largest remainders, ties by name; each source gets 1 at least.  One count for each source comes to the driver.
    """
    counts = {r[0]: r[1] for r in docs.groupBy(source).count().collect()}
    names = sorted(counts, key=lambda s: (s is not None, s or ""))
    if not names:
        return {}
    denominator = max(denominator, len(names))
    total = sum(counts[s] ** exponent for s in names)
    share = {s: counts[s] ** exponent / total * (denominator - len(names)) for s in names}
    out = {s: 1 + int(share[s]) for s in names}
    order = sorted(names, key=lambda s: (int(share[s]) - share[s], s is not None, s or ""))
    for s in order[: denominator - sum(out.values())]:
        out[s] += 1
    return out


def schedule(spark: SparkSession, weights: Mapping[str | None, int]) -> DataFrame:
    """One period: (source, turn, slot, release, deadline) for each of its D slots.

    The earliest-deadline-first choice runs as one fold over the slots: its state is the list of sources with the
    number of blocks that each has sent, and in each slot the least (deadline, index) among released blocks goes.
    """
    used = [(s, int(a)) for s, a in weights.items() if a > 0]
    if not used:
        return spark.createDataFrame([], "source string, turn long, slot long, release long, deadline long")
    d = sum(a for _, a in used)
    sources = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).cast("string").alias("source"), F.lit(a).cast("long").alias("a")) for k, (s, a) in enumerate(used)])
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), len(used)).alias("sent"), F.array().cast("array<struct<k:int,slot:long>>").alias("out"))

    def step(state: Column, t: Column) -> Column:
        due = F.filter(
            F.transform(sources, lambda s: F.struct(
                F.ceil((F.element_at(state["sent"], s["k"] + 1) + 1) * d / s["a"]).cast("long").alias("deadline"),
                F.floor(F.element_at(state["sent"], s["k"] + 1) * d / s["a"]).cast("long").alias("release"),
                s["k"].alias("k"),
            )),
            lambda x: x["release"] <= t,
        )
        best = F.array_min(F.transform(due, lambda x: F.struct(x["deadline"].alias("deadline"), x["k"].alias("k"))))["k"]
        return F.struct(
            F.transform(state["sent"], lambda n, i: n + F.when(i == best, F.lit(1)).otherwise(F.lit(0)).cast("long")).alias("sent"),
            F.concat(state["out"], F.array(F.struct(best.alias("k"), t.alias("slot")))).alias("out"),
        )

    slots = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(d - 1).cast("long")), start, step)["out"]
    # number the turns of each source; D rows, one partition
    rows = spark.range(1).select(F.explode(slots).alias("x")).select(F.col("x.k").alias("k"), F.col("x.slot").alias("slot"))
    rows = rows.withColumn("turn", F.row_number().over(W.partitionBy("k").orderBy("slot")).cast("long") - 1)
    named = rows.withColumn("s", F.element_at(sources, F.col("k") + 1))
    return named.select(
        F.col("s.source").alias("source"), "turn", "slot",
        F.floor(F.col("turn") * d / F.col("s.a")).cast("long").alias("release"),
        F.ceil((F.col("turn") + 1) * d / F.col("s.a")).cast("long").alias("deadline"),
    )


def _key(source: str) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def mix(docs: DataFrame, weights: Mapping[str | None, int], *, doc_id: str = "doc_id", text: str | None = "text", source: str = "source", block_docs: int = 8, rows_in_bucket: int = 1000) -> DataFrame:
    """All columns of docs, with the place of each document.

    mix_block (0, 1, ... within its source), mix_offset (within the block), mix_slot, mix_release, mix_deadline and
    mix_position = mix_slot * block_docs + mix_offset, the order in which to read; null for sources without a weight.
    rows_in_bucket sets how finely sources are cut for ranking; it doesn't change the result.
    """
    spark = docs.sparkSession
    docs = docs.drop(*OUT)
    stem = unused(docs, "_mix")
    own = {k: stem + k for k in ("_h", "_id", "_t", "_s", "_b", "_n", "_before", "_r", "_a", "_turn", "_slot")}
    order = [F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias(own["_h"]), F.col(doc_id).alias(own["_id"])]
    tie = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")) if text else F.lit("")
    digits = 1
    n = docs.count()
    while 16**digits * rows_in_bucket < n and digits < 8:
        digits += 1
    keyed = docs.select("*", *order, tie.alias(own["_t"]), _key(source).alias(own["_s"])).withColumn(own["_b"], F.substring(own["_h"], 1, digits))
    before = W.partitionBy(own["_s"]).orderBy(own["_b"]).rowsBetween(W.unboundedPreceding, -1)
    counts = docs.select(_key(source).alias(own["_s"]), F.substring(order[0], 1, digits).alias(own["_b"])).groupBy(own["_s"], own["_b"]).agg(F.count(F.lit(1)).alias(own["_n"]))
    counts = counts.select(own["_s"], own["_b"], F.coalesce(F.sum(own["_n"]).over(before), F.lit(0)).alias(own["_before"]))
    within = W.partitionBy(own["_s"], own["_b"]).orderBy(own["_h"], own["_id"], own["_t"])
    ranked = keyed.withColumn(own["_r"], F.row_number().over(within) - 1).join(counts.hint("shuffle_merge"), [own["_s"], own["_b"]]).withColumn(own["_r"], F.col(own["_r"]) + F.col(own["_before"]))

    block = F.floor(F.col(own["_r"]) / block_docs).cast("long")
    d = sum(a for a in weights.values() if a > 0)
    rows = [("" if s is None else f"={s}", int(a)) for s, a in weights.items() if a > 0]
    shares = spark.createDataFrame(rows, f"{own['_s']} string, {own['_a']} long")
    table = schedule(spark, weights).select(_key("source").alias(own["_s"]), F.col("turn").alias(own["_turn"]), F.col("slot").alias(own["_slot"]))
    placed = (
        ranked.withColumn("mix_block", block)
        .withColumn("mix_offset", (F.col(own["_r"]) % block_docs).cast("long"))
        .join(F.broadcast(shares), own["_s"], "left")  # a row for each source
        .withColumn(own["_turn"], F.col("mix_block") % F.col(own["_a"]))
        .join(F.broadcast(table), [own["_s"], own["_turn"]], "left")  # d rows
    )
    slot = F.expr(f"mix_block div {own['_a']}") * d + F.col(own["_slot"])
    placed = (
        placed.withColumn("mix_slot", slot.cast("long"))
        .withColumn("mix_release", F.floor(F.col("mix_block") * d / F.col(own["_a"])).cast("long"))
        .withColumn("mix_deadline", F.ceil((F.col("mix_block") + 1) * d / F.col(own["_a"])).cast("long"))
        .withColumn("mix_position", F.col("mix_slot") * block_docs + F.col("mix_offset"))
    )
    return placed.select(*docs.columns, *OUT)


def arrange(mixed: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """The rows in mixed order: partition by partition, and sorted within each; unweighted sources at the end."""
    last = F.coalesce(F.col("mix_position"), F.lit(2**62))
    return mixed.repartitionByRange(last, F.col(doc_id)).sortWithinPartitions(last, F.col(doc_id))
