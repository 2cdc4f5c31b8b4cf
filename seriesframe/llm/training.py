"""Labelled training rows for the classifiers, bounded so that they can be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, n: int):
    """crc32 of the id as text, modulo n (null ids: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def labelled(docs: DataFrame, labels: DataFrame, *, label: str, per_class: int, skip: tuple[int, int] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most per_class label rows of each class.

    The rows are those with the smallest hashes of doc_id, whatever their order and number; there are at
    most 2 * per_class of them (16 bytes each), so they are broadcast and the documents aren't shuffled.
    skip=(n, r) leaves out ids whose crc32 modulo n is r.  Null ids and labels are never used.  Documents that repeat an id
    give one row (the text with the least hash), so that the bound holds.
    """
    rows = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").distinct()
    if skip:
        rows = rows.where(remainder("_id", skip[0]) != skip[1])
    order = (F.xxhash64("_id"), F.col("_id"))
    bounded = rows.where("_y = 0").orderBy(*order).limit(per_class).unionByName(rows.where("_y = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    found = texts.join(F.broadcast(bounded), "_id").groupBy("_id", "_y").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t"))
    return found.select(F.col("_id").alias("doc_id"), F.col("_t").alias("text"), F.col("_y").alias("label"))
