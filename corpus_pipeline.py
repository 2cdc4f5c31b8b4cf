"""The corpus pipeline: quality filter, near-dedup, substring dedup, source mixing, tokens.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next one's docs.
run(spark, sf_dir) applies all of them to `documents`.

All stages take the columns of `documents` only; other columns go, whatever their names.  Null lang, source and n_chars are kept as they are.
Rows may repeat, and are documents of their own but in near_dedup.  Texts of any length are taken whole.  An empty table gives an empty result.
What a null or empty text, a tie or a null id means is said at each stage.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesframe.llm import mixing, neardup, quality, spm, substring, tables, training
from seriesframe.llm.queries import PER_CLASS
from seriesframe.llm.tables import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
PART_CHARS = 8 << 20  # of the texts of one task's tokens, on average
PARTS = 200_000  # such tasks, at most; they stream their rows, so larger ones take longer, not more memory


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.7 or more); trained as in its query.

    Null and empty texts are scored like others, as texts without words; equal texts have equal scores, so ties go or stay together; rows
    with a null id are scored, but never trained on.  Without labels of both classes all scores are 0.5, and nothing is accepted.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(training.labelled(docs, labels, label="quality", per_class=PER_CLASS, skip=(4, 2)))
    scored = quality.score(docs.select(*COLUMNS), model, score_col="_score", predicted_col="_predicted")
    return scored.where("_predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the least id.

    Of rows that repeat its id one stays: the least by the digest of its text, then by its columns.  Rows without an id all stay; so do null and
    empty texts, which are like nothing (with one row for each id).
    """
    docs = docs.select(*COLUMNS)
    work = Workspace(spark, "kept")
    several = work.save(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 and doc_id is not null").select("doc_id"), "several")
    kept = work.save(neardup.classify(docs).where("kept and doc_id is not null").select("doc_id").distinct(), "kept")
    once = tables.pick(docs, work.save(kept.join(several, "doc_id", "left_anti"), "once"), "doc_id")
    repeated = tables.pick(docs, work.save(kept.join(several, "doc_id", "left_semi"), "repeated"), "doc_id")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_h")
    first = repeated.groupBy("doc_id").agg(F.min(F.struct(digest, "text", "lang", "source", "n_chars")).alias("_x")).select("doc_id", "_x.*")  # a hot id is reduced before the shuffle
    return once.unionByName(first.select(*COLUMNS)).unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur more than once.

    All copies of a passage go, so ties need no order; a text that loses nothing stays as it is, null ones too, and others are their kept words
    joined by one space, with n_chars to match.  Rows with null or repeated ids are documents like others.
    """
    return substring.remove(docs.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixed order (file by file, row by row): sources interleaved to tempered weights, within less than one block.

    A null source is a source of its own, and null or empty texts are documents; within a source, ids are ordered by their digest, ties by
    the id (null ids like empty ones) and the text's digest; equal rows come in any order.
    """
    docs = docs.select(*COLUMNS)
    return mixing.arrange(mixing.mix(docs, mixing.tempered_weights(docs))).select(*COLUMNS)


def numbered(spark: SparkSession, docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns, and position: 0, 1, ... file by file (as Spark numbers the files of a table) and row by row; rows are dealt and sorted by it.

    Readers cut and pack files by size, so that the order in which rows are read says nothing.  Tables that don't come from files
    are written first.  One count for each file comes to the driver.
    """
    try:
        rows = docs.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return numbered(spark, Workspace(spark, "ordered").save(docs, "docs"), columns)
    sized = docs.select(F.col("_metadata.file_path").alias("_file"), F.coalesce("n_chars", F.lit(0)).alias("_c"))
    files = sized.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.sum("_c").alias("c")).collect()

    def place(path: str) -> tuple[str, list[tuple[int, str]]]:
        """The folder, then digits as numbers: part-100000 comes after part-99999."""
        folder, _, name = path.rpartition("/")
        return folder, [(int(x or 0), y) for x, y in re.findall(r"(\d*)(\D*)", name)]

    start, starts = 0, []
    for r in sorted(files, key=lambda r: place(r["_file"])):
        starts.append((r["_file"], start))
        start += r["n"]
    parts = min(max(1, sum(r["c"] for r in files) // PART_CHARS, spark.sparkContext.defaultParallelism), max(1, start), PARTS)
    share = max(1, -(-start // parts))
    table = F.broadcast(spark.createDataFrame(starts, "_file string, _start long"))  # a row for each file
    rows = rows.join(table, "_file").withColumn("position", F.col("_start") + F.col("_row")).select(*columns, "position")
    part = F.expr(f"position div {share}").cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions("position")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, position, ids, n_tokens, decoded_sha256 and exact of each document, in the order of the table of mixed documents.

    position is the document's place in that order; the rows come, and are written, in it.  Null and empty texts have no ids and decode to "";
    exact says that the ids give the text back.
    """
    keep = ["doc_id", "source", "position"]
    return spm.encode_column(numbered(spark, docs, ("doc_id", "source", "text")), spm.load(spm.MODEL_PATH), keep=keep, verify=True)


STAGES = (
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("tokens", tokens),
)

#: SQL can't express the classifier's Cholesky scores or the tokenizer's merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
