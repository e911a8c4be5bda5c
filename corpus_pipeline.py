"""The corpus pipeline: five stages over documents, each written and read again.

Null ids, repeated rows, null and empty texts and empty tables go through every
stage; what each does with them is said there. Columns other than doc_id and
text are carried as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import queries as Q
from graphloom.llm import scan
from graphloom.llm.decontam import drop_contaminated
from graphloom.llm.jaccard_join import near_classes
from graphloom.llm.line_dedup import dedup_lines
from graphloom.llm.quality import fit_quality, score_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (score under 0.3); a null text is scored as an empty one.

    Without labels every score is 0.5, and all stay.
    """
    forest = fit_quality(docs, Q.table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct("*").alias("doc"), F.col("text").alias("text"))
    return score_quality(whole, forest).where("predicted = 1").select("doc.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three lines in a row that stand earlier too are cut out; every document stays, if with an empty text.

    A null text stays null; rows that repeat an id and a text are cut alike.
    """
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays: that with the smallest id (nulls last) and, among repeated ids, the smallest text.

    Rows without words are in no group and all stay.
    """
    scratch = scan.Scratch(spark)
    row = "doc_id"
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        # Ids that don't tell rows apart give way to numbers in the same order.
        row = "__row"
        docs = scratch.save(docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn(row, F.monotonically_increasing_id()))
    classes = near_classes(docs.select(F.col(row).alias("doc_id"), "text"), scratch)
    gone = classes.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(row) == F.col("__gone"), "left_anti").drop("__row")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more lie in passages of the benchmark; without words none does."""
    return drop_contaminated(docs, Q.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the tokens of each text, and of what they decode to, in place of the text; null is empty."""
    return Q.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def _small_batches(stage):
    """The stage with Arrow batches of 16 MB at most, set in the session: its workers hold whole batches of text."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _small_batches(stage)) for name, stage in (("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("bpe", encode))]

#: The classifier can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = scan.Scratch(spark)
    docs = Q.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
