"""Corpus pipeline: documents in, packed training sequences out.

Each stage is written as Parquet to the shared folder and read again by the next one. What a stage wrote for itself goes
when its result is written, and a stage's result when the next one's is, so a lost executor costs a stage at most and the
disk holds two stages. All but the last return the columns of ``documents``, and
further columns as they are, whatever their names. An empty table passes through every stage and gives an empty result;
repeated rows, and rows without an id, are documents of their own until ``near_dedup``, which lets rows that share an id
stay or go together and keeps those without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._base import Scratch, beside, own_tables
from tidemark.llm.best_fit_packing import pack_texts
from tidemark.llm.line_frequency import drop_site_lines
from tidemark.llm.order_minhash import keep_one_of_each
from tidemark.llm.site_quality import classify, learn
from tidemark.llm.suffix_decontam import remove_contaminated


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good. It is fitted on the labelled ones among ``docs``."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = learn(docs, labels)
    return beside(docs, ["p_doc", "p_host", "p_path", "p_good", "predicted"], lambda d: classify(d, model).where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are boilerplate of their source; ``n_chars`` follows the text."""
    return beside(docs, ["n_lines", "n_dropped"], lambda d: drop_site_lines(d).withColumn("n_chars", F.length("text").cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return remove_contaminated(docs, _read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return pack_texts(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]
#: Near-duplicate classes and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch, docs = Scratch(spark, "pipeline"), _read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        with own_tables(spark):
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
