"""Corpus pipeline: quality, language, near duplicates, packing over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.llm.common import TextWorkspace, table
from fluvial.llm.jaccard import jaccard_classes
from fluvial.llm.langid import keep_determined, train_languages
from fluvial.llm.packing import pack_documents
from fluvial.llm.quality import keep_quality, train_quality

#: SQL cannot express the trained stages; tests/llm/test_pipeline.py holds them against brute-force versions.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents for which ``op8_quality`` predicts 1; the classifier learns from the whole tables' labelled rows."""
    model = train_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return keep_quality(docs, model)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents for which ``op9_language_id`` gives a language, not ``und``."""
    return keep_determined(docs, train_languages(table(spark, sf_dir, "documents")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of five-word shingle sets with a Jaccard similarity of 0.8 or more.

    The row with the class's least id stays. Every row is judged by its own
    text, also where rows repeat an id. Rows without id, and those without
    words, link with nothing and stay.
    """
    # Written once, since the numbers depend on how the rows are read.
    numbered = docs.filter("doc_id is not null").withColumn("_row", F.monotonically_increasing_id())
    rows = TextWorkspace(spark, "dedup").keep(numbered, "rows")
    classes = jaccard_classes(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    keys = rows.select("_row", F.struct("doc_id", F.xxhash64("text"), "_row").alias("key"))
    kept = classes.join(keys, "_row").groupBy("component_id").agg(F.min("key")["_row"].alias("_row")).select("_row")
    return rows.join(kept, "_row", "left_semi").select(docs.columns).union(docs.filter(F.col("doc_id").isNull()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences of at most 1024."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written before the next; what a stage has read is deleted then."""
    ws, docs = TextWorkspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return found
        found = ws.keep(found, name)
        ws.drop(docs)
        docs = found
