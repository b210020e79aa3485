"""The stages of the corpus pipeline: quality, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame that
is written as Parquet and read again for the next. All but the last return the columns of documents. All stages keep
columns of any other names, treat repeated rows as the docstrings say, and give an empty table for an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, neardup, packing, quality
from .common import checkpoint_dir, fold_of, table, vocab

#: Documents of less quality, or of a language less sure, go.
QUALITY_LEAST, LANGUAGE_LEAST = 0.3, 0.6


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is at least QUALITY_LEAST; folds as in the query.

    Null and empty texts have the score of an empty passage; very long texts count whole; equal texts have equal
    scores, so repeated rows stay or go together; null ids are scored like others.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 5) == 0)
    return quality.score(docs, model, docs.columns, out="__quality").where(F.col("__quality") >= QUALITY_LEAST).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is at least LANGUAGE_LEAST sure; where lang is null, it becomes the prediction.

    Texts that are null, empty or without a letter have no language and go; equal texts get equal predictions. Where no
    document has a language to learn from, none can be told and all stay.
    """
    model = langid.fit(docs.where(fold_of(F.col("doc_id"), 4) != 2))
    if not model.langs:  # nothing to learn from: no document can be told
        return docs
    out = langid.predict(docs, model, docs.columns, out=("__lang", "__sure")).where((F.col("__lang") != langid.UNKNOWN) & (F.col("__sure") >= LANGUAGE_LEAST))
    return out.withColumn("lang", F.coalesce("lang", "__lang")).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: that of least id and of least text digest among those.

    Rows are told apart by id and text, so rows that share an id, or have none, are compared by their texts alone, and no
    text is lost. Of equal rows one stays, any of them. Null and empty texts are one class.
    """
    rows = neardup.rows_by_class(docs)
    stay = rows.groupBy("class_node").agg(F.min(F.struct("id", "node")).alias("row")).select(F.col("row.id").alias("__id"), F.col("row.node").alias("__node"))
    d = docs.withColumns({"__id": neardup.id_of(F.col("doc_id")), "__node": neardup.node_of(F.col("text"))})
    return d.join(stay, ["__id", "__node"], "left_semi").dropDuplicates(["__id", "__node"]).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with each document's language and source; null texts are the end id alone."""
    return packing.pack(docs, vocab("byte_bpe_50k.json"), keep=("lang", "source"))


STAGES = [("quality classifier", quality_stage), ("language id", language_stage), ("near duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: No stage can be expressed in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder, read again, and removed once the next is written."""
    docs = table(spark, sf_dir, "documents")
    at = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{i - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
