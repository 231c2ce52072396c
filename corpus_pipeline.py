"""The corpus pipeline: five training-data operators, one after the other, over ``documents``.

Each stage works on all that its predecessor kept and returns the columns of ``documents``; the last returns packed
pieces. A stage's result is a written table before the next one reads it, so a lost executor costs one stage's tasks.
Each stage bounds the bytes of the session's Arrow batches, as the stages' peaks of memory add up in an executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.boilerplate import drop_boilerplate
from cadenza.llm.decontamination import drop_contaminated
from cadenza.llm.near_duplicates import drop_near_duplicates
from cadenza.llm.packing import pack
from cadenza.llm.shared import bound_batches, written
from cadenza.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels of the documents that are here."""
    bound_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a share of a source's documents are cut out; every document stays.

    Equal texts count as one document of a source, and a document that would lose over half of its text keeps all of it:
    what a group of exact or near copies shares is its text, not boilerplate. The next stage keeps one of them.
    """
    bound_batches(spark)
    cut = drop_boilerplate(docs, host=F.col("source"), text_col="text", distinct_texts=True, max_loss=0.5)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    bound_batches(spark)
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    bound_batches(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenised and packed."""
    bound_batches(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", packing)]

#: Toxicity scores and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
