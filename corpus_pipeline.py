"""A corpus pipeline: language ID, toxicity, near duplicates, decontamination, mixing.

Each stage takes what the one before kept, written as Parquet and read again, and is a function of its input alone. The
first four return rows of `documents`, fewer of them; the last returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import drop_table, new_path, write_table
from vellum.llm.decontaminate import remove_leaks
from vellum.llm.jaccard import keep_one
from vellum.llm.langid import keep_identified
from vellum.llm.mixing import mix_documents
from vellum.llm.toxicity import remove_toxic


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that are null or without a letter, and those of which fewer than three words in ten are of a language that
    the labelled rows teach. Rows are judged one by one, repeated ones alike; where no row is labelled all stay."""
    return keep_identified(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that the classifier, fitted on the labelled ones among them, calls toxic. Rows are judged one by one, repeated
    ones alike, null and empty texts as padding; null ids and labels only take no part in the fit."""
    return remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked by a similarity of 0.8 or more of their sets of five words: that with the smallest
    doc_id (null last), then text hash, then other columns. Rows without words all stay."""
    return keep_one(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark, exactly or with few edits. Null and empty texts stay, null and empty
    items remove nothing, and neither do items under five words."""
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document left the mix takes. Null sources are a source of their own, rows without words take
    nothing, rows with one doc_id share a decision."""
    return mix_documents(docs)


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix)]

#: The classifiers and the edit-distance search have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage read is dropped when what it kept is written."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        docs = write_table(stage(spark, docs, sf_dir), path)
        if old:
            drop_table(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
