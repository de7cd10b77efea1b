"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Empty tables, nulls in any column and repeated rows pass
through as each operator defines; of repeated rows with one doc_id and text the near-duplicate stage keeps one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from logsieve.llm import decontam, mixing, neardup, planes, quality
from logsieve.llm.queries import POLICY, table, tokenizer_path
from logsieve.operators import scale


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps. The verdict is per doc_id and text, so it is judged beside the text."""
    return quality.keep(docs, POLICY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near duplicates."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.apply(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the written files."""
    target = planes.new_target(spark)
    planes.write_ids(docs, target, tokenizer_path())
    return planes.read_ids(spark, target, ids=False)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", source_mixing), ("token ids", token_output)]

# Tokens cannot be stated in SQL: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scale.shared_dir(spark)}/logsieve/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
