"""The corpus pipeline: documents that are toxic or near copies go, repeated strings are cut, sources are mixed to their
targets, and what is left is packed into batches. Every stage is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import minhash, mixing, packing, suffix, toxicity
from pagewright.llm.store import delete, documents, scratch, shared_dir


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.drop_repeated_strings(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("toxicity", toxic), ("near copies", near_copies), ("repeated strings", repeated_strings), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None  # classifiers and minima aren't expressible; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed batches of the whole corpus. What a stage leaves in the shared folder is deleted once its table stands, and that
    table once the next one does; the last one is what is given back."""
    docs, last = documents(spark, sf_dir), None
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, [last])
        last = path
    return docs
