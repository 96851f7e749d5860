"""Schemas of the store's tables, and readers of Parquet and OCR shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pages import SHARD_SCHEMA

SPAN = "STRUCT<page_number: INT, start_offset: INT, end_offset: INT>"
CITATION = "STRUCT<chunk_id: STRING, source_id: STRING, quote: STRING, page_number: INT, start_offset: INT, end_offset: INT, snippet: STRING, document_id: STRING>"
SCHEMAS = {
    "documents": "id STRING, owner STRING, title STRING, filename STRING, summary STRING, summary_model STRING, content_type STRING, size LONG, sha256 STRING, status STRING, page_count INT, error STRING, created_at TIMESTAMP, upload_completed_at TIMESTAMP, processing_started_at TIMESTAMP, ocr_completed_at TIMESTAMP, embeddings_completed_at TIMESTAMP, attempt INT, ocr_model STRING, embedding_model STRING, embedded_pages INT, embedded_chunks INT, storage_uri STRING, output_uri STRING",
    "pages": "document_id STRING, page_number INT, extracted_text STRING, summary STRING, extraction_method STRING",
    "chunks": f"document_id STRING, chunk_index INT, start_page_number INT, end_page_number INT, text STRING, token_count INT, page_spans ARRAY<{SPAN}>, embedding ARRAY<DOUBLE>, embedding_model STRING",
    "conversations": "id STRING, owner STRING, document_id STRING, title STRING, created_at TIMESTAMP",
    "messages": f"conversation_id STRING, role STRING, content STRING, citations ARRAY<{CITATION}>, created_at TIMESTAMP",
}
SPREAD_BYTES = 32 << 20  # of input for each core; larger inputs are in enough pieces as they are
HIDDEN = ("summary", "sha256", "attempt", "owner", "summary_model")  # not for lists
INTERNAL = ("error",)
LIST_COLUMNS = [c.strip().split(" ")[0] for c in SCHEMAS["documents"].split(",") if c.strip().split(" ")[0] not in HIDDEN]


def list_items(documents: DataFrame) -> DataFrame:
    """What a list shows of documents; the file's URL is asked for apart."""
    return documents.select(*(c for c in LIST_COLUMNS if c in documents.columns), F.lit(None).cast("string").alias("file_url"))


def without_internal(df: DataFrame) -> DataFrame:
    return df.drop(*INTERNAL)


def spread(df: DataFrame) -> DataFrame:
    """A small input in as many pieces as there are cores: a file of one row group would be one task. Inputs beyond
    SPREAD_BYTES a core come in many row groups and are left as they are, so no large text is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SPREAD_BYTES else df


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{base}/{name}")


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ocr_shards(spark: SparkSession, path: str, document_id: str) -> DataFrame:
    """JSON payloads of one document, in the order of their names."""
    from pyspark.sql import Window

    raw = spark.read.schema(SHARD_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    named = raw.select("*", F.col("_metadata.file_path").alias("_file")).where("text is not null or pages is not null")
    name = F.collate(F.element_at(F.split("_file", "/"), -1), "UNICODE")  # as a locale sorts names
    order = F.row_number().over(Window.orderBy(name, "_file")) - 1  # shards of one document: one per 100 pages
    return named.withColumn("shard_index", order).withColumn("document_id", F.lit(document_id)).drop("_file")


def payload_json(payload: DataFrame) -> DataFrame:
    """Each row as an indented JSON text (value)."""
    return payload.select(F.to_json(F.struct(*payload.columns), {"pretty": "true"}).alias("value"))


def write_payload(payload: DataFrame, path: str) -> str:
    """One JSON text for each row; the URI under which they were written."""
    payload_json(payload).write.mode("overwrite").option("lineSep", "\n").text(path)
    return path
