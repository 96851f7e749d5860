"""Model providers behind one interface. The ones here are deterministic stand-ins that work offline: a hashed bag of words
as embedding, and a first sentence as summary. A real provider replaces the function that maps a batch of texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EMBEDDING_BATCH, EMBEDDING_WIDTH, EMPTY_DOCUMENT_SUMMARY, EMPTY_PAGE_SUMMARY, MAX_PAGES
from .text import WS_CHARS, embedding_input, is_blank, normalize_whitespace


_SPACES = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), WS_CHARS) + "]+")


def hashed_embeddings(texts: list[str], width: int = EMBEDDING_WIDTH) -> np.ndarray:
    """One row for each text: its words (lower-cased) counted in places told by the first 32 bits of their MD5, with a sign by the
    first of them, and scaled to length 1."""
    words = [[w for w in _SPACES.split(t.lower()) if w] for t in texts]
    known: dict[str, int] = {}
    at = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64)
    h = np.fromiter((int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in known), np.int64, len(known))[at]
    row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    counts = np.bincount(row * width + h % width, np.where(h >> 31, 1.0, -1.0), len(texts) * width)  # whole numbers: exact
    out = counts.reshape(len(texts), width)
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1, n)


def embedded(chunks: DataFrame, provider: Callable[[list[str], int], list[list[float]]] = hashed_embeddings, width: int = EMBEDDING_WIDTH, batch: int = EMBEDDING_BATCH) -> DataFrame:
    """chunks with embedding, asked for in batches of ``batch`` texts; a batch that comes back with another number of vectors or
    another width is an error."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for i in range(0, len(s), batch):
                texts = s.iloc[i : i + batch].tolist()
                v = provider(texts, width)
                if len(v) != len(texts) or any(len(x) != width for x in v):
                    raise ValueError("the embedding batch doesn't match its input")
                out += list(v)
            yield pd.Series(out)

    return chunks.withColumn("embedding", run(embedding_input(F.col("text"), F.col("chunk_index"))))


def summarised(texts: list[str]) -> list[str]:
    """page_summary as a provider: the first sentence of each text, 200 characters at most."""
    out = []
    for t in texts:
        line = _SPACES.sub(" ", t).strip(" ")
        first = re.match(r"(.{1,200}?)(?:[.!?](?: |$)|$)", line)
        out.append(first[1] if first else line[:200])
    return out


def page_summary(text: Column) -> Column:
    """Stand-in: the first sentence, 200 characters at most; blank pages have a fixed one."""
    first = F.regexp_extract(normalize_whitespace(text), r"^(.{1,200}?)(?:[.!?](?: |$)|$)", 1)
    return F.when(is_blank(text), F.lit(EMPTY_PAGE_SUMMARY)).otherwise(F.coalesce(F.nullif(first, F.lit("")), F.substring(normalize_whitespace(text), 1, 200)))


def document_summaries(pages: DataFrame) -> DataFrame:
    """(document_id, summary): the pages' summaries in order; if all pages are empty, a fixed one."""
    s = F.array_sort(F.collect_list(F.struct("page_number", "summary")))
    joined = F.array_join(F.transform(F.filter(s, lambda p: p["summary"] != EMPTY_PAGE_SUMMARY), lambda p: p["summary"]), " ")
    empty = F.bool_and(F.col("summary") == EMPTY_PAGE_SUMMARY)
    return pages.groupBy("document_id").agg(F.when(empty, EMPTY_DOCUMENT_SUMMARY).otherwise(joined).alias("summary"))


def page_ranges(pages: Column, each: int = MAX_PAGES) -> Column:
    """The shards of a batch OCR job: (first, last) pages, ``each`` at most, without overlap."""
    n = F.ceil(pages / each).cast("int")
    ranges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * each + 1).cast("int").alias("first"), F.least((i + 1) * each, pages).cast("int").alias("last")))
    return F.when(pages > 0, ranges).otherwise(F.array().cast("array<struct<first:int,last:int>>"))


def ocr_job(files: DataFrame, read: Callable[[DataFrame], DataFrame], each: int = MAX_PAGES) -> DataFrame:
    """A batch OCR job over files (document_id, page_count, ...): each document is dealt into shards of pages, ``read`` gives
    (document_id, shard_index, text, pages) for (document_id, shard_index, first, last, ...); a document without any output is
    an error."""
    asked = files.select("*", F.posexplode(page_ranges(F.col("page_count"), each)).alias("shard_index", "range")).select("*", "range.first", "range.last").drop("range")
    got = read(asked).withColumn("_found", F.lit(True))
    # one row more for each document, so that a document is seen without asking for its output twice
    every = got.unionByName(files.select("document_id", F.lit(False).alias("_found")), allowMissingColumns=True)
    some = F.max("_found").over(Window.partitionBy("document_id"))  # as many rows as a document has shards
    failed = F.raise_error(F.concat(F.lit("no OCR output for "), F.col("document_id").cast("string"))).cast("boolean")
    return every.withColumn("_some", some).where(F.when(F.col("_some"), F.col("_found")).otherwise(failed)).drop("_found", "_some")
