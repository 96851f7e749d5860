"""Pages of text to overlapping word windows that remember which page every character came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHUNK_OVERLAP, CHUNK_WORDS
from ..functions.text import NOT_WS, WS_CHARS, normalize_whitespace, tokens

WORDED = rf"[^{WS_CHARS}\x00]"
NO_TEXT = "[No extractable text found in this PDF.]"  # fixed value


def chunk_count(words: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """How many windows cover so many words; 0 words: 0."""
    step = size - overlap
    return F.when(words <= 0, 0).when(words <= size, 1).otherwise(F.ceil((words - size) / step) + 1).cast("int")


def windows(words: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of word windows of an array of words."""
    n = chunk_count(F.size(words), size, overlap)
    first = F.lit(size - overlap)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(words, i * first + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def text_chunks(docs: DataFrame, key: str = "document_id", text: str = "text", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_index, text, token_count) of documents without pages. No shuffle: a projection and an explode."""
    cut = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("w")).select(key, F.posexplode(windows(F.col("w"), size, overlap)).alias("chunk_index", "w"))
    return cut.select(key, "chunk_index", F.array_join("w", " ").alias("text"), F.size("w").alias("token_count"))


def page_pieces(pages: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, drop: str = "\x00") -> DataFrame:
    """document_id, chunk_index, page_number, piece, n_words, start_offset, end_offset: what each chunk holds of each page.

    A document's words in page order are one stream; a page's place in it is the sum of the words before it. Offsets count code
    points of the chunk's text, with one space between words. Pages come together by document once, as texts of words with one
    space between them; nothing holds a document as a whole. Whether a page has words is asked of its first one, so that no page
    is cut into words twice. ``drop`` (NUL) is no part of a word; "" keeps it.
    """
    step = size - overlap
    words = normalize_whitespace(F.replace("extracted_text", F.lit(drop), F.lit("")) if drop else F.col("extracted_text"))
    page = pages.where(F.col("extracted_text").rlike(WORDED if drop else NOT_WS)).select("document_id", "page_number", words.alias("t"))
    page = page.withColumn("n", F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit(""))) + 1)
    whole = Window.partitionBy("document_id")
    upto = whole.orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    page = page.withColumn("at", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("int")).withColumn("chunks", chunk_count(F.sum("n").over(whole), size, overlap))
    low = F.greatest(F.lit(0), F.ceil((F.col("at") - size + 1) / step)).cast("int")
    high = F.least(F.col("chunks") - 1, F.floor((F.col("at") + F.col("n") - 1) / step)).cast("int")
    page = page.select("document_id", "page_number", "t", "n", "at", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))).alias("chunk_index"))
    first = F.greatest(F.col("chunk_index") * step - F.col("at"), F.lit(0))
    last = F.least(F.col("chunk_index") * step + size - F.col("at"), F.col("n"))
    cut = F.array_join(F.slice(F.split("t", " "), first + 1, last - first), " ")
    part = F.when((first == 0) & (last == F.col("n")), F.col("t")).otherwise(cut)
    piece = page.where(first < last).select("document_id", "chunk_index", "page_number", part.alias("piece"), (last - first).alias("n_words"))
    before = Window.partitionBy("document_id", "chunk_index").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece") + 1).over(before), F.lit(0)).cast("int")
    return piece.withColumn("start_offset", start).withColumn("end_offset", (F.col("start_offset") + F.length("piece")).cast("int"))


def page_chunks(pages: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """pages (document_id, page_number, extracted_text) to chunks: document_id, chunk_index, start_page_number,
    end_page_number, text, token_count, page_spans (page_number, start_offset, end_offset in code points of the text).

    Spans of neighbouring pages leave out the space between them. A document without words gets one chunk that says so. A chunk
    is made of ``size`` words at most, so no row grows with a document; the shuffle by document serves all steps.
    """
    part = F.struct(F.col("page_number").cast("int").alias("page_number"), "piece", "start_offset", "end_offset")
    whole = page_pieces(pages, size, overlap).groupBy("document_id", "chunk_index").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum("n_words").cast("int").alias("token_count"))
    spans = F.transform("parts", lambda x: F.struct(x["page_number"].alias("page_number"), x["start_offset"].alias("start_offset"), x["end_offset"].alias("end_offset")))
    full = whole.select(
        "document_id",
        "chunk_index",
        F.col("parts")[0]["page_number"].alias("start_page_number"),
        F.try_element_at("parts", F.lit(-1))["page_number"].alias("end_page_number"),
        F.array_join(F.transform("parts", lambda x: x["piece"]), " ").alias("text"),
        "token_count",
        spans.alias("page_spans"),
    )
    wordless = ~F.bool_or(F.coalesce(F.col("extracted_text").rlike(WORDED), F.lit(False)))
    empty = pages.groupBy("document_id").agg(F.min("page_number").cast("int").alias("first"), F.max("page_number").cast("int").alias("last"), wordless.alias("wordless")).where("wordless")
    span = F.array(F.struct(F.col("first").alias("page_number"), F.lit(0).alias("start_offset"), F.lit(len(NO_TEXT)).alias("end_offset")))
    said = empty.select("document_id", F.lit(0).alias("chunk_index"), F.col("first").alias("start_page_number"), F.col("last").alias("end_page_number"), F.lit(NO_TEXT).alias("text"), F.lit(len(NO_TEXT.split())).alias("token_count"), span.alias("page_spans"))
    return full.unionByName(said)
