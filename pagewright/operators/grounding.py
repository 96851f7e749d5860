"""Structured answers and citations that are checked against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_CITATIONS
from ..functions.text import SPACES, fallback_route, locate, normalize_whitespace, page_label, snippet, trim


def kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def parse_answer(content: Column, quotes: bool = True) -> Column:
    """Struct (answer, citations) of a structured answer, null unless every field is of its type: Spark's own JSON reader
    would turn numbers into text."""
    v = F.try_parse_json(content)
    items = F.try_variant_get(v, "$.citations", "array<variant>")
    fields = ["sourceId", "quote"] if quotes else ["sourceId"]
    fine = F.forall(items, lambda c: sum((F.coalesce(kind(c, f"$.{f}") == "STRING", F.lit(False)).cast("int") for f in fields), F.lit(0)) == len(fields))
    ok = (kind(v, "$.answer") == "STRING") & F.coalesce(kind(v, "$.citations").startswith("ARRAY"), F.lit(False)) & fine
    cites = F.transform(items, lambda c: F.struct(*(F.try_variant_get(c, f"$.{f}", "string").alias(a) for f, a in zip(fields, ("source_id", "quote")))))
    return F.when(ok, F.struct(F.try_variant_get(v, "$.answer", "string").alias("answer"), cites.alias("citations")))


# possessive loops: Java's engine walks them, while it calls itself for every turn of a loop over alternatives, and a text of some
# thousands of characters takes the whole stack and the executor with it
_ANSWER = r'"answer"\s*:\s*"([^"\\]*+(?:\\[\s\S][^"\\]*+)*+)'
_CLOSED = r'"answer"\s*:\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'


def decode_escapes(raw: Column) -> Column:
    r"""\n \t \r and escaped characters; a backslash before anything else is dropped, so é gives u00e9; one at the end
    is left out."""
    parts = F.regexp_extract_all(raw, F.lit(r"(\\[\s\S]|[^\\]+)"), F.lit(1))
    special = lambda p: F.when(p == "\\n", "\n").when(p == "\\t", "\t").when(p == "\\r", "\r").when(p.startswith("\\"), F.substring(p, 2, 1)).otherwise(p)
    return F.array_join(F.transform(parts, special), "")


def extract_answer(content: Column) -> Column:
    """The text of the first answer field as far as it was received."""
    return F.when(content.rlike(_ANSWER), decode_escapes(F.regexp_extract(content, _ANSWER, 1)))


def tolerant_answer(content: Column, spaces: str = SPACES) -> Column:
    """The answer of a structured answer, else what can be read of it, without spaces around it; blank: null."""
    parsed = parse_answer(content)
    return F.nullif(trim(F.when(parsed.isNotNull(), parsed["answer"]).otherwise(extract_answer(content)), spaces), F.lit(""))


def shown_content(content: Column) -> Column:
    """What a client shows: the answer of a JSON text, else a readable answer field, else the text."""
    t = trim(content)
    v = F.try_parse_json(t)
    answer = F.when(kind(v, "$.answer") == "STRING", F.nullif(trim(F.try_variant_get(v, "$.answer", "string")), F.lit("")))
    inner = F.regexp_extract(t, _CLOSED, 1)
    as_json = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), inner, F.lit('"'))), "$", "string")
    return F.coalesce(answer, F.when(t.rlike(_CLOSED), F.coalesce(as_json, decode_escapes(inner))), t)


def validated_citations(raw: DataFrame, chunks: DataFrame, by: list[str] | None = None, most: int = MAX_CITATIONS) -> DataFrame:
    """raw (by..., pos, source_id, quote) against chunks (by..., source_id, chunk_id, text, start_page_number, page_spans): the
    first ``most`` valid ones of each answer, in its order.

    A quote is whitespace-normalised and must be a literal part of its source. Unknown sources, blank and absent quotes and
    repeated places are left out first, so they don't use up the limit. The page is the one whose span holds the start. What
    is told of a place is taken from the text where it is found, so no text is dealt once more for each of its quotes.
    """
    by = by or []
    q = raw.withColumn("quote", normalize_whitespace(F.col("quote"))).where("quote <> ''")
    found = q.join(chunks, [*by, "source_id"]).withColumn("start_offset", locate(F.col("quote"), F.col("text"))).where("start_offset >= 0")
    found = found.withColumn("end_offset", F.col("start_offset") + F.length("quote"))
    page = F.filter("page_spans", lambda s: (s["start_offset"] <= F.col("start_offset")) & (F.col("start_offset") < s["end_offset"]))
    number = F.coalesce(F.try_element_at(page, F.lit(1))["page_number"], F.col("start_page_number"))
    found = found.select(*by, "pos", "source_id", "chunk_id", "quote", "start_offset", "end_offset", number.cast("long").alias("page_number"), snippet(F.col("text"), F.col("start_offset"), F.col("end_offset")).alias("snippet"))
    place = Window.partitionBy(*by, "chunk_id", "start_offset", "end_offset").orderBy("pos")
    first = found.withColumn("n", F.row_number().over(place)).where("n = 1").drop("n")
    order = Window.partitionBy(*by).orderBy("pos")
    top = first.withColumn("citation", F.row_number().over(order)).where(F.col("citation") <= most)
    return top.select(*by, F.col("citation").cast("long"), "source_id", "chunk_id", "quote", F.col("start_offset").cast("long"), F.col("end_offset").cast("long"), "page_number", "snippet")


def summary_citations(raw: DataFrame, pages: DataFrame, by: list[str] | None = None, most: int = MAX_CITATIONS) -> DataFrame:
    """raw (by..., pos, source_id) against pages (by..., source_id, page_number, summary): first ``most`` distinct known."""
    by = by or []
    found = raw.groupBy(*by, "source_id").agg(F.min("pos").alias("pos")).join(pages, [*by, "source_id"])
    return found.withColumn("citation", F.row_number().over(Window.partitionBy(*by).orderBy("pos")).cast("long")).where(F.col("citation") <= most)


def chunk_context(sources: DataFrame, by: list[str]) -> DataFrame:
    """The block of sources for a model: label, pages and text of each in order, a blank line between them."""
    line = F.concat(F.lit("["), F.col("source_id"), F.lit("] "), page_label(F.col("start_page_number"), F.col("end_page_number")), F.lit("\n"), F.col("text"))
    return sources.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))


def summary_context(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, document_summary, page_summaries, context): a document's summary and those of its pages in page order,
    labelled P<page>; a document without pages has only its own."""
    line = F.concat(F.lit("[P"), F.col("page_number").cast("string"), F.lit("] "), page_label(F.col("page_number"), F.col("page_number")), F.lit("\n"), F.col("summary"))
    each = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "summary", line.alias("line")))).alias("p"))
    out = documents.select("document_id", F.col("summary").alias("document_summary")).join(each, "document_id", "left")
    p = F.coalesce("p", F.array().cast("array<struct<page_number:int,summary:string,line:string>>"))
    blocks = F.concat(F.array(F.concat(F.lit("Document summary\n"), F.coalesce("document_summary", F.lit("")))), F.transform(p, lambda x: x["line"]))
    return out.select("document_id", "document_summary", F.transform(p, lambda x: F.struct(x["page_number"].alias("page_number"), x["summary"].alias("summary"))).alias("page_summaries"), F.array_join(blocks, "\n\n").alias("context"))


NO_SOURCES = "No source passages were found."


def prompt(title: Column, context: Column, question: Column) -> Column:
    """What a model is asked: the document, its sources (or that there are none) and the question, a blank line between them."""
    return F.concat_ws("\n\n", F.concat(F.lit("Document: "), title), F.concat(F.lit("Sources:\n"), F.coalesce(F.nullif(context, F.lit("")), F.lit(NO_SOURCES))), F.concat(F.lit("Question: "), question))


def routed(decision: Column, question: Column) -> Column:
    """(standalone_query, retrieval_mode) of a model's answer (JSON); one that isn't an object of a text that isn't blank and a
    known mode gives way to the decision without a model."""
    v = F.try_parse_json(decision)
    said = normalize_whitespace(F.try_variant_get(v, "$.standaloneQuery", "string"))
    mode = F.try_variant_get(v, "$.retrievalMode", "string")
    fine = (kind(v, "$.standaloneQuery") == "STRING") & (kind(v, "$.retrievalMode") == "STRING") & (said != "") & mode.isin("chunks", "summaries")
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(said.alias("standalone_query"), mode.alias("retrieval_mode"))).otherwise(fallback_route(question))
