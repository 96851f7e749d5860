"""OCR payloads to a dense page table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import anchor_places, is_blank, normalize_extracted

SHARD_SCHEMA = "text STRING, pages ARRAY<STRUCT<pageNumber: INT, layout: STRUCT<textAnchor: STRUCT<textSegments: ARRAY<STRUCT<startIndex: STRING, endIndex: STRING>>>>>>"


@F.udf(ArrayType(StringType()), useArrow=True)
def _cut(text: str, places: list[list[int]] | None) -> list[str] | None:
    """Pages as pieces of a text, by code points: begin and end of each piece. Spark would walk a text from its start for each."""
    return None if places is None else ["".join(text[a:b] for a, b in zip(page[::2], page[1::2])) for page in places]


def shard_pages(shards: DataFrame) -> DataFrame:
    """shards (document_id, shard_index, text, pages) to (document_id, page_number, extracted_text, ord) in reading order. A
    shard with text but no pages is page 1; a page number that is missing or not positive is the page's position. Texts are cut
    before pages become rows, so a text isn't repeated for each of its pages."""
    none = F.coalesce(F.size("pages"), F.lit(0)) <= 0
    text = F.coalesce("text", F.lit(""))
    each = F.transform("pages", lambda p: anchor_places(p["layout"]["textAnchor"]["textSegments"]))
    places = F.when(~none, each).when(~is_blank(F.col("text")), F.array(F.array(F.lit(0), F.length(text))))
    number = F.transform("pages", lambda p, i: F.when(p["pageNumber"] > 0, p["pageNumber"]).otherwise(i + 1).cast("int"))
    cut = shards.select("document_id", "shard_index", F.when(none, F.array(F.lit(1))).otherwise(number).alias("number"), text.alias("text"), places.alias("places"))
    rows = cut.select("document_id", "shard_index", "number", _cut("text", "places").alias("texts")).select("document_id", "shard_index", F.posexplode(F.arrays_zip("number", "texts")).alias("pos", "page"))
    return rows.select("document_id", F.col("page.number").alias("page_number"), normalize_extracted(F.col("page.texts")).alias("extracted_text"), F.struct("shard_index", "pos").alias("ord"))


def last_write(pages: DataFrame, order: str = "ord") -> DataFrame:
    """Of pages with one number, the one written last; pre-aggregated, without a sort."""
    return pages.groupBy("document_id", "page_number").agg(F.max_by("extracted_text", order).alias("extracted_text"))


def dense(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Pages 1..N of each document of expected (document_id, page_count), missing ones blank; N is the larger of the
    expected count and the largest page number. Texts are read once: what is missing is told by the page before."""
    own = expected.select("document_id", F.coalesce("page_count", F.lit(0)).cast("int").alias("_n"))
    real = pages.where("page_number >= 1").select("document_id", F.col("page_number").cast("int").alias("_p"), "extracted_text")
    order = Window.partitionBy("document_id").orderBy("_p")
    each = own.join(real, "document_id", "left").withColumn("_before", F.coalesce(F.lag("_p").over(order), F.lit(0))).withColumn("_last", F.lead("_p").over(order).isNull())
    # a page and the missing ones before it; after a document's last page also those up to the expected count
    first = F.when(F.col("_p").isNull(), 1).otherwise(F.least(F.col("_before") + 1, F.col("_p")))
    last = F.when(F.col("_last"), F.greatest("_n", F.coalesce("_p", F.lit(0)))).otherwise(F.col("_p"))
    text = lambda i: F.when(i == F.col("_p"), F.coalesce("extracted_text", F.lit(""))).otherwise("")
    filled = F.when(first <= last, F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("page_number"), text(i).alias("extracted_text"))))
    return each.select("document_id", F.inline(filled))


def extract_pages(shards: DataFrame, expected: DataFrame) -> DataFrame:
    return dense(last_write(shard_pages(shards)), expected)


def with_summaries(pages: DataFrame, summaries: DataFrame) -> DataFrame:
    """pages with their summaries; a page without one or with two is an error."""
    once = summaries.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("n"), F.first("summary").alias("summary"))
    joined = pages.join(once, ["document_id", "page_number"], "left")
    message = F.concat(F.lit("page "), F.col("page_number").cast("string"), F.when(F.col("n").isNull(), " has no summary").otherwise(" has more than one summary"))
    checked = F.when(F.coalesce("n", F.lit(0)) == 1, F.col("summary")).otherwise(F.raise_error(message).cast("string"))
    return joined.withColumn("summary", checked).drop("n")


def batches(rows: DataFrame, size: int, key: str, order: str) -> DataFrame:
    """batch_id of rows in their key's order: floor(position / size)."""
    return rows.withColumn("batch_id", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size))
