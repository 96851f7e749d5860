"""What a workspace shows: filters, orders, recency groups, counts, pipeline steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import RECENT_EVENTS, STEPS
from ..functions.text import file_size, trim
from .grounding import shown_content


def text_filter(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows whose joined columns contain the query, whatever the case; a blank query keeps all."""
    q = query.strip().lower()
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(q))) if q else df


def alphabetical(c: Column) -> Column:
    """Order key that ignores case and accents."""
    return F.collate(c, "UNICODE_CI_AI")


def recency_bucket(created: Column, now: Column) -> Column:
    return F.when(created >= F.date_trunc("day", now), "today").when(created >= now - F.expr("INTERVAL 7 DAYS"), "week").otherwise("earlier")


def status_counts(df: DataFrame, status: str = "status", by: list[str] | None = None) -> DataFrame:
    s = F.col(status)
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), F.count_if(s.isin("uploading", "uploaded")).alias("uploading"), F.count_if(s == "ready").alias("ready"))


def filtered_label(df: DataFrame, hit: Column) -> DataFrame:
    return df.agg(F.count_if(hit).alias("shown"), F.count(F.lit(1)).alias("total")).select("shown", "total", F.concat(F.col("shown").cast("string"), F.lit("/"), F.col("total").cast("string")).alias("label"))


def status_label(s: Column) -> Column:
    return F.when(s == "uploading", "Uploading").when(s == "uploaded", "Uploaded").when(s == "processing", "Processing").when(s == "ready", "Ready").when(s == "failed", "Failed")


def caption(status: Column, pages: Column) -> Column:
    return F.when(pages.isNotNull(), F.concat(pages.cast("string"), F.lit(" pages"))).when(status == "ready", "Ready").otherwise("Processing")


def pipeline_steps(status: Column, ocr_at: Column, embedded_at: Column, pages: Column, size: Column, error: Column) -> Column:
    """Array of steps (step, state, detail). A step is done once its mark stands; the first one that isn't is active or failed, by
    the document's status; later ones are pending."""
    count = F.coalesce(pages.cast("string"), F.lit("?"))
    done = {"upload": status != "uploading", "ocr": ocr_at.isNotNull(), "embedding": embedded_at.isNotNull()}
    busy = {"upload": F.lit(True), "ocr": status.isin("processing", "uploaded"), "embedding": status == "processing"}
    out, before = [], F.lit(True)
    for name, waits, works, failed, said in STEPS:
        broke = before & (status == "failed") & F.lit(name != "upload")
        state = F.when(done[name], "completed").when(broke, "failed").when(before & busy[name], "active").otherwise("pending")
        tail = file_size(size) if name == "upload" else F.lit("")
        detail = F.when(state == "completed", F.concat(count, F.lit(said), tail)).when(state == "failed", F.coalesce(error, F.lit(failed))).when(state == "active", works).otherwise(waits)
        out.append(F.struct(F.lit(name).alias("step"), state.alias("state"), detail.alias("detail")))
        before = F.lit(True) if name == "upload" else done[name]
    return F.array(*out)


def without_pinned(groups: DataFrame, pinned, query: str = "", key: str = "id") -> DataFrame:
    """A list without the row that is shown above it; a search shows all."""
    return groups if query.strip() or pinned is None else groups.where(F.col(key) != F.lit(pinned))


def source_label(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def ring(events: DataFrame, order: str, n: int = RECENT_EVENTS) -> DataFrame:
    """The newest n events, newest first."""
    return events.orderBy(F.desc(order)).limit(n)


def shown_messages(stored: DataFrame, waiting: DataFrame, slack_ms: int = 5000) -> DataFrame:
    """(conv_id, role, content, created_ms, pending): stored messages, an assistant's as a client shows them, and those
    submitted (conv_id, role, content, submitted_ms) that aren't stored yet. A waiting answer stands 1 ms after its question."""
    said = F.when(F.col("role") == "assistant", shown_content(F.col("content"))).otherwise(F.col("content"))
    old = stored.select("conv_id", "role", said.alias("content"), "created_ms", F.lit(False).alias("pending"))
    at = F.col("submitted_ms") + (F.col("role") == "assistant").cast("int")
    new = pending(waiting, stored.withColumn("content", said), slack_ms).where(F.length("content") > 0)
    return old.unionByName(new.select("conv_id", "role", "content", at.alias("created_ms"), F.lit(True).alias("pending")))


def pending(shown: DataFrame, stored: DataFrame, slack_ms: int = 5000) -> DataFrame:
    """Messages (conv_id, role, content, submitted_ms) that aren't stored yet: no stored one with the same role and content is
    younger than the submission less the slack."""
    s = stored.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("content").alias("_t"), "created_ms")
    on = (F.col("conv_id") == F.col("_c")) & (F.col("role") == F.col("_r")) & (trim(F.col("content")) == trim(F.col("_t"))) & (F.col("created_ms") >= F.col("submitted_ms") - slack_ms)
    return shown.join(s, on, "left_anti")
