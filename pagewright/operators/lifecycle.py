"""Admission, errors, retries, the processing state machine, expiry and caches, in batch form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_ATTEMPTS, MAX_PAGES, RESERVATION_SECONDS, RETRY_SECONDS, TRANSIENT_CODES, TRANSIENT_ERRNO, TRANSIENT_HTTP, TRANSIENT_PHRASES, URL_CACHE_SECONDS, URL_SECONDS
from .fence import fence  # noqa: F401



def looks_like_pdf(filename: Column, mime: Column | None = None) -> Column:
    by_name = F.lower(filename).endswith(".pdf")
    return by_name if mime is None else F.coalesce(mime == "application/pdf", F.lit(False)) | by_name


def has_magic(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")


def encrypted(message: Column) -> Column:
    m = F.lower(message)
    return m.contains("password") | m.contains("encrypt")


def admission(size: Column, pages: Column) -> Column:
    """'ok', or why a file is rejected, in the order of the checks."""
    return F.when(size <= 0, "empty").when(pages <= 0, "no_pages").when(pages > MAX_PAGES, "too_many_pages").otherwise("ok")


def request_status(c: dict[str, Column]) -> Column:
    """(status, reason) of a chat request; conditions are checked in a fixed order."""
    ladder = [("authenticated", 401, "unauthorized"), ("parsed", 400, "bad_json"), ("complete", 400, "missing_fields"), ("owned", 404, "not_found"), ("ready", 400, "not_ready"), ("summarised", 400, "no_summary"), ("conversation", 404, "no_conversation"), ("chunked", 500, "no_chunks")]
    out = None
    for name, status, reason in ladder:
        s = F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
        out = F.when(~c[name], s) if out is None else out.when(~c[name], s)
    return out.otherwise(F.struct(F.lit(200).alias("status"), F.lit("ok").alias("reason")))


def transient(http: Column, code: Column, errno: Column, message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    said = F.lit(False)
    for p in TRANSIENT_PHRASES:
        said = said | m.contains(p)
    no = F.lit(False)
    return F.coalesce(http.isin(*TRANSIENT_HTTP), no) | F.coalesce(code.isin(*TRANSIENT_CODES), no) | F.coalesce(errno.isin(*TRANSIENT_ERRNO), no) | said


def retry(attempt: Column, failed_at: Column, is_transient: Column) -> Column:
    """(status, next_at): another attempt after 15 s, then 60 s, for transient errors, up to three attempts."""
    again = is_transient & (attempt < MAX_ATTEMPTS)
    wait = F.when(attempt <= 1, RETRY_SECONDS[0]).otherwise(RETRY_SECONDS[1])
    at = F.when(again, failed_at + F.make_dt_interval(secs=wait))
    return F.struct(F.when(again, "processing").otherwise("failed").alias("status"), at.alias("next_at"))


def _sorted_fold(rows: DataFrame, key: str, order: list, fold, schema: str) -> DataFrame:
    """fold(batches) over rows that come together by key, in order. A task holds one batch and one key's state, however long a
    key's log is."""
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema)


def expired(created_at: Column, now: Column, status: Column, seconds: int = RESERVATION_SECONDS) -> Column:
    return (status == "uploading") & (created_at + F.make_dt_interval(secs=F.lit(seconds)) <= now)


def cached_reads(reads: DataFrame, key: str, ts: str, ttl: int = URL_CACHE_SECONDS) -> DataFrame:
    """hit or miss of each read of a cache that keeps an entry for ttl seconds from the miss that made it: a fold over a
    key's reads in order, by jumps from one miss to the next."""

    def fold(batches):
        now, until = None, None
        for pdf in batches:
            keys, at = pdf["key"].to_numpy(), pdf["us"].to_numpy()
            hit = np.ones(len(pdf), bool)
            cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for i, j in zip(cut[:-1], cut[1:]):
                if i == j:
                    continue
                if now is None or keys[i] != now:
                    now, until = keys[i], None
                while True:
                    i = i if until is None else i + int(np.searchsorted(at[i:j], until))
                    if i >= j:
                        break
                    hit[i], until = False, at[i] + ttl * 1_000_000
                    i += 1
            yield pd.DataFrame({key: pdf["key"], "us": at, "hit": hit})

    kinds = dict(reads.dtypes)
    rows = reads.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    out = _sorted_fold(rows, "key", ["us"], fold, f"`{key}` {kinds[key]}, us long, hit boolean")
    return out.select(key, F.timestamp_micros("us").cast(kinds[ts]).alias(ts), "hit")


# Upload: what each event does to a reservation. (status, event) -> (status, what is to be done)
UPLOAD_STEPS = {
    ("new", "reserve"): ("uploading", "sign"),
    ("uploading", "accepted"): ("uploaded", "schedule"),
    ("uploading", "rejected"): ("removed", "delete"),
    ("uploading", "failed"): ("removed", "delete"),
    ("uploading", "expired"): ("removed", "delete"),
}


def upload_step(status: Column, event: Column) -> Column:
    """(status, action) after an event of an upload: a file that is rejected, fails or expires takes its object and row along;
    anything out of turn changes nothing."""
    out = F.struct(status.alias("status"), F.lit("none").alias("action"))
    for (old, what), (new, action) in UPLOAD_STEPS.items():
        out = F.when((status == old) & (event == what), F.struct(F.lit(new).alias("status"), F.lit(action).alias("action"))).otherwise(out)
    return out


def completed_upload(size: Column, pages: Column, magic: Column) -> Column:
    """The event that the end of an upload is."""
    return F.when((admission(size, pages) == "ok") & magic, "accepted").otherwise("rejected")


def signed_until(now: Column, seconds: int = URL_SECONDS) -> Column:
    return now + F.make_dt_interval(secs=F.lit(seconds))


def scheduled(uploaded: DataFrame, key: str, at: str) -> DataFrame:
    """Attempt 1 of each completed upload, at once."""
    return uploaded.select(key, F.lit(1).alias("attempt"), F.col(at).alias("run_at"))


def remove_expired(documents: DataFrame, created: str, now: Column) -> DataFrame:
    """documents without reservations that ran out."""
    return documents.where(~F.coalesce(expired(F.col(created), now, F.col("status")), F.lit(False)))
