"""A read-through cache as a stream: reads that find an entry are answered from it, others fetch one and leave it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..constants import URL_CACHE_SECONDS
from .state import Timers, stateful, type_of


class ReadThrough(StatefulProcessor):
    def __init__(self, key: str, ts: str, ttl_us: int, fetch: Callable[[object], str | None], timed: bool) -> None:
        self.key, self.ts, self.ttl, self.fetch, self.timed = key, ts, ttl_us, fetch, timed

    def init(self, handle) -> None:
        self.entry = handle.getValueState("entry", "until long, value string")
        self.timers = Timers(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until, value = self.entry.get() if self.entry.exists() else (None, None)
        out = []
        for us in sorted(us for pdf in rows for us in pdf["us"].tolist()):
            hit = until is not None and us < until
            if not hit:
                until, value = us + self.ttl, self.fetch(key[0])
            out.append((key[0], us, hit, value))
        self.entry.update((until, value))
        if self.timed:
            self.timers.set("entry", -(-until // 1000))
        yield pd.DataFrame(out, columns=[self.key, "us", "hit", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.timers.fired(expiredTimerInfo.getExpiryTimeInMs()):
            self.entry.clear()
        yield pd.DataFrame([], columns=[self.key, "us", "hit", "value"])

    def close(self) -> None:
        pass


def read_through(reads: DataFrame, key: str, ts: str, fetch: Callable[[object], str | None], ttl: int = URL_CACHE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(key, ts, hit, value) of reads (key, ts), a stream or a table: a read within ttl seconds of the miss that made the entry is
    a hit and has its value; any other fetches a new one. Reads of a batch are taken in the order of ts. In a stream an
    entry's state goes when the watermark (``late`` behind the newest read) has passed its end."""
    spark = reads.sparkSession
    stateful(spark)
    kind, stamp = type_of(reads, key), type_of(reads, ts)
    timed = reads.isStreaming
    rows = reads.select(key, F.col(ts).cast("timestamp").alias(ts))
    if timed:
        rows = rows.withWatermark(ts, late)
    rows = rows.withColumn("us", F.unix_micros(F.col(ts)))
    processor = ReadThrough(key, ts, ttl * 1_000_000, fetch, timed)
    out = rows.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, us long, hit boolean, value string", "append", "EventTime" if timed else "None")
    return out.select(key, F.timestamp_micros("us").cast(stamp).alias(ts), "hit", "value")
