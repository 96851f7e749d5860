"""The attempt fence by composition: what a stretch of a document's log does to any state it may begin with.

A state is (status, stored attempt). An event begin(n) counts only if n is above the stored attempt and the status isn't ready;
ready(n), failed(n) and retry(n) count only if n is the stored attempt. A stretch that names the attempts c1 < c2 < ... can tell
attempts apart only by these: by the c's themselves and by the gaps between them. Its effect is so a table over (status, place),
place 2j + 1 for the j-th c and 2j for the gap before it; it gives the status, the place and how many events counted. Tables of
neighbouring stretches compose into that of both, which is associative, so a log is reduced in pieces, wherever it is cut.

Logs are sorted by (document, order) in ranges, which cut a long log into as many tasks as it takes. In a task, the events of a
batch are composed pairwise, level by level, all documents at once; a document's pieces of several batches into one. What is
left is one row for each document and task, and more than one only for documents that a range boundary cuts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("uploaded", "processing", "ready", "failed")
PROCESSING, READY = 1, 2
KINDS = {"begin": 0, "ready": 1, "failed": 2, "retry": 3}
_OUTCOME = np.array([PROCESSING, READY, 3, PROCESSING])  # the status after an event of each kind
NOTHING = 4  # any other event
CELLS = 1 << 22  # of all tables at once


class Effect(NamedTuple):
    """cuts (m attempts, ascending); to and counted over 4 * (2m + 1) states."""

    cuts: np.ndarray
    to: np.ndarray
    counted: np.ndarray


def apply(effect: Effect, status: int, attempt: int) -> tuple[int, int, int]:
    """(status, attempt, events that counted) from a state."""
    wide = 2 * len(effect.cuts) + 1
    at = int(np.searchsorted(effect.cuts, attempt))
    place = 2 * at + (at < len(effect.cuts) and effect.cuts[at] == attempt)
    state = status * wide + place
    status, place = divmod(int(effect.to[state]), wide)
    return status, int(effect.cuts[place // 2]) if place % 2 else attempt, int(effect.counted[state])


def _place(cuts: np.ndarray, all_cuts: np.ndarray) -> np.ndarray:
    """For each place among all_cuts, the place among cuts (a part of them) that it lies in."""
    m = len(all_cuts)
    at = np.searchsorted(cuts, all_cuts)
    hit = np.isin(all_cuts, cuts)
    out = np.empty(2 * m + 1, np.int64)
    out[1::2] = 2 * at + hit
    out[0 : 2 * m : 2] = 2 * at
    out[2 * m] = 2 * len(cuts)
    return out


def compose(f: Effect, g: Effect) -> Effect:
    """What f and then g do."""
    cuts = np.union1d(f.cuts, g.cuts)
    wide = 2 * len(cuts) + 1
    status, place = np.divmod(np.arange(4 * wide), wide)
    counted = np.zeros(4 * wide, np.int64)
    for e in (f, g):
        own = 2 * len(e.cuts) + 1
        at = status * own + _place(e.cuts, cuts)[place]
        counted += e.counted[at]
        status, to = np.divmod(e.to[at], own)
        moved = to % 2 == 1  # onto one of its cuts; else the attempt stays what it was
        place = np.where(moved, 2 * np.searchsorted(cuts, e.cuts[np.minimum(to // 2, len(e.cuts) - 1)]) + 1, place) if len(e.cuts) else place
    return Effect(cuts, status * wide + place, counted)


def _tables(kind: np.ndarray, rank: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """(to, counted) of single events, one row each: kind, and which of the cuts the event names."""
    status, place = np.divmod(np.arange(4 * wide), wide)
    own = (2 * rank + 1)[:, None]
    counts = np.where((kind == 0)[:, None], (status != READY) & (place < own), (place == own)) & (kind != NOTHING)[:, None]
    to = np.where(counts, _OUTCOME[np.minimum(kind, 3)][:, None] * wide + own, np.arange(4 * wide))
    return to, counts.astype(np.int64)


def _reduced(to: np.ndarray, counted: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One table for each run of ``size`` rows: neighbours are composed until one is left of each."""
    while size.max() > 1:
        half = (size + 1) // 2
        run = np.repeat(np.arange(len(size)), half)
        first = np.cumsum(size) - size
        j = np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half)
        left = first[run] + 2 * j
        pair = 2 * j + 1 < size[run]
        after, total = to[left], counted[left]
        a, b = left[pair], left[pair] + 1
        total[pair] += np.take_along_axis(counted[b], to[a], 1)
        after[pair] = np.take_along_axis(to[b], to[a], 1)
        to, counted, size = after, total, half
    return to, counted


def effects(kind: np.ndarray, attempt: np.ndarray, size: np.ndarray) -> list[Effect]:
    """The effect of each run of ``size`` events. Runs are worked on together if they name about as many attempts."""
    run = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((attempt, run))
    new = np.r_[True, (run[order][1:] != run[order][:-1]) | (attempt[order][1:] != attempt[order][:-1])]
    cuts, cut_run = attempt[order][new], run[order][new]
    m = np.bincount(cut_run, minlength=len(size))
    begin = np.cumsum(m) - m
    rank = np.empty(len(run), np.int64)
    rank[order] = np.cumsum(new) - 1
    rank -= begin[run]
    out: list[Effect | None] = [None] * len(size)
    most = 1 << np.ceil(np.log2(np.maximum(m, 1))).astype(int)
    for width in np.unique(most).tolist():
        wide = 2 * width + 1
        some = np.flatnonzero(most == width)
        upto = np.cumsum(size[some])
        a = 0
        while a < len(some):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + max(1, CELLS // (4 * wide)), "right")))
            runs = some[a:b]
            rows = np.flatnonzero(np.isin(run, runs))
            to, counted = _tables(kind[rows], rank[rows], wide)
            to, counted = _reduced(to, counted, size[runs])
            for r, t, c in zip(runs.tolist(), to, counted):
                own = 2 * int(m[r]) + 1
                keep = (np.arange(4)[:, None] * wide + np.arange(own)).ravel()
                status, place = np.divmod(t[keep], wide)
                out[r] = Effect(cuts[begin[r] : begin[r] + m[r]], status * own + place, c[keep])
            a = b
    return out


def _rows(part: int, keys: pa.Array, found: list[Effect]) -> pa.RecordBatch:
    first = [apply(e, 0, 0) for e in found]
    lists = [pa.array([x.tolist() for x in column], pa.list_(pa.int64())) for column in zip(*found)]
    ends = [pa.array(column, t) for column, t in zip(zip(*first), (pa.int32(), pa.int64(), pa.int64()))]
    names = ["key", "part", "cuts", "to", "counted", "status", "attempt", "applied"]
    return pa.RecordBatch.from_arrays([keys, pa.array([part] * len(keys), pa.int32()), *lists, *ends], names=names)


def _pieces(batches):
    """Rows (part, key, kind, attempt) in order to one row for each key: its effect in this task, and what it makes of the first
    state."""
    last = None  # the key that a batch ended with, and its effect so far
    part = 0
    for b in batches:
        if not len(b):
            continue
        part = b.column("part")[0].as_py()
        runs = pc.run_end_encode(b.column("key"))
        size = np.diff(np.r_[0, runs.run_ends.to_numpy()])
        keys, found = runs.values, effects(b.column("kind").to_numpy().astype(np.int64), b.column("attempt").to_numpy(), size)
        if last and last[0].equals(keys.slice(0, 1)):
            found[0] = compose(last[1], found[0])
        elif last:
            yield _rows(part, last[0], [last[1]])
        if len(found) > 1:
            yield _rows(part, keys.slice(0, len(keys) - 1), found[:-1])
        last = keys.slice(len(keys) - 1), found[-1]
    if last:
        yield _rows(part, last[0], [last[1]])


def fence(events: DataFrame, key: str, order: str, kind: str, attempt: str) -> DataFrame:
    """State after all events of a document (begin, ready, failed, retry; in order), and how many of them counted: (key, status,
    attempt, applied). A begin counts only with a higher attempt and unless ready, the others only with the stored attempt;
    events of other kinds or without an attempt never. The first state is (uploaded, 0)."""
    code = F.lit(NOTHING)
    for name, n in KINDS.items():
        code = F.when((F.col(kind) == name) & F.col(attempt).isNotNull(), F.lit(n)).otherwise(code)
    rows = events.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(kind).alias("name"), code.alias("kind"), F.coalesce(F.col(attempt).cast("long"), F.lit(0)).alias("attempt"))
    by = ["key", "order", "name", "attempt"]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("part"), "key", "kind", "attempt")
    kinds = dict(events.dtypes)[key]
    schema = f"key {kinds}, part int, cuts array<long>, to array<long>, counted array<long>, status int, attempt long, applied long"
    pieces = F.struct("part", "cuts", "to", "counted")
    each = rows.mapInArrow(_pieces, schema).groupBy("key").agg(F.collect_list(pieces).alias("pieces"), F.first("status").alias("status"), F.first("attempt").alias("attempt"), F.first("applied").alias("applied"))
    one, cut = each.where(F.size("pieces") == 1), each.where(F.size("pieces") > 1)

    def fold(batches):
        for pdf in batches:
            out = []
            for k, pieces in zip(pdf["key"], pdf["pieces"]):
                status, n, applied = 0, 0, 0
                for p in sorted(pieces, key=lambda p: p["part"]):
                    status, n, more = apply(Effect(*(np.asarray(p[c]) for c in ("cuts", "to", "counted"))), status, n)
                    applied += more
                out.append((k, status, n, applied))
            yield pd.DataFrame(out, columns=["key", "status", "attempt", "applied"])

    whole = cut.select("key", "pieces").mapInPandas(fold, f"key {kinds}, status int, attempt long, applied long")
    names = F.get(F.array(*(F.lit(s) for s in STATUSES)), F.col("status"))
    return one.select(*whole.columns).unionByName(whole).select(F.col("key").alias(key), names.alias("status"), "attempt", "applied")
