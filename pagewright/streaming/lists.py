"""Live lists: the newest rows of each owner, told as what was added, changed and removed."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..constants import LIST_DOCUMENTS
from .state import stateful, type_of

_OUT = ["owner", "n", "change", "id", "at", "payload"]


class Newest(StatefulProcessor):
    """All rows of an owner by id, and the ids that are shown. A batch looks at the rows it brings and at those that are shown;
    only if one of these went or moved back, the others are gone through for what takes its place."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle) -> None:
        self.rows = handle.getMapState("rows", "id long", "at long, payload string")
        self.shown = handle.getMapState("shown", "id long", "at long, payload string")
        self.told = handle.getValueState("told", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = {i: tuple(v) for (i,), v in self.shown.iterator()}
        last = {r.id: r for r in sorted((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: r.seq)}
        least = min(((v[0], i) for i, v in old.items()), default=None)
        near, refill = dict(old), False
        for i, r in last.items():
            was = near.pop(i, None)
            if r.deleted:
                if self.rows.containsKey((i,)):
                    self.rows.removeKey((i,))
                refill |= was is not None
            else:
                now = (int(r.at), r.payload)
                self.rows.updateValue((i,), now)
                near[i] = now
                refill |= was is not None and now[0] < was[0]
        if refill and len(old) == self.limit:  # rows that weren't shown may be next
            near |= {i: tuple(v) for (i,), v in self.rows.iterator() if least is None or (v[0], i) < least or i in near}
        new = {i: near[i] for i in heapq.nlargest(self.limit, near, key=lambda i: (near[i][0], i))}
        told = self.told.get()[0] if self.told.exists() else 0
        out = []
        for i in old.keys() - new.keys():
            out.append(("removed", i, *old[i]))
            self.shown.removeKey((i,))
        for i, v in new.items():
            if old.get(i) != v:
                out.append(("changed" if i in old else "added", i, *v))
                self.shown.updateValue((i,), v)
        self.told.update((told + len(out),))
        yield pd.DataFrame([(key[0], told + n, *r) for n, r in enumerate(out)], columns=_OUT)

    def close(self) -> None:
        pass


def live_lists(changes: DataFrame, limit: int = LIST_DOCUMENTS) -> DataFrame:
    """(owner, n, change, id, at, payload): what becomes of each owner's list of the ``limit`` newest rows, latest first, ties to the
    larger id, while changes (owner, seq, id, at, payload, deleted) come in, a stream or a table. A change is the row's new state or its
    end; of several changes of a row in one batch the last by seq counts, and a batch tells the difference between the list before
    and after it. n numbers an owner's rows; replaying them in that order gives the list after every batch."""
    stateful(changes.sparkSession)
    rows = changes.select("owner", "seq", F.col("id").cast("long").alias("id"), F.col("at").cast("long").alias("at"), "payload", F.coalesce("deleted", F.lit(False)).alias("deleted"))
    schema = f"owner {type_of(changes, 'owner')}, n long, change string, id long, at long, payload string"
    return rows.groupBy("owner").transformWithStateInPandas(Newest(limit), schema, "append", "None")


def replayed(told: DataFrame, upto: Column | None = None) -> DataFrame:
    """(owner, id, at, payload): the lists that these change rows come to."""
    rows = told if upto is None else told.where(upto)
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy("owner", "id").orderBy(F.desc("n")))).where("_n = 1")
    return last.where("change <> 'removed'").select("owner", "id", "at", "payload")
