"""Indexes in segments: what an index learns at once is one, and what was learnt before about the same ids is marked as gone."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import Files, Log


class Segmented:
    """A log whose versions list segments: {path, rows, gone: [tables of ids], ...}. Each segment has a table ``members`` with
    the id of every row; an id lives in one segment at most."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.files = Files(spark, path)
        self.log = Log(self.files)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.files.full(name))

    def _segments(self) -> list[dict]:
        return self.log.latest()[1].get("segments", [])

    def _gone(self, segment: dict) -> DataFrame | None:
        return self.spark.read.parquet(*(self.files.full(g) for g in segment["gone"])) if segment["gone"] else None

    def _live(self, rows: DataFrame, segment: dict) -> DataFrame:
        """Rows (id, ...) of a segment without those that are gone."""
        gone = self._gone(segment)
        return rows if gone is None else rows.join(gone.select("id"), "id", "left_anti")

    def _marked(self, segment: dict, ids: DataFrame) -> dict:
        """The segment with ids (id) gone."""
        members = self._table(f"{segment['path']}/members")
        hit = self._live(members.join(ids, "id", "left_semi"), segment)
        name = f"gone/{uuid.uuid4().hex}"
        hit.write.parquet(self.files.full(name))
        lost = self._counted(self._table(name))
        if not lost["rows"]:
            self.files.delete(name)
            return segment
        return segment | {"gone": [*segment["gone"], name]} | {k: segment[k] - n for k, n in lost.items()}

    def _counted(self, members: DataFrame) -> dict:
        """What a segment's entry in the log says about these rows, as numbers that can be taken away again."""
        return {"rows": members.count()}

    def _commit(self, ids: DataFrame, segment: dict | None, **facts) -> int:
        """The next version: earlier segments lose ids, and the new one is added. If another writer was first, earlier segments
        are marked again, as they are then; the new one stays as it was written."""
        while True:
            version, body = self.log.latest()
            segments = [self._marked(s, ids) for s in body.get("segments", [])]
            segments = [s for s in segments if s["rows"]] + ([segment] if segment else [])
            if self.log.put(version + 1, body | facts | {"segments": segments}):
                return version + 1

    def delete(self, ids: DataFrame) -> int:
        """Forget ids (id)."""
        return self._commit(ids.select("id").distinct(), None)

    def vacuum(self, keep: int = 2, grace: float = 24 * 3600) -> int:
        """Forget all versions but the last ``keep``, and delete what none of these names and is older than grace seconds."""
        named = set()
        for body in self.log.forget(keep):
            named |= {body.get("centroids")} | {p for s in body["segments"] for p in (s["path"], *s["gone"])}
        gone = 0
        for folder in ("segments", "gone", "centroids"):
            for name, changed in self.files.names(folder):
                if f"{folder}/{name}" not in named and time.time() - changed >= grace:
                    self.files.delete(f"{folder}/{name}")
                    gone += 1
        return gone

    def ids(self) -> DataFrame | None:
        """All ids that are in the index; None if it is empty."""
        out = None
        for s in self._segments():
            some = self._live(self._table(f"{s['path']}/members"), s).select("id")
            out = some if out is None else out.union(some)
        return out
