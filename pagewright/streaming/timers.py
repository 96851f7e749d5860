"""State with timers: attempt fences, retries and reservations as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..constants import MAX_ATTEMPTS, RESERVATION_SECONDS, RETRY_SECONDS
from .state import Timers, stateful, type_of

SETTLED_SECONDS = 7 * 24 * 60 * 60


class Supervisor(StatefulProcessor):
    """One document's upload and attempts. Its timers are the end of the reservation, the next attempt, and the end of what is
    remembered of a settled document; each stays until it fires or its reason is gone."""

    def __init__(self, reservation: float, retries: tuple[float, ...], settled: float) -> None:
        self.reservation, self.retries, self.settled = reservation, retries, settled

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "status string, attempt int")
        self.timers = Timers(handle)

    def _out(self, key, rows: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["id", "action", "attempt"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        status, attempt = self.state.get() if self.state.exists() else ("new", 0)
        out = []
        for r in sorted((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: r.seq):
            if r.kind == "reserve" and status == "new":
                status = "uploading"
                self.timers.set("reservation", now + int(self.reservation * 1000))
            elif r.kind == "begin" and status not in ("ready", "expired") and attempt < r.attempt:
                status, attempt = "processing", int(r.attempt)
                out.append(("begin", attempt))
            elif status == "processing" and r.kind in ("ready", "failed") and r.attempt == attempt:
                if r.kind == "ready":
                    status = "ready"
                elif r.transient and attempt < MAX_ATTEMPTS:
                    status = "waiting"
                    self.timers.set("retry", now + int(self.retries[min(attempt, len(self.retries)) - 1] * 1000))
                else:
                    status = "failed"
                out.append(("retry" if status == "waiting" else status, attempt))
        if status != "uploading":
            self.timers.drop("reservation")
        if status != "waiting":
            self.timers.drop("retry")
        if status in ("ready", "failed", "expired"):
            self.timers.set("settled", now + int(self.settled * 1000))
        else:
            self.timers.drop("settled")
        self.state.update((status, attempt))
        yield self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        out = []
        for name in self.timers.fired(expiredTimerInfo.getExpiryTimeInMs()):
            status, attempt = self.state.get() if self.state.exists() else ("new", 0)
            if name == "reservation" and status == "uploading":
                self.state.update(("expired", attempt))
                self.timers.set("settled", now + int(self.settled * 1000))
                out.append(("expired", attempt))
            elif name == "retry" and status == "waiting":
                self.state.update(("processing", attempt + 1))
                out.append(("begin", attempt + 1))
            elif name == "settled":
                self.state.clear()
        yield self._out(key, out)

    def close(self) -> None:
        pass


def supervised(events: DataFrame, reservation: float = RESERVATION_SECONDS, retries: tuple[float, ...] = RETRY_SECONDS, settled: float = SETTLED_SECONDS) -> DataFrame:
    """A stream of (id, seq, kind, attempt, transient) to actions (id, action, attempt): begin, ready, retry after a delay, failed,
    expired.

    An upload that isn't completed expires after the reservation; a transient failure starts the next attempt after the
    delays of ``retries`` (seconds of processing time). Timers hold whatever events come meanwhile, and over a restart from a
    checkpoint. Events of an attempt that isn't the stored one are ignored. A document that is ready, failed or expired is
    remembered for ``settled`` seconds, so that late events find it settled; then its state goes.
    """
    stateful(events.sparkSession)
    schema = f"id {type_of(events, 'id')}, action string, attempt int"
    return events.groupBy("id").transformWithStateInPandas(Supervisor(reservation, retries, settled), schema, "append", "ProcessingTime")
