"""What stateful streams share: the state store, and timers by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """Keyed state of several parts needs the store on disk; it is set for the queries that start from now on. Over a table, nothing
    else would start the coordinator that the stores report to: asking for the streams does."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.streams  # noqa: B018


def type_of(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


class Timers:
    """Timers of a key by what they are for. Setting one again moves it; no event takes another's away."""

    def __init__(self, handle) -> None:
        self.handle = handle
        self.due = handle.getMapState("timers", "name string", "at long")

    def set(self, name: str, at: int) -> None:
        due = self._due()
        self._drop(due, name)
        if at not in due.values():
            self.handle.registerTimer(at)
        self.due.updateValue((name,), (at,))

    def drop(self, name: str) -> None:
        self._drop(self._due(), name)

    def fired(self, at: int) -> list[str]:
        """The names that a timer at this time was set for, in the order of their times; they are taken away."""
        names = sorted((due, name) for (name,), (due,) in self.due.iterator() if due <= at)
        for _, name in names:
            self.due.removeKey((name,))
        return [name for _, name in names]

    def _due(self) -> dict[str, int]:
        """All at once: each question to the store is a way to another process."""
        return {name: at for (name,), (at,) in self.due.iterator()}

    def _drop(self, due: dict[str, int], name: str) -> None:
        at = due.pop(name, None)
        if at is not None:
            self.due.removeKey((name,))
            if at not in due.values():
                self.handle.deleteTimer(at)
