"""Tables of documents' rows that are changed by atomic commits.

A version of a table is a list of buckets, each a folder of Parquet files that never change. A bucket holds the rows whose key's
hash ends in its bits; together the buckets cover all hashes. A commit writes new folders for the buckets it touches and puts
the next version of the list: readers see all of a commit or nothing of it, and what they have opened stays as it is.

Two writers work on the version that each began with. The second to put its version takes the other's list if the buckets it
touched are still the same there; if not, its work is done again from the new version. Buckets of more than bucket_rows rows
are split by further bits of the hash, so a commit rewrites about as much of a large table as of a small one. Rows of one
key stay in one bucket, in as many files as Spark's rebalancing makes of it.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import store
from .log import Files, Log, release

BROADCAST = 1 << 16  # buckets
SPLIT_BITS = 12  # by which a bucket is split at once, at most


class Conflict(Exception):
    """Other writers changed the same buckets, again and again."""


class Bucket(NamedTuple):
    bits: int
    value: int
    path: str | None = None  # none: no rows
    rows: int = 0


class Snapshot(NamedTuple):
    version: int
    schema: StructType | None
    buckets: list[Bucket]
    applied: dict[str, int]


def _end(h: Column, bits: int) -> Column:
    return h.bitwiseAND(F.lit((1 << bits) - 1))


class Table:
    def __init__(self, spark: SparkSession, path: str, key: str = "document_id", bucket_rows: int = 1 << 20) -> None:
        self.spark, self.key, self.bucket_rows = spark, key, bucket_rows
        self.files = Files(spark, path)
        self.log = Log(self.files)

    # reading

    def snapshot(self, version: int | None = None) -> Snapshot:
        at, body = self.log.latest() if version is None else (version, self.log.get(version))
        if at < 0:
            return Snapshot(-1, None, [Bucket(0, 0)], {})
        return Snapshot(at, StructType.fromJson(body["schema"]), [Bucket(*b) for b in body["buckets"]], body["applied"])

    def read(self, version: int | None = None, keys: list | None = None) -> DataFrame:
        """The table's rows at a version, by default the last. With keys, only their buckets are opened."""
        now = self.snapshot(version)
        if now.schema is None:
            raise FileNotFoundError(f"no table at {self.files.path}")
        if keys is None:
            return self._rows(now, now.buckets)
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType([now.schema[self.key]]))
        return self._rows(now, self._touched(now, wanted)).where(F.col(self.key).isin(keys))

    def _rows(self, now: Snapshot, buckets: list[Bucket]) -> DataFrame:
        paths = [self.files.full(b.path) for b in buckets if b.path]
        return self.spark.read.schema(now.schema).parquet(*paths) if paths else self.spark.createDataFrame([], now.schema)

    # placing keys

    def _placed(self, df: DataFrame, buckets: list[Bucket]) -> DataFrame:
        """df with _b, the place of its row's bucket in the list; null where the bucket isn't one of them. One join for each
        length of a hash's end that buckets have, which are few."""
        df = df.withColumn("_h", F.xxhash64(self.key))
        at = F.lit(None).cast("int")
        for bits in sorted({b.bits for b in buckets}):
            ends = [(b.value, i) for i, b in enumerate(buckets) if b.bits == bits]
            if bits == 0:
                return df.withColumn("_b", F.lit(ends[0][1])).drop("_h")
            some = self.spark.createDataFrame(ends, f"_e{bits} long, _i{bits} int")
            df = df.join(F.broadcast(some) if len(ends) <= BROADCAST else some, _end(F.col("_h"), bits) == F.col(f"_e{bits}"), "left").drop(f"_e{bits}")
            at = F.coalesce(at, F.col(f"_i{bits}"))
        return df.withColumn("_b", at).drop("_h", *(c for c in df.columns if c.startswith("_i") and c[2:].isdigit()))

    def _touched(self, now: Snapshot, keys: DataFrame) -> list[Bucket]:
        placed = self._placed(keys.select(self.key), now.buckets)
        return [now.buckets[r["_b"]] for r in placed.select("_b").distinct().collect()]  # buckets at most

    # writing

    def update(self, keys: DataFrame, change: Callable[[DataFrame | None], DataFrame], attempts: int = 5, before_commit: Callable[[], None] | None = None, applied: tuple[str, int] | None = None) -> int:
        """Commit change(rows of the buckets that keys fall into) in their place; None stands for a table that isn't there yet.
        change may be called again, on a later version. Its rows must fall into those buckets. applied (name, n) is remembered
        with the commit, and a commit whose n isn't beyond the remembered one does nothing: a batch that is replayed is
        written once. Gives the version."""
        for _ in range(attempts):
            base = self.snapshot()
            if applied and base.applied.get(applied[0], -1) >= applied[1]:
                return base.version
            touched = self._touched(base, keys)
            if not touched:
                return base.version
            new = change(None if base.schema is None else self._rows(base, touched))
            schema = self._schema(base.schema, new.schema)
            made = self._written(new, touched if base.schema else self._ahead(new))
            if before_commit:
                before_commit()
            version = self._commit(base, touched, made, schema, applied)
            if version is not None:
                return version
        raise Conflict(f"{attempts} attempts at {self.files.path}")

    @staticmethod
    def _schema(old: StructType | None, new: StructType) -> StructType:
        """Columns of both, all of which may be null."""
        out = {f.name: f for f in (old.fields if old else [])}
        for f in StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.fields)).fields:
            if f.name in out and out[f.name].dataType != f.dataType:
                raise TypeError(f"column {f.name} was {out[f.name].dataType.simpleString()} and would be {f.dataType.simpleString()}")
            out.setdefault(f.name, f)
        return StructType(list(out.values()))

    def _ahead(self, new: DataFrame) -> list[Bucket]:
        """The buckets of a new table: its keys are counted first, so that rows aren't written as one bucket, read and split."""
        h = F.xxhash64(self.key)
        r = new.agg(F.count(F.lit(1)).alias("n"), F.min(h).alias("a"), F.max(h).alias("z")).first()
        if r.n <= self.bucket_rows or r.a == r.z:
            return [Bucket(0, 0)]
        release(self.spark)  # what was dealt to count is dealt again to write
        bits = min(SPLIT_BITS, math.ceil(math.log2(1.25 * r.n / self.bucket_rows)))  # no two are equally full
        return [Bucket(bits, k) for k in range(1 << bits)]

    def _written(self, new: DataFrame, touched: list[Bucket]) -> list[Bucket]:
        placed = self._placed(new, touched)
        out_of_place = F.raise_error(F.lit("a row's key isn't one of those to be changed")).cast("int")
        placed = placed.withColumn("_b", F.coalesce("_b", out_of_place))
        rows, folder = self._put(placed)
        made, large = [], {}
        for i, b in enumerate(touched):
            n, apart = rows.get(i, (0, False))
            if n > self.bucket_rows and apart:
                large.setdefault((b.bits, min(SPLIT_BITS, math.ceil(math.log2(n / self.bucket_rows)))), []).append((i, b))
            else:
                made.append(Bucket(b.bits, b.value, f"{folder}/_b={i}" if n else None, n))
        for (bits, more), those in large.items():
            whole = self.spark.read.schema(new.schema).parquet(*(self.files.full(f"{folder}/_b={i}") for i, _ in those))
            after = bits + more
            parts = [Bucket(after, b.value | k << bits) for _, b in those for k in range(1 << more)]
            again = _end(F.xxhash64(self.key), after)
            rows, to = self._put(whole.withColumn("_b", again))
            made += [p if p.value not in rows else Bucket(after, p.value, f"{to}/_b={p.value}", rows[p.value][0]) for p in parts]
        return made

    def _put(self, placed: DataFrame) -> tuple[dict[int, tuple[int, bool]], str]:
        """Write rows by _b; (rows, whether they have more than one key) for each, and the folder."""
        folder = f"data/{uuid.uuid4().hex}"
        to = self.files.full(folder)
        placed.hint("rebalance", "_b").write.partitionBy("_b").option("compression", "zstd").parquet(to)
        plain = placed.schema
        back = self.spark.read.schema(plain).parquet(to)
        h = F.xxhash64(self.key)
        each = back.groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.min(h).alias("a"), F.max(h).alias("z"))
        return {r["_b"]: (r.n, r.a != r.z) for r in each.collect()}, folder  # buckets at most

    def _commit(self, base: Snapshot, touched: list[Bucket], made: list[Bucket], schema: StructType, applied) -> int | None:
        gone, now = set(touched), base
        while True:
            remembered = dict(now.applied)
            if applied:
                if remembered.get(applied[0], -1) >= applied[1]:
                    return now.version
                remembered[applied[0]] = applied[1]
            buckets = [b for b in now.buckets if b not in gone] + made
            body = {"schema": schema.jsonValue(), "buckets": [list(b) for b in buckets], "applied": remembered, "at": time.time()}
            if self.log.put(now.version + 1, body):
                return now.version + 1
            now = self.snapshot()
            if not gone <= set(now.buckets) or now.schema != base.schema:
                return None

    def publish(self, rows: DataFrame, documents: DataFrame | None = None, **more) -> int:
        """Replace the content of documents (key), by default those in rows; a document without rows loses its old ones."""
        ids = (rows if documents is None else documents).select(self.key).distinct()
        new = lambda old: rows if old is None else store.cleared(old, ids, self.key).unionByName(rows, allowMissingColumns=True)
        return self.update(ids, new, **more)

    def insert(self, rows: DataFrame, **more) -> int:
        return self.update(rows.select(self.key), lambda old: rows if old is None else old.unionByName(rows, allowMissingColumns=True), **more)

    def _there(self, old: DataFrame | None) -> DataFrame:
        if old is None:
            raise FileNotFoundError(f"no table at {self.files.path}")
        return old

    def patch(self, changes: DataFrame, unset: str | None = None, **more) -> int:
        return self.update(changes.select(self.key), lambda old: store.patched(self._there(old), changes, self.key, unset), **more)

    def replace(self, rows: DataFrame, drop: tuple[str, ...] = ("error",), **more) -> int:
        return self.update(rows.select(self.key), lambda old: store.replaced(self._there(old), rows, self.key, drop), **more)

    def delete(self, keys: DataFrame, guard: Column | None = None, **more) -> int:
        return self.update(keys.select(self.key), lambda old: store.deleted(self._there(old), keys.select(self.key).distinct(), self.key, guard), **more)

    def vacuum(self, keep: int = 2, grace: float = 24 * 3600) -> int:
        """Forget all versions but the last ``keep``, and delete folders that none of these names and that are older than grace
        seconds, so that no writer's or reader's work is taken away. Gives how many were deleted."""
        named = {b[2] for body in self.log.forget(keep) for b in body["buckets"] if b[2]}
        gone = 0
        for folder, _ in self.files.names("data"):
            for part, changed in self.files.names(f"data/{folder}"):
                if f"data/{folder}/{part}" not in named and time.time() - changed >= grace:
                    self.files.delete(f"data/{folder}/{part}")
                    gone += part.startswith("_b=")
            if not self.files.names(f"data/{folder}"):
                self.files.delete(f"data/{folder}")
        return gone
