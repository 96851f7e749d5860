"""A stored vector index: cosine top-k over lists of vectors that lie near the same centroid.

Centroids are fitted on the driver on at most SAMPLE vectors, those with the smallest hash of their id; every vector is then put
into the list of its nearest centroid, its home, and a copy into that of the second nearest, so all rows are in the index and only
the centroids depend on the sample. Lists are partitions of the stored table, sorted by the filter column inside, so a query's
lists are found by partition pruning and its filter is pushed to their scan. What is found there is scored exactly; a copy is
left out where its home is looked into as well.

A search looks into the lists whose centroids are nearest to the query: ``probes`` of them, by default a share that finds 95% of the
best twelve among vectors without any clusters (64 components, 2,000 vectors), and twice as many as long as fewer than k rows were
found. With exact=True it then looks into the homes that may hold a better one: by the triangle inequality of angles, no
member of a list is nearer to the query than its centroid's angle less the list's radius.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import VECTOR_LIMIT
from ..operators.retrieval import vector_top_k
from .segments import Segmented

SAMPLE = 65_536
LISTS = 4096  # at most
ROUNDS = 10
PROBES = 0.35  # share of the lists that a search looks into, unless it is told how many
SLACK = 1e-8  # cosines are rounded to nine digits
ZERO = -1  # the list of vectors without a direction


def fitted(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of length 1 of vectors of length 1, begun at evenly spaced rows; an empty list keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1), size[:, 0] > 0


class VectorIndex(Segmented):
    """Vectors (id, embedding and, if the index has one, its key column), all of one width; rows of another width and rows with null
    or non-finite components aren't indexed."""

    def __init__(self, spark: SparkSession, path: str, width: int, key: str | None = None) -> None:
        super().__init__(spark, path)
        self.width, self.key = width, key

    def _usable(self, vectors: DataFrame) -> DataFrame:
        fine = (F.size("embedding") == self.width) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return vectors.where(F.coalesce(fine, F.lit(False))).select("id", "embedding", (F.col(self.key) if self.key else F.lit(0)).alias("key"))

    def centroids(self) -> np.ndarray | None:
        name = self.log.latest()[1].get("centroids")
        if name is None:
            return None
        rows = self._table(name).orderBy("list").collect()  # LISTS rows
        return np.array([r.centroid for r in rows], float)

    def _fit(self, usable: DataFrame, lists: int | None) -> np.ndarray:
        n = usable.count()
        some = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toPandas()
        x, ok = _unit(np.array(some["embedding"].tolist(), float).reshape(len(some), self.width))
        x = x[ok]
        if not len(x):
            return np.eye(1, self.width)
        return fitted(x, min(len(x), lists or min(LISTS, max(1, 2 * math.isqrt(n)))))

    def _listed(self, usable: DataFrame, centroids: np.ndarray) -> DataFrame:
        """A row for the home of each vector, with the angle to its centroid, and one for its copy: list, home, copy, angle."""
        held = self.spark.sparkContext.broadcast(centroids)

        @F.pandas_udf("array<struct<list:int,home:int,copy:boolean,angle:double>>")
        def near(v: pd.Series) -> pd.Series:
            c = held.value
            x, ok = _unit(np.array(v.tolist(), float).reshape(len(v), c.shape[1]))
            dot = x @ c.T
            home = dot.argmax(1)
            angle = np.arccos(np.clip(dot[np.arange(len(x)), home], -1, 1))
            dot[np.arange(len(x)), home] = -2
            other = dot.argmax(1)
            one = lambda i: [(home[i], home[i], False, angle[i])] + ([(other[i], home[i], True, 0.0)] if len(c) > 1 else [])
            return pd.Series([one(i) if ok[i] else [(ZERO, ZERO, False, 0.0)] for i in range(len(x))])

        return usable.withColumn("near", near("embedding")).select("id", "key", "embedding", F.inline("near"))

    def add(self, vectors: DataFrame, lists: int | None = None) -> int:
        """Index vectors; those whose id is there already take the place of the old ones. Ids are distinct. The first call
        fits the centroids."""
        usable = self._usable(vectors)
        centroids, facts = self.centroids(), {}
        if centroids is None:
            centroids = self._fit(usable, lists)
            facts["centroids"] = f"centroids/{uuid.uuid4().hex}"
            self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(self.files.full(facts["centroids"]))
        segment = f"segments/{uuid.uuid4().hex}"
        to = self.files.full(f"{segment}/vectors")
        self._listed(usable, centroids).hint("rebalance", "list").sortWithinPartitions("list", "key").write.partitionBy("list").parquet(to)
        if not any(n.startswith("list=") for n, _ in self.files.names(f"{segment}/vectors")):  # nothing to be indexed
            self.files.delete(segment)
            return self._commit(vectors.select("id"), None)
        stored = self._table(f"{segment}/vectors")
        homes = stored.where("not copy")
        homes.select("id").write.parquet(self.files.full(f"{segment}/members"))
        radius = {str(r["list"]): r.a for r in homes.groupBy("list").agg(F.max("angle").alias("a")).collect()}  # LISTS rows
        new = {"path": segment, "gone": [], "radius": radius} | self._counted(self._table(f"{segment}/members"))
        return self._commit(vectors.select("id"), new, **facts)

    def probed(self, lists: list[int], key=None, segments: list[dict] | None = None, copies: bool = True) -> DataFrame:
        """The vectors of some lists that are there, each once; only these partitions are read, and the key reaches their scan."""
        out = None
        for s in self._segments() if segments is None else segments:
            rows = self._table(f"{s['path']}/vectors").where(F.col("list").isin(lists))
            rows = rows.where(~F.col("copy") | ~F.col("home").isin(lists)) if copies else rows.where(~F.col("copy"))
            if self.key:
                rows = rows.where(F.col("key") == F.lit(key))
            some = self._live(rows.select("id", "embedding"), s)
            out = some if out is None else out.unionByName(some)
        return out

    def search(self, query: list[float], k: int = VECTOR_LIMIT, key=None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(id, score, rank) by cosine, ties by id, of the rows with that key if the index has one. With exact=True, what
        vector_top_k gives on the indexed vectors."""
        segments = self._segments()
        if not segments:
            return self.spark.createDataFrame([], "id long, score double, rank long")
        if len(query) != self.width:
            raise ValueError(f"the index holds vectors of {self.width} components")
        q, ok = _unit(np.array([query], float))
        angle = np.arccos(np.clip(self.centroids() @ q[0], -1, 1)) if ok[0] else np.zeros(len(self.centroids()))
        radius = {}
        for s in segments:
            for name, a in s["radius"].items():
                radius[int(name)] = max(a, radius.get(int(name), 0.0))
        # lists that hold something, nearest first; vectors without a direction score 0
        order = sorted(radius, key=lambda i: (math.pi / 2 if i == ZERO else angle[i], i))
        n = probes or max(1, math.ceil(PROBES * len(order)))
        while True:
            found = vector_top_k(self.probed(order[:n], key, segments), query, k)
            best = found.collect()
            if len(best) == k or n >= len(order):
                break
            n *= 2
        if not exact or n >= len(order):
            return self.spark.createDataFrame(best, found.schema)
        least = best[-1].score
        reach = {i: 0.0 if i == ZERO or not ok[0] else math.cos(max(0.0, angle[i] - radius[i])) for i in order}
        return vector_top_k(self.probed([i for i in order if reach[i] + SLACK >= least], key, segments, False), query, k)
