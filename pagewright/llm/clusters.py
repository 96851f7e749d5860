"""Centroid clustering in integers: matrix products in float32 with rigorous error intervals, exact integers where they overlap.

A vector's distance to a centroid c is |v|^2 + |c|^2 - 2 v.c; the first part is the same for all centroids. The product v.c is
taken in float32 for all vectors of a batch and all centroids at once. With n components and u = 2**-24 it is off by at most
gamma * |v| * |c|, gamma = (n + 2) u / (1 - (n + 2) u): a rounding of either factor, of each product and of each sum. Every
centroid so gets an interval; those whose interval meets that of the least upper end are a vector's shortlist. A shortlist of
one decides; longer ones are computed again in integers, ties to the smaller number.

A round is one pass over the vectors. A task gives back one row of sums for each centroid it met, in pieces that no sum of which
can leave 64 bits; sums are added up as decimals, so nothing depends on the order of rows. The driver holds k centroids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import trim
from .store import save, tidy

ROWS = 1 << 15  # vectors in one product
UNIT = 2.0**-24  # rounding of float32
NEAR = 1 << 26  # components below this have distances and sums that fit 64 bits, at up to FITS components
FITS = 1 << 9
LIMIT = 1 << 62


def integers(vectors: DataFrame, id_: str, vector: str, scale: int, width: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of vectors of exactly that many components, none null or non-finite. A component that
    doesn't fit a long is an error."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = (F.size("x") == width) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), x.alias("x")).where(F.coalesce(fine, F.lit(False)))
    whole = F.transform("x", lambda c: F.when(F.abs(c * scale) < float(LIMIT), F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component doesn't fit a long")).cast("long")))
    return rows.select("vec_id", whole.alias("v"))


def starts(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of "seed:vec_id", in that order; rows that share an id stand in the order of their
    components, rows without one last."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    return [list(r.v) for r in first.collect()]  # k rows


def _whole(centroids: list[list[int]]) -> np.ndarray:
    """One row for each centroid; Python's integers where distances may leave 64 bits."""
    c = np.array(centroids, dtype=object)
    return c.astype(np.int64) if _small(c) else c


def _small(x: np.ndarray) -> bool:
    return x.shape[1] <= FITS and (not x.size or max(abs(int(x.min())), abs(int(x.max()))) < NEAR)


def exact(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows, in integers of 64 bits or of Python."""
    if not (_small(v) and _small(c)):
        v, c = v.astype(object), c.astype(object)
    d = v - c
    return (d * d).sum(1)


def intervals(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) for every vector and centroid: |c|^2 - 2 v.c lies between them, whatever float32 rounded."""
    n = v.shape[1]
    gamma = (n + 2) * UNIT / (1 - (n + 2) * UNIT)
    wide_v, wide_c = v.astype(np.float64), c.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        dot = (wide_v.astype(np.float32) @ wide_c.astype(np.float32).T).astype(np.float64)
        square = (wide_c * wide_c).sum(1)
        size = np.sqrt((wide_v * wide_v).sum(1))[:, None] * np.sqrt(square)[None, :]
        mid = square[None, :] - 2 * dot
        # the last term is far more than float64 can be off by
        off = 2 * gamma * size * (1 + 1e-6) + (square[None, :] + 2 * np.abs(dot)) * 1e-12 * n
        low, high = mid - off, mid + off
    unknown = ~np.isfinite(mid) | ~np.isfinite(off)
    low[unknown], high[unknown] = -np.inf, np.inf
    return low, high


def nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of each vector's nearest centroid, exact; ties to the smaller number."""
    low, high = intervals(v, c)
    listed = low <= high.min(1)[:, None]
    out = listed.argmax(1)
    row, col = np.nonzero(listed & (listed.sum(1) > 1)[:, None])
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        d = exact(v[row], c[col])
        if d.dtype == object:
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(row)]):
                out[row[a]] = col[a + min(range(b - a), key=lambda i: (d[a + i], i))]
        else:
            best = np.minimum.reduceat(d, first)
            hit = np.flatnonzero(d == np.repeat(best, np.diff(np.r_[first, len(row)])))
            # columns rise within a row, so the first hit of a row is the smallest number
            at = hit[np.unique(row[hit], return_index=True)[1]]
            out[row[at]] = col[at]
    return out


def _matrices(batches, width: int):
    """(batch, its vectors as a matrix) in pieces of at most ROWS rows."""
    for b in batches:
        trim()
        for i in range(0, len(b), ROWS):
            piece = b.slice(i, ROWS)
            yield piece, piece.column("v").flatten().to_numpy().reshape(len(piece), width)


def _sums(held, width: int):
    """For each batch: (cluster, n, sums of its components); where a sum may leave 64 bits, one row for each vector."""

    def run(batches):
        c = held.value
        for _, v in _matrices(batches, width):
            number = nearest(v, c)
            if _small(v):
                order = np.argsort(number, kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(number[order]) > 0])
                n, total = np.diff(np.r_[at, len(v)]), np.add.reduceat(v[order], at, axis=0)
                number = number[order][at]
            else:
                n, total = np.ones(len(v), np.int64), v
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, width, dtype=np.int32)), pa.array(np.ascontiguousarray(total).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(n.astype(np.int64)), lists], names=["cluster", "n", "sums"])

    return run


def _assigned(held, width: int):
    def run(batches):
        c = held.value
        for b, v in _matrices(batches, width):
            number = nearest(v, c)
            d = exact(v, c[number])
            if d.dtype == object and any(x >= 1 << 63 for x in d.tolist()):
                raise OverflowError("a distance doesn't fit a long")
            cols = [b.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(d.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "cluster", "distance"])

    return run


def moved(rows: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """Every centroid that is nearest to some vector, replaced by the floor of their mean in each component."""
    held = rows.sparkSession.sparkContext.broadcast(_whole(centroids))  # k rows
    part = rows.select("v").mapInArrow(_sums(held, width), "cluster int, n long, sums array<long>")
    each = part.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    out = [list(c) for c in centroids]
    for r in each.collect():  # k rows for each component
        out[r.cluster][r.i] = int(r.s) // r.n
    return out


@tidy
def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: int = 1, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia and inertia (distances summed over the cluster and over all),
    centroid_sha256 (of the final centroid's components, joined by commas): one row for each vector that takes part.

    Vectors that are null, of another width, or hold null or non-finite components take no part. Rows that share an id are
    vectors of their own; rows without an id are vectors too, but start a centroid only if there is no other row. With
    fewer than k vectors each starts one centroid. Equal starts are kept; the smaller number gets all their vectors and the
    others stay empty, where they were. A component, distance or sum that doesn't fit a long is an error, never wrapped.
    Empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = save(integers(vectors, id_, vector, scale, width), "vectors")
    centroids = starts(rows, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids, width)
    held = spark.sparkContext.broadcast(_whole(centroids))
    out = save(rows.mapInArrow(_assigned(held, width), "vec_id long, cluster int, distance long"), "assigned")
    total = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    every = sum(total.values())
    facts = [(i, total[i], every, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids) if i in total]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(i: int) -> str:
    """One round as SQL: every vector to its nearest centroid, then the floor of the mean of each component."""
    return f"""
), a{i} AS (
  SELECT r, arg_min(n, d * 64 + n) AS n, min(d) AS d FROM (
    SELECT v.r, c.n, CAST(list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) AS d FROM v, c{i} c
  ) GROUP BY r"""


def _moved_sql(i: int) -> str:
    return f"""
), s{i} AS (
  SELECT a.n, j.j, sum(v.v[j.j]) AS s, count(*) AS m FROM v JOIN a{i} a ON a.r = v.r, (SELECT unnest(range(1, 65)) AS j) j GROUP BY a.n, j.j
), c{i + 1} AS (
  SELECT c.n, coalesce(s.c, c.c) AS c FROM c{i} c LEFT JOIN (
    SELECT n, list((s - ((s % m) + m) % m) // m ORDER BY j) AS c FROM s{i} GROUP BY n) s ON s.n = c.n"""


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS n, v AS c FROM v
  QUALIFY n < 16{"".join((_round_sql(i) + _moved_sql(i)).replace(" AS (", " AS MATERIALIZED (") for i in range(3))}{_round_sql(3)}
)
SELECT v.vec_id, CAST(a.n AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.n) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM v JOIN a3 a ON a.r = v.r JOIN c3 c ON c.n = a.n
"""
