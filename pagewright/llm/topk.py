"""Exact top-k by inner product in three phases with a uniform threshold (Cao and Wang, 2004).

The score of a vector is the sum of its partial scores in LISTS groups of coordinates; each group is a column of its own, so a
list reads only its part of the table. Vectors stand in blocks of BLOCK rows, and partial scores are matrix products.

1. Gather: each block of each list sends its LOCAL best partial scores for each query; they are saved. The vectors among the
   SEEN best of each list (FEW of each block at most) are scored whole; the k-th best of them bounds the result from below.
2. Broadcast: a vector that reaches the bound has a partial score of at least bound / LISTS in some list. Every saved entry
   that reaches this cutoff is collected. Where all that a block sent reaches it, the block may hold more, and only there
   scores are computed again. What other lists didn't send lies below the cutoff, so an upper bound is known for each
   vector; those below the k-th best are pruned.
3. Resolve: the rest is scored exactly.

Equal vectors have equal scores, so only the k + 1 smallest ids of each take part; a large group of copies so costs no more than
one vector. Queries are taken in batches of at most about QUERIES rows, one at a time, which bounds what is broadcast. The
work is that of one product of all queries with all vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import grouped
from .store import save, tidy

LISTS, QUERIES, COMPONENTS, BLOCK_BITS, LOCAL, FEW, SEEN = 2, 2048, 1 << 21, 12, 128, 16, 128
SLICE = 512  # queries in one product
SAFE = 1 << 61  # partial scores beyond this are an error, so sums never wrap
NONE = -(1 << 62)
_PAIR = "q int, row long"


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, exact: in floating point where every sum fits its mantissa, in Python's integers
    where a sum could leave 64 bits. A product beyond SAFE is an error."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    a, b = np.abs(q).max(1).astype(float), np.abs(v).max(1).astype(float)
    for kind, most in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
        if a.max() * b.max() * q.shape[1] < most:
            return (q.astype(kind) @ v.astype(kind).T).astype(np.int64)
    out = np.zeros((len(q), len(v)), np.int64)
    far = a * b.max() * q.shape[1] >= SAFE
    out[~far] = q[~far] @ v.T
    wide = np.flatnonzero(b * a.max() * q.shape[1] >= SAFE)
    near = np.flatnonzero(b * a.max() * q.shape[1] < SAFE)
    far = np.flatnonzero(far)
    out[np.ix_(far, near)] = q[far] @ v[near].T
    for i in far.tolist():
        for j in wide.tolist():
            s = sum(x * y for x, y in zip(q[i].tolist(), v[j].tolist()))
            if abs(s) > SAFE:
                raise OverflowError("a score doesn't fit a long")
            out[i, j] = s
    return out


class Ragged:
    """Rows of integers, held as one matrix for each width."""

    def __init__(self, arr) -> None:
        arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
        self.n = len(arr)
        sizes = np.diff(arr.offsets.to_numpy()) if len(arr) else np.zeros(0, np.int64)
        flat, at = arr.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
        self.parts = []
        for w in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == w)
            whole = len(rows) == self.n
            self.parts.append((rows, flat.reshape(self.n, w) if whole else flat[at[rows][:, None] + np.arange(w)]))

    def scores(self, other: Ragged, rows: np.ndarray) -> np.ndarray:
        """Inner products of some of these rows with all of other's, over the coordinates that both have."""
        out = np.zeros((len(rows), other.n), np.int64)
        for mine, a in self.parts:
            i = np.flatnonzero(np.isin(rows, mine, assume_unique=True))
            x = a[np.searchsorted(mine, rows[i])]
            for theirs, b in other.parts:
                w = min(a.shape[1], b.shape[1])
                if len(i) and w:
                    out[np.ix_(i, theirs)] = _product(x[:, :w], b[:, :w])
        return out


def integers(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, v): floor(256 * x) of each component. Rows whose id or vector is null or whose vector holds null or non-finite
    components take no part; a component beyond 2**62 after scaling is an error."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = vectors.select(F.col(id_).cast("long").alias("vec_id"), x.alias("x"), F.coalesce(fine, F.lit(False)).alias("fine")).where("vec_id is not null and fine")
    whole = F.transform("x", lambda c: F.when(F.abs(c * 256) < float(1 << 62), F.floor(c * 256)).otherwise(F.raise_error(F.lit("a component doesn't fit a long")).cast("long")))
    return v.select("vec_id", whole.alias("v"))


@tidy
def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by ``every`` the k other rows of highest
    score, ties to the smaller id; all of them if there are fewer.

    Rows that take no part: see integers(). Vectors of different widths are multiplied over the coordinates that both have;
    an empty vector scores 0. Rows that share an id are rows of their own, as queries and as candidates. Scores that may not
    fit a long are an error, never wrapped. Empty table or no row to ask for: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    whole = save(integers(vectors, id_, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    is_query = F.col("vec_id") % every == 0
    facts = whole.agg(F.avg(F.size("v")).alias("width"), F.count_if(is_query).alias("n"), F.sum(F.when(is_query, F.size("v"))).alias("components"), F.count(F.lit(1)).alias("all")).first()
    if not facts.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cut = [round(facts.width * j / LISTS) for j in range(LISTS)]
    ends = [*cut[1:], None]
    copies = Window.partitionBy("v").orderBy("vec_id", "row")
    few = whole.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
    parts = [F.slice("v", a + 1, (1 << 30) if b is None else b - a).alias(f"p{j}") for j, (a, b) in enumerate(zip(cut, ends))]
    few = few.select("row", "vec_id", *parts).coalesce(1 + (facts.all >> BLOCK_BITS + 2))  # partitions of some blocks each
    table = save(few.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "lists")
    batches = max(-(-facts.n // QUERIES), -(-facts.components // COMPONENTS))
    out = None
    for i in range(batches):
        asked = whole.where(is_query & (F.pmod(F.xxhash64("row"), F.lit(batches)) == i)).select("row", "vec_id", *parts).orderBy("row").toArrow()
        if len(asked):
            found = _asked(table, asked, k)
            out = found if out is None else out.unionByName(found)
    return out


def _table(q: np.ndarray, row: np.ndarray, **more) -> pa.RecordBatch:
    cols = {"q": pa.array(q.astype(np.int32)), "row": pa.array(row.astype(np.int64)), **{n: pa.array(x) for n, x in more.items()}}
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(x.ravel()))


@tidy
def _asked(table: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of one batch of queries."""
    spark = table.sparkSession
    own = asked.column("row").to_numpy()
    held = spark.sparkContext.broadcast((own, [Ragged(asked.column(f"p{j}")) for j in range(LISTS)]))  # QUERIES rows or about that

    def scores(j, part, row, rows):
        own, qs = held.value
        s = qs[j].scores(part, rows)
        s[row[None, :] == own[rows][:, None]] = NONE
        return s

    def gather(j):
        def run(batches):
            n_asked = len(held.value[0])
            for t in grouped(batches, "block"):
                row, part = t.column("row").to_numpy(), Ragged(t.column(f"p{j}"))
                m = min(max(k, LOCAL), len(row))
                for a in range(0, n_asked, SLICE):
                    rows = np.arange(a, min(a + SLICE, n_asked))
                    s = scores(j, part, row, rows)
                    c = np.argpartition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m :]
                    best = np.take_along_axis(s, c, 1)
                    order = np.argsort(-best, axis=1, kind="stable")
                    c, best = np.take_along_axis(c, order, 1), np.take_along_axis(best, order, 1)
                    floor = best[:, -1] if m < len(row) else np.full(len(rows), NONE)
                    names = ["l", "q", "block", "floor", "rows", "s"]
                    cols = [pa.array(np.full(len(rows), j, np.int32)), pa.array(rows.astype(np.int32)), pa.array(np.full(len(rows), t.column("block")[0].as_py())), pa.array(floor), _lists(row[c]), _lists(best)]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

        return table.select("row", "block", f"p{j}").mapInArrow(run, "l int, q int, block long, floor long, rows array<long>, s array<long>")

    def resolve(pairs: DataFrame) -> DataFrame:
        """Exact scores of (q, row) pairs."""

        def run(batches):
            own, qs = held.value
            for b in batches:
                if not len(b):
                    continue
                a, s = b.column("q").to_numpy(), np.zeros(len(b), np.int64)
                for j in range(LISTS):
                    part = Ragged(b.column(f"p{j}"))
                    for mine, x in qs[j].parts:
                        for theirs, y in part.parts:
                            at = theirs[np.isin(a[theirs], mine)]
                            w = min(x.shape[1], y.shape[1])
                            if len(at) and w:
                                u, v = x[np.searchsorted(mine, a[at])][:, :w], y[np.searchsorted(theirs, at)][:, :w]
                                if float(np.abs(u).max()) * float(np.abs(v).max()) * w < SAFE:
                                    s[at] += (u * v).sum(1)
                                else:
                                    s[at] += np.array([_product(u[i : i + 1], v[i : i + 1])[0, 0] for i in range(len(at))])
                yield _table(a, b.column("row").to_numpy(), vec_id=b.column("vec_id"), s=s)

        return pairs.join(table.drop("block"), "row").select("q", "row", "vec_id", *(f"p{j}" for j in range(LISTS))).mapInArrow(run, _PAIR + ", vec_id long, s long")

    best = Window.partitionBy("q").orderBy(F.desc("s"), "vec_id", "row")
    sent = gather(0)
    for j in range(1, LISTS):
        sent = sent.union(gather(j))
    sent = save(sent, "sent")
    zipped = F.arrays_zip("rows", "s")
    heads = sent.select("l", "q", F.explode(F.slice(zipped, 1, max(k, FEW))).alias("e")).select("l", "q", F.col("e.rows").alias("row"), F.col("e.s").alias("s")).where(F.col("s") > NONE)
    heads = heads.withColumn("n", F.row_number().over(Window.partitionBy("l", "q").orderBy(F.desc("s"), "row"))).where(F.col("n") <= max(k, SEEN))
    first = resolve(heads.select("q", "row").distinct()).withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("q", "s").toPandas()
    bound, cutoff = np.full(len(own), NONE), np.full(len(own), NONE)  # with fewer than k others: no bound
    bound[first.q.to_numpy()] = first.s.to_numpy()
    cutoff[first.q.to_numpy()] = -(-first.s.to_numpy() // LISTS)
    limits = F.broadcast(spark.createDataFrame(pd.DataFrame({"q": np.arange(len(own), dtype=np.int32), "bound": bound, "cutoff": cutoff}), "q int, bound long, cutoff long"))

    known = sent.join(limits, "q")
    short = save(known.where((F.col("floor") >= F.col("cutoff")) & (F.col("floor") > NONE)).select("block", "l", "q", "cutoff").distinct(), "short")
    if short.isEmpty():
        reach = known
    else:
        reach = known.join(short.drop("cutoff"), ["block", "l", "q"], "left_anti")
    high = F.filter(zipped, lambda e: (e["s"] >= F.col("cutoff")) & (e["s"] > NONE))
    reach = reach.select("q", F.explode(high).alias("e")).select("q", F.col("e.rows").alias("row"), F.col("e.s").alias("s"))
    if not short.isEmpty():

        def again(left: pa.Table, right: pa.Table) -> pa.Table:
            """All entries of a block that reach the cutoff, for the queries to which it sent too few."""
            out, row = [], left.column("row").to_numpy()
            l, q, cutoff = (right.column(n).to_numpy() for n in ("l", "q", "cutoff"))
            for j in range(LISTS) if len(row) else ():
                part = Ragged(left.column(f"p{j}"))
                at = np.flatnonzero(l == j)
                at = at[np.argsort(q[at])]
                for a in range(0, len(at), SLICE):
                    some = at[a : a + SLICE]
                    s = scores(j, part, row, q[some])
                    i, c = np.nonzero((s >= cutoff[some][:, None]) & (s > NONE))
                    out.append(_table(q[some][i], row[c], s=s[i, c]))
            return pa.Table.from_batches(out, schema=_table(np.zeros(0), np.zeros(0), s=np.zeros(0, np.int64)).schema)

        left = table.join(short.select("block").distinct(), "block", "left_semi").select("block", "row", *(f"p{j}" for j in range(LISTS)))
        more = left.groupBy("block").cogroup(short.groupBy("block")).applyInArrow(again, _PAIR + ", s long")
        reach = reach.union(more)
    sums = reach.groupBy("q", "row").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n")).join(limits, "q")
    # what a list didn't send is below its cutoff
    left = sums.where((F.col("n") == LISTS) & (F.col("s") >= F.col("bound")) | (F.col("n") < LISTS) & (F.col("s") + (LISTS - F.col("n")) * (F.col("cutoff") - 1) >= F.col("bound")))
    ranked = resolve(left.select("q", "row")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(own), dtype=np.int32), "query_id": asked.column("vec_id").to_numpy()}), "q int, query_id long")
    return ranked.join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", F.col("s").alias("score"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
