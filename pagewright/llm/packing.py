"""Batches of little padding: optimal length buckets, then token-budget batches inside each.

The lengths of all documents make one histogram. Lengths up to EXACT have a bin each, longer ones bins of 1/64 of an octave,
so the histogram is bounded by some thousands of bins however many documents there are, and may go to the driver. Dynamic
programming chooses the bucket boundaries that minimise padding over it. A bucket holds documents of a third of all rows or
more, so documents are numbered inside slices of a bucket, by a hash of doc_id, and slices are put one behind the other by their counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mixing import slice_of, word_count
from .store import save, tidy

EXACT = 1024


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` intervals that cover the sorted distinct lengths with the least padding, the sum of
    counts * (upper end - length). O(buckets * bins log bins): the best cut moves up with the end (divide and conquer)."""
    n = len(lengths)
    if not n:
        return []
    c = np.concatenate([[0.0], np.cumsum(counts, dtype=float)])
    cl = np.concatenate([[0.0], np.cumsum(counts.astype(float) * lengths)])
    best = np.concatenate([[0.0], np.full(n, np.inf)])  # cost of the first i bins
    back = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        new[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            j = np.arange(a, min(b, mid - 1) + 1)
            cost = best[j] + lengths[mid - 1] * (c[mid] - c[j]) - (cl[mid] - cl[j])
            k = int(cost.argmin())
            new[mid], cut[mid] = cost[k], j[k]
            todo += [(lo, mid - 1, a, int(j[k])), (mid + 1, hi, int(j[k]), b)]
        best = new
        back.append(cut)
    ends, i = [], n
    for cut in reversed(back):
        if i == 0:
            break
        ends.append(int(lengths[i - 1]))
        i = int(cut[i])
    return sorted(set(ends))


@tidy
def packed(docs: DataFrame, budget: int = 16_384, buckets: int = 16) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0, by length), bucket_length (what its documents are padded to), batch_id (from 0
    inside a bucket), slot (from 0 inside a batch): one row for each row of docs (doc_id, text; other columns are ignored).

    Tokens are whitespace words. A batch holds max(1, budget // bucket_length) documents; only the last of a bucket has
    fewer. Null texts and texts without words have no tokens and go to the first bucket; a document longer than the budget
    is a batch of its own. Rows that repeat are documents of their own. Reruns agree. Empty table: no rows.
    """
    light = save(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens"), slice_of(F.col("doc_id"), F.col("text")).alias("h")), "lengths")
    fine = F.when(F.col("n_tokens") <= EXACT, F.col("n_tokens")).otherwise(EXACT + F.floor(F.log2(F.col("n_tokens") / EXACT) * 64) + 1)
    hist = light.groupBy(fine.alias("bin")).agg(F.max("n_tokens").alias("most"), F.count(F.lit(1)).alias("n")).orderBy("most").collect()
    ends = boundaries(np.array([r.most for r in hist], dtype=np.int64), np.array([r.n for r in hist], dtype=np.int64), buckets)
    bucket = F.lit(0)
    for e in ends[:-1]:
        bucket = bucket + (F.col("n_tokens") > e).cast("int")
    length = F.lit(ends[-1] if ends else 0).cast("long")
    for e in reversed(ends[:-1]):
        length = F.when(F.col("n_tokens") <= e, F.lit(e).cast("long")).otherwise(length)
    light = light.select("doc_id", "n_tokens", bucket.alias("bucket"), length.alias("bucket_length"), "h")
    cells = light.groupBy("bucket", "h").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = light.withColumn("n", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("doc_id", "n_tokens")))
    numbered = numbered.join(cells.select("bucket", "h", before.alias("before")), ["bucket", "h"])
    rank = F.col("before") + F.col("n") - 1
    size = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1))))
    return numbered.select("doc_id", "n_tokens", "bucket", "bucket_length", F.floor(rank / size).alias("batch_id"), (rank % size).alias("slot"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 2) AS h FROM documents
), bins AS (
  SELECT row_number() OVER (ORDER BY most) AS i, most, n FROM (
    SELECT max(n_tokens) AS most, count(*) AS n FROM d GROUP BY CASE WHEN n_tokens <= 1024 THEN n_tokens ELSE 1025 + floor(log2(n_tokens / 1024.0::DOUBLE) * 64) END)
), sums AS (
  SELECT i, most, CAST(sum(n) OVER (ORDER BY i) AS BIGINT) AS c, CAST(sum(n * most) OVER (ORDER BY i) AS BIGINT) AS cl FROM bins
  UNION ALL SELECT 0, 0, 0, 0
), best AS (
  SELECT 0 AS k, i, CASE WHEN i = 0 THEN 0 ELSE CAST(1e18 AS BIGINT) END AS cost, CAST(0 AS BIGINT) AS j FROM sums
  UNION ALL
  SELECT k, i, step.cost AS cost, step.j AS j FROM (
    SELECT b.k + 1 AS k, x.i AS i, min(struct_pack(cost := b.cost + CASE WHEN x.i = 0 THEN 0 ELSE x.most * (x.c - y.c) - (x.cl - y.cl) END, j := b.i)) AS step
    FROM best b JOIN sums y ON y.i = b.i JOIN sums x ON (b.i < x.i OR x.i = 0 AND b.i = 0)
    WHERE b.k < least(16, (SELECT count(*) FROM bins)) GROUP BY b.k, x.i)
), back AS (
  SELECT k, i, j FROM best WHERE k = (SELECT max(k) FROM best) AND i = (SELECT max(i) FROM sums) AND i > 0
  UNION ALL SELECT best.k, best.i, best.j FROM back JOIN best ON best.k = back.k - 1 AND best.i = back.j AND back.j > 0
), ends AS (
  SELECT most AS bucket_length, row_number() OVER (ORDER BY most) - 1 AS bucket FROM (SELECT DISTINCT most FROM back JOIN sums USING (i))
), placed AS (
  SELECT d.doc_id, d.n_tokens, CAST(bucket AS INTEGER) AS bucket, bucket_length, row_number() OVER (PARTITION BY bucket ORDER BY h, d.doc_id, d.n_tokens) - 1 AS p,
    greatest(1, 16384 // greatest(bucket_length, 1)) AS size
  FROM d ASOF JOIN ends ON d.n_tokens <= ends.bucket_length
)
SELECT doc_id, n_tokens, bucket, bucket_length, CAST(p // size AS BIGINT) AS batch_id, CAST(p % size AS BIGINT) AS slot FROM placed
"""
