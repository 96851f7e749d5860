"""Ranked lexical search by windowed bucket scoring.

1. Postings. One pass over the texts counts every document's terms and finds those of the queries; (document, term, tf) and the
   lengths are written down. From these come N, L and each term's df.
2. Windows. Postings are dealt in ranges of doc_id, so that a task holds documents in order, and are cut there at fixed windows of
   1 << WINDOW_BITS ids. A window's postings are turned into one run for each term.
3. Scores. For each query the runs of its terms are added into an array of one number for each document of the window, which
   fits a cache; a set of bits (numpy's booleans) says which documents were met, and only those are harvested into the query's
   heap of k. A task keeps its heaps over all its windows, so it sends at most k rows for a query, and a window's documents
   below the heap's least never enter it.

Queries are taken in batches of at most about QUERIES rows and QUERY_BYTES, each a pass of its own; that bounds the terms that are
broadcast. All other numbers grow with the documents only.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import LOWER, Words, chunks, trim
from .store import pieces, save, tidy

QUERIES, QUERY_BYTES = 4096, 4 << 20
WINDOW_BITS = 14
WINDOW_POSTINGS = 1 << 22  # a window of many long documents is cut further
TASK_POSTINGS = 1 << 23
NOWHERE = -(1 << 60)  # the window of rows without doc_id
GAP = np.ones(256, bool)  # bytes that separate terms
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: str | None) -> list[bytes]:
    """A query's terms, in order and with repeats."""
    return _TERM.findall((text or "").encode().lower())


class Vocabulary:
    """Terms by number; looked up for all words of a run at once, by hash and then byte for byte."""

    def __init__(self, words: list[bytes]) -> None:
        self.size = len(words)
        self.off = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(words), np.uint8)
        h = Words(self.data, self.off, gap=GAP).hashes()
        self.order = np.argsort(h, kind="stable")
        self.hash = h[self.order]
        self.alike = int(np.unique(h, return_counts=True)[1].max(initial=0))  # terms that share a hash: 1, as a rule

    def numbers(self, w: Words) -> np.ndarray:
        """The number of each word of a run, -1 for words that no query has."""
        h = w.hashes()
        out = np.full(len(h), -1, np.int64)
        first = np.searchsorted(self.hash, h)
        for at in (first + i for i in range(self.alike)):
            met = np.flatnonzero(at < self.size)
            met = met[self.hash[at[met]] == h[met]]
            number = self.order[at[met]]
            size = w.end[met] - w.start[met]
            same = size == self.off[number + 1] - self.off[number]
            for n in np.unique(size[same]).tolist():
                rows = np.flatnonzero(same & (size == n))
                for part in np.array_split(rows, 1 + len(rows) * n // (1 << 22)):
                    word, term = w.start[met[part]][:, None], self.off[number[part]][:, None]
                    equal = (LOWER[w.data[word + np.arange(n)]] == self.data[term + np.arange(n)]).all(1)
                    out[met[part[equal]]] = number[part[equal]]
        return out


def _postings(held):
    """(doc_id, n, terms, tfs) of each document with a term: its length, and the terms of the queries that it holds, how often."""

    def run(batches):
        vocabulary = Vocabulary(held.value)
        for b in batches:
            trim()
            for i, j, data, off in chunks(b.column("text")):
                w = Words(data, off, gap=GAP)
                number = vocabulary.numbers(w)
                hit = np.flatnonzero(number >= 0)
                key, tf = np.unique(w.doc[hit] * vocabulary.size + number[hit], return_counts=True)
                doc, term = np.divmod(key, vocabulary.size)
                full = np.flatnonzero(w.count)  # every posting is of one of these
                ends = pa.array(np.r_[np.searchsorted(doc, full), len(doc)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i).take(pa.array(full)), pa.array(w.count[full].astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


def _windows(batches):
    """Rows in the order of doc_id as tables of one window each, of 1 << WINDOW_BITS rows and WINDOW_POSTINGS postings at most
    (one row at least)."""
    held, rows, postings, now = [], 0, 0, None
    for b in batches:
        trim()
        window = np.where(b.column("doc_id").is_valid().to_numpy(zero_copy_only=False), b.column("doc_id").fill_null(0).to_numpy() >> WINDOW_BITS, NOWHERE)
        size = b.column("terms").value_lengths().to_numpy()
        upto, i = np.r_[0, np.cumsum(size, dtype=np.int64)], 0
        while i < len(b):
            if rows and (window[i] != now or rows >= 1 << WINDOW_BITS or postings + size[i] > WINDOW_POSTINGS):
                yield pa.Table.from_batches(held)
                held, rows, postings = [], 0, 0
            now = window[i]
            j = int(np.searchsorted(upto, upto[i] + WINDOW_POSTINGS - postings, "right")) - 1
            last = i + int(np.argmax(np.r_[window[i:] != now, True]))
            j = max(i + 1, min(j, last, i + (1 << WINDOW_BITS) - rows))
            held.append(b.slice(i, j - i))
            rows, postings, i = rows + j - i, postings + int(upto[j] - upto[i]), j
    if rows:
        yield pa.Table.from_batches(held)


def _lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 75 + (75 * n * N) div L, in integers of any size before the division."""
    few, at = np.unique(n, return_inverse=True)
    return np.array([25 + 75 * x * docs // total for x in few.tolist()], np.int64)[at]


class Runs:
    """A window's postings by term: the documents that hold it and what it adds to their scores."""

    def __init__(self, t: pa.Table, weights: np.ndarray, docs: int, total: int) -> None:
        lists = [t.column(c).combine_chunks() for c in ("terms", "tfs")]
        term, tf = (x.flatten().to_numpy() for x in lists)
        doc = np.repeat(np.arange(len(t), dtype=np.int32), lists[0].value_lengths().to_numpy())
        m = _lengths(t.column("n").to_numpy(), docs, total)
        tf = tf.astype(np.int64)
        adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.doc, self.adds = doc[order], adds[order]
        self.at = np.searchsorted(term[order], np.arange(len(weights) + 1)).tolist()


def _scores(held, k: int):
    """Rows of postings in the order of doc_id to (q, doc_id, score): the k best of a task for each query."""

    def run(batches):
        queries, weights, docs, total = held.value
        heaps: list[list] = [[] for _ in queries]
        score, met = np.zeros(1 << WINDOW_BITS, np.int64), np.zeros(1 << WINDOW_BITS, bool)
        for t in _windows(batches):
            runs = Runs(t, weights, docs, total)
            ids = t.column("doc_id").to_pylist()
            for heap, query in zip(heaps, queries):
                for term, times in query:
                    i, j = runs.at[term], runs.at[term + 1]
                    if i < j:  # a document stands once in a run
                        at = runs.doc[i:j]
                        score[at] += runs.adds[i:j] * times if times > 1 else runs.adds[i:j]
                        met[at] = True
                at = np.flatnonzero(met)
                s = score[at]
                score[at], met[at] = 0, False
                least = heap[0][0] if len(heap) == k else 1
                some = np.flatnonzero(s >= least)
                if len(some) > k:
                    some = some[s[some] >= np.partition(s[some], len(some) - k)[len(some) - k]]
                    some = some[np.argsort(-s[some], kind="stable")[:k]]  # rows stand by doc_id
                for i in some.tolist():
                    x = ids[at[i]]
                    entry = (int(s[i]), -math.inf if x is None else -x, x)
                    heapq.heappushpop(heap, entry) if len(heap) == k else heapq.heappush(heap, entry)
        rows = [(q, e[2], e[0]) for q, heap in enumerate(heaps) for e in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["q", "doc_id", "score"])

    return run


@tidy
def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each row of items (item_id, text) the k rows of docs (doc_id, text) of highest
    score above 0, equal scores by doc_id, rows without one last.

    Null, empty and termless texts are no documents: they aren't counted and never found. Items without terms, or with terms
    that no document holds, have no rows. Rows that share an item_id or a doc_id are items and documents of their own.
    Empty tables: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = dict(items.dtypes)["item_id"]
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    asked = save(items.select("item_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row")), "items")
    facts = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    batches = max(pieces(facts.n, QUERIES), pieces(facts.bytes, QUERY_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for i in range(batches):
        some = asked.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == i).orderBy("row").collect()  # QUERIES rows or about that
        some = [(r, words) for r in some if (words := terms(r.text))]
        if some:
            found = _searched(texts, [words for _, words in some], k)
            names = spark.createDataFrame([(q, r.item_id) for q, (r, _) in enumerate(some)], f"q int, item_id {kind}")
            found = save(found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"), "found")
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _searched(texts: DataFrame, queries: list[list[bytes]], k: int) -> DataFrame:
    """(q, rank, doc_id, score) of queries, given by their terms."""
    spark = texts.sparkSession
    number = {t: i for i, t in enumerate(sorted({t for q in queries for t in q}))}
    held = spark.sparkContext.broadcast(list(number))  # terms of one batch of queries
    postings = save(texts.mapInArrow(_postings(held), "doc_id long, n long, terms array<int>, tfs array<int>"), "postings")
    facts = postings.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"), F.sum(F.size("terms")).alias("postings")).first()
    holding = {r.t: r["count"] for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # terms of the batch
    weights = np.array([math.floor(1000 * math.log((2 * facts.docs + 2) / (2 * holding.get(i, 0) + 1))) for i in range(len(number))], np.int64)
    counted = [[(number[t], q.count(t)) for t in dict.fromkeys(q)] for q in queries]
    held = spark.sparkContext.broadcast((counted, weights, facts.docs, facts.total))
    parts = pieces(facts.postings or 0, TASK_POSTINGS, spark.sparkContext.defaultParallelism)
    dealt = postings.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id").drop("row")
    best = dealt.mapInArrow(_scores(held, k), "q int, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "doc_id", "score")


_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n FROM (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS w FROM documents) WHERE len(w) > 0
), facts AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d
), tf AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, facts GROUP BY t
), item AS (
  SELECT q, item_id, t, count(*) AS times FROM (
    SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all({_LOWER}, '{_CLASS}')) AS t FROM benchmark) GROUP BY q, item_id, t
), scored AS (
  SELECT q, item_id, d.doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM item JOIN weights USING (t) JOIN tf USING (t) JOIN d ON d.r = tf.r, facts GROUP BY q, item_id, d.r, d.doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""
