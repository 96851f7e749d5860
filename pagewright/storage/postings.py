"""A stored posting index: BM25 top-k that reads the postings of a query's terms only, and of these the blocks that can matter.

A segment's documents are taken in windows of BLOCK at most, as they come, the same windows for all terms. A block is what one
term has in one window: (id, tf, length) of each document, and the largest tf and smallest length among them, from which no
score in the block can be higher, whatever the corpus has become since. Blocks are written in the order of (key, term, window),
and a directory names the first and last (key, term) of each file. A query

1. opens the files that the directory gives for its terms, and reads the heads of blocks (not the postings) of those terms:
   they give df and, summed over the terms, a bound for each window;
2. scores the SEEN windows with the highest bounds; the k-th best score there is a threshold;
3. scores the windows whose bound reaches the threshold, and no others.

The result is that of a scan of all texts. With a key (a column to which every query is equal, such as a document's owner), N,
lengths and df are those of the key's documents. New versions of documents come as further segments; what they replace is left
out from then on, and compact() writes all segments anew as one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LEXICAL_LIMIT
from ..operators.retrieval import B, K1, bm25, ranked
from .segments import Segmented

BLOCK = 128
SEEN = 16
PUSHED = 1024  # windows that are named to the scan; more are joined
GONE = 1 << 20  # ids that go to all tasks when segments are compacted; more are joined
SLACK = 2e-6  # scores are rounded to six digits; a bound may be off by its own rounding


def _bound(idf: Column, tf: Column, dl: Column, avgdl: float) -> Column:
    """The highest score a block can hold: it rises with tf and falls with the length."""
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_BLOCK = "key {key}, term string, window long, n int, tf int, dl int, postings array<struct<id:{id},tf:int,dl:int>>"


def _runs(*codes: np.ndarray) -> np.ndarray:
    """Where runs of equal codes begin."""
    new = np.zeros(len(codes[0]), bool)
    new[:1] = True
    for c in codes:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _batch(key: pa.Array, term: pa.Array, window: np.ndarray, begins: np.ndarray, ids: pa.Array, tf: np.ndarray, dl: np.ndarray) -> pa.RecordBatch:
    """Blocks of postings (ids, tf, dl) that begin at these places."""
    n = np.diff(np.append(begins, len(tf)))
    postings = pa.StructArray.from_arrays([ids, pa.array(tf, pa.int32()), pa.array(dl, pa.int32())], names=["id", "tf", "dl"])
    most, least = (f.reduceat(x, begins) if len(begins) else x for f, x in ((np.maximum, tf), (np.minimum, dl)))
    lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(tf)), pa.int32()), postings)
    columns = [key, term.cast(pa.string()), pa.array(window, pa.int64()), pa.array(n, pa.int32()), pa.array(most, pa.int32()), pa.array(least, pa.int32()), lists]
    return pa.RecordBatch.from_arrays(columns, names=["key", "term", "window", "n", "tf", "dl", "postings"])


def _window(key: pa.Array, ids: pa.Array, text: pa.Array, window: int) -> pa.RecordBatch:
    """The blocks of a window's documents, and for each key one of the term null that holds them all. Words are runs of bytes of
    [a-z0-9], which no other character's bytes are."""
    docs, text = len(ids), text.cast(pa.large_string())
    _, places, data = text.buffers()
    at = np.frombuffer(places, np.int64)[text.offset : text.offset + docs + 1]
    data = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    word = _WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = at[:-1][at[:-1] < len(data)]
    first[begin] = word[begin]  # a text's first word isn't the end of the text before
    length = np.bincount(np.cumsum(first)[word] - 1, minlength=0)
    ends = np.append(0, np.cumsum(length)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(ends), pa.py_buffer(data[word])).dictionary_encode()
    row = np.searchsorted(at, np.flatnonzero(first), side="right") - 1
    dl = np.bincount(row, minlength=docs)
    keys = key.dictionary_encode(null_encoding="encode")
    own, terms = keys.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1)
    found, tf = np.unique((own[row] * terms + words.indices.to_numpy()) * docs + row, return_counts=True)
    doc, kind = found % docs, found // docs
    every = np.argsort(own, kind="stable")
    begins, whole = _runs(kind), _runs(own[every])
    kind = kind[begins]
    term = pa.concat_arrays([words.dictionary.take(pa.array(kind % terms)), pa.nulls(len(whole), pa.large_string())])
    place = np.append(doc, every)
    of = keys.dictionary.take(pa.array(np.append(kind // terms, own[every][whole])))
    begins = np.append(begins, whole + len(doc))
    return _batch(of, term, np.full(len(begins), window), begins, ids.take(pa.array(place)), np.append(tf, np.zeros(docs, tf.dtype)), dl[place])


def _without(b: pa.RecordBatch, gone: pa.Array) -> pa.RecordBatch:
    """Blocks without the postings of some ids; those of which nothing is left go."""
    lists = b["postings"]
    flat = lists.flatten()
    keep = np.invert(pc.is_in(flat.field("id"), value_set=gone).to_numpy(zero_copy_only=False))
    ends = np.append(0, np.cumsum(keep))[np.append(0, np.cumsum(lists.value_lengths().to_numpy()))]
    n = np.diff(ends)
    some, flat = pa.array(np.flatnonzero(n)), flat.filter(pa.array(keep))
    return _batch(b["key"].take(some), b["term"].take(some), b["window"].take(some).to_numpy(), ends[:-1][n > 0], flat.field("id"), flat.field("tf").to_numpy(), flat.field("dl").to_numpy())


class Index(Segmented):
    """Documents (id, text and, if the index has one, its key column) by their terms."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None) -> None:
        super().__init__(spark, path)
        self.key = key

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("key", F.col(self.key) if self.key else F.lit(0))

    def _counted(self, members: DataFrame) -> dict:
        r = members.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        return {"rows": r.rows, "length": r.length}

    def add(self, docs: DataFrame) -> int:
        """Index documents; those whose id is there already take the place of the old ones. Ids are distinct. Null texts are
        documents without terms: they count in N."""
        n = docs.count()
        if not n:
            return self.log.latest()[0]
        segment, size = f"segments/{uuid.uuid4().hex}", BLOCK
        words = self._keyed(docs).select("key", "id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            window = uuid.uuid4().int >> 66
            for b in batches:
                for i in range(0, b.num_rows, size):
                    some, window = b.slice(i, size), window + 1
                    yield _window(some["key"], some["id"], some["text"], window)

        kinds = dict(words.dtypes)
        stored = self._stored(segment, words.mapInArrow(cut, _BLOCK.format(**kinds)), n)
        return self._commit(self._table(f"{segment}/members").select("id"), stored)

    def _stored(self, segment: str, blocks: DataFrame, n: int) -> dict:
        """Write blocks of n documents, and the documents, which are blocks of the term null, with their directory. Blocks are
        written as they are made, so that texts are read once and a block is the same for all that follows, and then dealt
        once by the order in which they are read."""
        made = f"{segment}/made"
        blocks.write.parquet(self.files.full(made))
        try:
            rows = self._table(made)
            members = rows.where("term is null").select("key", F.inline("postings")).select("key", "id", "dl")
            members.repartitionByRange("key", "id").sortWithinPartitions("key", "id").write.parquet(self.files.full(f"{segment}/members"))
            order = ("key", "term", "window")
            rows.where("term is not null").repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(self.files.full(f"{segment}/postings"))
        finally:
            self.files.delete(made)
        place = F.struct("key", "term")
        each = self._table(f"{segment}/postings").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(place).alias("first"), F.max(place).alias("last"))
        each.coalesce(1).write.parquet(self.files.full(f"{segment}/directory"))  # a row for each file
        counted = self._counted(self._table(f"{segment}/members"))
        if counted["rows"] != n:
            raise RuntimeError(f"{counted['rows']} documents were indexed instead of {n}")
        return {"path": segment, "gone": []} | counted

    def _kept(self, segment: dict) -> DataFrame:
        """The blocks of a segment without what is gone; they keep their windows."""
        blocks = self._table(f"{segment['path']}/postings").select("key", "term", F.col("window").cast("long").alias("window"), "n", "tf", "dl", "postings")
        gone = self._gone(segment)
        if gone is None:
            return blocks
        ids = gone.select("id")
        if gone.count() <= GONE:
            left = ids.toArrow()["id"].combine_chunks()

            def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield _without(b, left)

            kinds = {"key": dict(blocks.dtypes)["key"], "id": dict(gone.dtypes)["id"]}
            return blocks.mapInArrow(live, _BLOCK.format(**kinds))
        each = blocks.select("key", "term", "window", F.inline("postings"))
        return each.join(ids, "id", "left_anti").groupBy("key", "term", "window").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.collect_list(F.struct("id", "tf", "dl")).alias("postings"))

    def compact(self) -> int:
        """Write all segments as one; what is gone goes for good. Documents that others index meanwhile are an error."""
        version, body = self.log.latest()
        old = body.get("segments", [])
        if len(old) < 2 and not any(s["gone"] for s in old):
            return version
        whole = None
        for s in old:
            m, none = self._live(self._table(f"{s['path']}/members"), s), F.lit(0)
            alone = F.array(F.struct("id", none.alias("tf"), "dl"))
            m = m.select("key", F.lit(None).cast("string").alias("term"), none.cast("long").alias("window"), F.lit(1).alias("n"), none.alias("tf"), "dl", alone.alias("postings"))
            some = self._kept(s).unionByName(m)
            whole = some if whole is None else whole.unionByName(some)
        new = self._stored(f"segments/{uuid.uuid4().hex}", whole, sum(s["rows"] for s in old))
        if not self.log.put(version + 1, body | {"segments": [new]}):
            raise RuntimeError("the index was changed while it was compacted")
        return version + 1

    # asking

    def postings(self, wanted: list[str], key=None, segments: list[dict] | None = None) -> list[tuple[dict, DataFrame]]:
        """For each segment the blocks of some terms: only files that can hold them are opened."""
        out = []
        for s in self._segments() if segments is None else segments:
            place = lambda t: F.struct(F.lit(key if self.key else 0).cast(kind).alias("key"), F.lit(t).alias("term"))
            directory = self._table(f"{s['path']}/directory")
            kind = directory.schema["first"].dataType["key"].dataType
            holds = F.lit(False)
            for t in wanted:
                holds = holds | ((F.col("first") <= place(t)) & (F.col("last") >= place(t)))
            names = [r.file for r in directory.where(holds).select("file").collect()]  # files of these terms
            if names:
                rows = self.spark.read.parquet(*(self.files.full(f"{s['path']}/postings/{n}") for n in names))
                out.append((s, rows.where(F.col("key") == F.lit(key if self.key else 0)).where(F.col("term").isin(wanted))))
        return out

    def _lengths(self, segments: list[dict], key) -> tuple[int, int]:
        """(documents, all their terms) that a query sees."""
        if self.key is None:
            return sum(s["rows"] for s in segments), sum(s["length"] for s in segments)
        n = total = 0
        for s in segments:
            c = self._counted(self._live(self._table(f"{s['path']}/members").where(F.col("key") == F.lit(key)), s))
            n, total = n + c["rows"], total + c["length"]
        return n, total

    def _scored(self, kept: list[tuple[dict, DataFrame]], wanted: list[str], df: dict, n: int, avgdl: float) -> DataFrame:
        """(id, score) of the documents in these blocks."""
        live = None
        for s, blocks in kept:
            some = self._live(blocks.select("term", F.inline("postings")), s)
            live = some if live is None else live.unionByName(some)
        tf = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(wanted)]
        each = live.groupBy("id", "dl").agg(*tf)
        score = bm25([F.col(f"tf{i}") for i in range(len(wanted))], [F.lit(df.get(t, 0)) for t in wanted], F.col("dl"), F.lit(n), F.lit(avgdl))
        return each.select("id", F.round(score, 6).alias("score"))

    def top_k(self, query: str, k: int = LEXICAL_LIMIT, key=None) -> DataFrame:
        """(id, score, rank): what lexical_top_k gives on the indexed texts, ties by id. A query without terms finds nothing."""
        wanted = list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))
        segments = self._segments()  # one version for the whole query
        found = self.postings(wanted, key, segments) if wanted else []
        df: dict[str, int] = {}
        heads = None
        for i, (s, blocks) in enumerate(found):
            each = blocks.groupBy("term").agg(F.sum("n").alias("n")) if not s["gone"] else self._live(blocks.select("term", F.inline("postings")), s).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
            for r in each.collect():  # a row for each term
                df[r.term] = df.get(r.term, 0) + r.n
            head = blocks.select(F.lit(i).alias("segment"), "window", "term", "tf", "dl")
            heads = head if heads is None else heads.unionByName(head)
        if not df:
            kind = self._table(f"{segments[0]['path']}/members").schema["id"].dataType.simpleString() if segments else "long"
            return self.spark.createDataFrame([], f"id {kind}, score double, rank long")
        n, total = self._lengths(segments, key)
        avgdl = total / n
        idf = F.lit(0.0)
        for t in wanted:
            idf = F.when(F.col("term") == t, F.log(1 + (F.lit(n) - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))).otherwise(idf)
        bounds = heads.groupBy("segment", "window").agg(F.sum(_bound(idf, F.col("tf"), F.col("dl"), avgdl)).alias("bound"))

        def within(windows: DataFrame | list) -> list[tuple[dict, DataFrame]]:
            out = []
            for i, (s, blocks) in enumerate(found):
                if isinstance(windows, list):
                    at = [r.window for r in windows if r.segment == i]
                    if at:
                        out.append((s, blocks.where(F.col("window").isin(at))))
                else:
                    out.append((s, blocks.join(windows.where(F.col("segment") == i).select("window"), "window", "left_semi")))
            return out

        first = bounds.orderBy(F.desc("bound")).limit(SEEN).collect()
        best = self._scored(within(first), wanted, df, n, avgdl).orderBy(F.desc("score"), "id").limit(k).collect()
        least = best[-1].score if len(best) == k else float("-inf")
        reach = bounds.where(F.col("bound") + SLACK >= least).select("segment", "window")
        few = reach.limit(PUSHED + 1).collect()
        kept = within(few if len(few) <= PUSHED else reach)
        top = self._scored(kept, wanted, df, n, avgdl).orderBy(F.desc("score"), "id").limit(k)
        return ranked(top, F.desc("score"))
