"""Toxicity by a counterfactual-regularised classifier.

The model is a logistic regression on hashed words and prefixes. In each labelled text the identity terms of IDENTITY are
swapped for another term of the same kind, and the squared change of the score between the text and its swapped twin is added
to the loss (weight COUNTERFACTUAL). A group mention so gets no weight of its own, and neutral mentions are not rejected.

It is fitted on the driver on at most SAMPLE labelled documents, those with the smallest hash of doc_id, and of these on as many
as have SAMPLE_BYTES of features; only these are sent there, one row for each doc_id. Every whole text is scored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import DIM, Adagrad, lexical, sigmoid, sums, telling
from .kernel import Words, chunks, trim
from .store import save, scratch, tidy

SAMPLE, SAMPLE_BYTES = 10_000, 96 << 20
COUNTERFACTUAL = 5.0
THRESHOLD = 0.7
# Kinds of terms that name groups of people; each is swapped for the next of its kind.
IDENTITY = [
    "women men".split(),
    "woman man".split(),
    "girls boys".split(),
    "she he".split(),
    "gay straight lesbian bisexual".split(),
    "transgender cisgender".split(),
    "black white asian latino".split(),
    "muslim christian jewish hindu buddhist atheist".split(),
    "muslims christians jews hindus buddhists atheists".split(),
    "american mexican chinese african european indian arab".split(),
    "old young elderly teenage".split(),
    "blind deaf disabled".split(),
    # French
    "femmes hommes".split(),
    "femme homme".split(),
    "filles garçons".split(),
    "elle il".split(),
    "elles ils".split(),
    "gay hétéro lesbienne bisexuel".split(),
    "noir blanc asiatique".split(),
    "noire blanche".split(),
    "noirs blancs asiatiques".split(),
    "musulman chrétien juif hindou bouddhiste athée".split(),
    "musulmane chrétienne juive hindoue".split(),
    "musulmans chrétiens juifs hindous bouddhistes athées".split(),
    "américain mexicain chinois africain européen indien arabe".split(),
    "américaine mexicaine chinoise africaine européenne indienne".split(),
    "vieux jeunes".split(),
    "vieille jeune".split(),
    "aveugle sourd handicapé".split(),
    # German
    "frauen männer".split(),
    "frau mann".split(),
    "mädchen jungen".split(),
    "sie er".split(),
    "schwul hetero lesbisch bisexuell".split(),
    "schwarze weiße asiatische".split(),
    "schwarzen weißen asiatischen".split(),
    "muslim christ jude hindu".split(),
    "muslime christen juden hindus buddhisten atheisten".split(),
    "muslimische christliche jüdische hinduistische buddhistische".split(),
    "amerikanische mexikanische chinesische afrikanische europäische indische arabische".split(),
    "amerikaner mexikaner chinesen afrikaner europäer inder araber".split(),
    "alte junge".split(),
    "alten jungen".split(),
    "blinde taube behinderte".split(),
    # Spanish
    "mujeres hombres".split(),
    "mujer hombre".split(),
    "chicas chicos".split(),
    "ella él".split(),
    "ellas ellos".split(),
    "gay heterosexual lesbiana bisexual".split(),
    "negro blanco asiático".split(),
    "negra blanca asiática".split(),
    "negros blancos asiáticos".split(),
    "musulmán cristiano judío hindú budista ateo".split(),
    "musulmana cristiana judía".split(),
    "musulmanes cristianos judíos hindúes budistas ateos".split(),
    "americano mexicano chino africano europeo indio árabe".split(),
    "americana mexicana china africana europea india".split(),
    "viejo joven anciano".split(),
    "viejos jóvenes ancianos".split(),
    "ciego sordo discapacitado".split(),
]
_SWAP: dict[str, str] = {}
for _kind in IDENTITY:  # a term of several languages or kinds has the partner of the first
    for _i, _t in enumerate(_kind):
        _SWAP.setdefault(_t, _kind[(_i + 1) % len(_kind)])
_TERM = re.compile(r"(?<!\w)(" + "|".join(sorted(_SWAP, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)


def swap(text: str) -> str:
    """The text with each identity term exchanged for the next one of its kind. A word that is equal to a term only by Unicode's
    folding, such as one with a long s or a dotted capital I, isn't one of them and stays."""
    return _TERM.sub(lambda m: _SWAP.get(m[0].lower(), m[0]), text)


def _rows(texts: list[str]) -> list[bytes]:
    out: list[bytes] = []
    for _i, _j, data, off in chunks(pa.array(texts, pa.large_string())):
        places, bounds = lexical(Words(data, off))
        out += [places[i:j].astype(np.int32).tobytes() for i, j in zip(bounds[:-1], bounds[1:])]
    return out


def _examples(batches):
    """(y, features, features of the swapped twin; null if nothing was swapped)"""
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        twins = [swap(t) for t in texts]
        at = [i for i, (s, t) in enumerate(zip(texts, twins)) if s != t]
        other: list[bytes | None] = [None] * len(texts)
        for i, r in zip(at, _rows([twins[i] for i in at])):
            other[i] = r
        cols = [pa.array(_rows(texts), pa.binary()), pa.array(other, pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), *cols], names=["h", "y", "x", "twin"])


class Sparse:
    """Rows of distinct features, over the given ones or those that occur at all."""

    def __init__(self, rows: list[bytes], names: np.ndarray | None = None) -> None:
        raw = np.frombuffer(b"".join(rows), np.int32)
        self.names = np.unique(raw) if names is None else names
        place = np.full(DIM, -1, np.int32)
        place[self.names] = np.arange(len(self.names))
        col = place[raw]
        on = col >= 0
        self.col = col[on]
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) >> 2 for r in rows])[on]
        self.bounds = np.searchsorted(self.row, np.arange(len(rows) + 1))

    def score(self, w: np.ndarray) -> np.ndarray:
        return sums(w[self.col], self.bounds)

    def gradient(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], minlength=len(self.names))


def counted(rows: list[bytes]) -> np.ndarray:
    """In how many rows each feature occurs."""
    n = np.zeros(DIM, np.int64)
    for i in range(0, len(rows), 1024):
        n += np.bincount(np.frombuffer(b"".join(rows[i : i + 1024]), np.int32), minlength=DIM)
    return n


def fit(y: np.ndarray, x: list[bytes], twin: list[bytes | None], rounds: int = 150, ridge: float = 2e-5) -> tuple[np.ndarray, float]:
    """(weights of all DIM features, bias). Without examples of both kinds: no weights, and a bias towards the only kind or,
    without any, towards clean."""
    if not len(y) or y.min() == y.max():
        return np.zeros(DIM), (4.0 if len(y) and y[0] else -4.0)
    often = telling(counted(x), counted([r for r, one in zip(x, y) if one]), len(y), y.sum())
    moved = np.array([t is not None for t in twin])
    data, twins = Sparse(x, often), Sparse([a if t is None else t for a, t in zip(x, twin)], often)
    cost = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, b = Adagrad(len(often), 0.15), Adagrad(1, 0.15)
    for _ in range(rounds):
        p = sigmoid(data.score(w.w) + b.w)
        g, gt = cost * (p - y) / len(y), np.zeros(len(y))
        if moved.any():
            q = sigmoid(twins.score(w.w) + b.w)
            change = 2 * COUNTERFACTUAL * np.where(moved, p - q, 0.0) / len(y)
            g, gt = g + change * p * (1 - p), -change * q * (1 - q)
        w.step(data.gradient(g) + (twins.gradient(gt) if moved.any() else 0) + ridge * w.w)
        b.step(np.array([g.sum() + gt.sum()]))
    out = np.zeros(DIM)
    out[often] = w.w
    return out, float(b.w[0])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fits on labels (doc_id, toxic) of rows with crc32(doc_id) mod 3 other than 1. Labels other than 0 and 1 are ignored."""
    with scratch(docs.sparkSession):
        known = labels.where("toxic in (0, 1)").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
        known = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
        rows = save(rows.select(F.xxhash64("doc_id").alias("h"), "y", "text").mapInArrow(_examples, "h long, y double, x binary, twin binary"), "examples")
        size = F.octet_length("x") + F.coalesce(F.octet_length("twin"), F.lit(0))
        last, held = None, 0
        for r in rows.select("h", size.alias("n")).orderBy("h").collect():  # SAMPLE rows
            held += r.n
            if held > SAMPLE_BYTES and last is not None:
                break
            last = r.h
        got = rows.where(F.col("h") <= (last or 0)).drop("h").toArrow().to_pydict() if last is not None else {"y": [], "x": [], "twin": []}
    out = _fitted(got)
    del got
    trim()  # the sample's rows: the driver keeps none of them
    return out


def _fitted(got: dict) -> tuple[np.ndarray, float]:
    order = sorted(range(len(got["y"])), key=lambda i: (got["x"][i], got["y"][i]))
    return fit(np.array([got["y"][i] for i in order]), [got["x"][i] for i in order], [got["twin"][i] for i in order])


def _score(spark, weights: np.ndarray, bias: float):
    held = spark.sparkContext.broadcast(weights.astype(np.float32))  # 4 MB, whatever the corpus

    def run(batches):
        w = held.value
        used = w != 0
        for b in batches:
            trim()
            out = np.zeros(len(b))
            for i, j, data, off in chunks(b.column("text"), 1 << 20):
                places, bounds = lexical(Words(data, off), used)
                out[i:j] = sigmoid(sums(w[places], bounds) + bias)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), pa.array(out)], names=[*(c for c in b.schema.names if c != "text"), "score"])

    return run


@tidy
def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (its label was not learnt from), score (0 to 1), predicted (1 if score >= 0.7): one row for each row
    of docs (doc_id, text; other columns are ignored).

    Null and empty texts get the score of a text without features. Without labels of both kinds all texts get one score.
    Repeated labels of a doc_id count once, toxic if any is; of texts with one doc_id the least is learnt from. held_out is null for rows without doc_id. Empty table: no rows.
    """
    weights, bias = train(docs, labels)
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_score(docs.sparkSession, weights, bias), f"doc_id {kind}, score double")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they are."""
    weights, bias = train(docs, labels)
    run = _score(docs.sparkSession, weights, bias)

    def keep(batches):
        for b in batches:
            s = next(run(iter([b.select(["text"])]))).column("score").to_numpy()
            yield b.filter(pa.array(s < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
