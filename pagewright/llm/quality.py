"""Quality by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled texts are told apart by an additive model over binned style features. It minimises
the non-negative unbiased risk (Kiryo et al., 2017): prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); labels 0 are never
used. The class prior is estimated as the least ratio of the shares of unlabelled and positive texts among those that look
most positive, where hardly any negative is left.

It is fitted on the driver on at most SAMPLE positives and SAMPLE unlabelled documents, those with the smallest hash of doc_id;
only their style numbers are sent there, one row for each doc_id. Weights shrink by SHRINK over the number of positives, chosen
by validation on one of the learnt folds, so a small sample isn't learnt by heart. Every whole text is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import Adagrad, sigmoid, style
from .kernel import Words, chunks

SAMPLE = 10_000
BINS = 24
THRESHOLD = 0.3
STYLES = 12
SHRINK = 3.0


class Bins:
    """One indicator per feature and bin; bins are cut at quantiles of the unlabelled texts and at zero."""

    def __init__(self, x: np.ndarray) -> None:
        q = np.linspace(0, 1, BINS + 1)[1:-1]
        tails = [0.002, 0.005, 0.01, 0.99, 0.995, 0.998]
        self.edges = [np.unique(np.concatenate([[1e-12], np.quantile(c, np.concatenate([q, tails]))])) for c in x.T]
        self.start = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])

    def at(self, x: np.ndarray) -> np.ndarray:
        return np.stack([s + np.searchsorted(e, c, "right") for s, e, c in zip(self.start, self.edges, x.T)], 1)


def _fit(p: np.ndarray, u: np.ndarray, n: int, prior: float | None, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias; p and u hold places of indicators. prior None: plain positives against unlabelled."""
    w, b, ridge = Adagrad(n, 0.1), Adagrad(1, 0.1), SHRINK / len(p)

    def grad(rows, g):
        return np.bincount(rows.ravel(), np.repeat(g, rows.shape[1]), minlength=n)

    for _ in range(rounds):
        zp, zu = w.w[p].sum(1) + b.w, w.w[u].sum(1) + b.w
        sp, su = sigmoid(zp), sigmoid(zu)
        if prior is None:
            gp, gu = (sp - 1) / len(p), su / len(u)
        else:
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if rest >= 0:
                gp, gu = prior * (sp - 1) / len(p) - prior * sp / len(p), su / len(u)
            else:  # the estimate of the negatives' risk is below zero: step back from it
                gp, gu = prior * sp / len(p), -su / len(u)
        w.step(grad(p, gp) + grad(u, gu) + ridge * w.w)
        b.step(np.array([gp.sum() + gu.sum()]))
    return w.w, float(b.w[0])


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled from scores of both: least ratio of upper tails, each with half of the
    positives at least, and with a standard error added."""
    cuts = np.quantile(p, np.linspace(0.0, 0.5, 26))
    fu, fp = np.array([(u >= c).mean() for c in cuts]), np.array([(p >= c).mean() for c in cuts])
    ratio = fu / fp + np.sqrt(fu * (1 - fu) / len(u)) / fp
    return float(np.clip(ratio.min(), 0.05, 0.99))


def _styles(batches):
    for b in batches:
        out = np.zeros((len(b), STYLES))
        for i, j, data, off in chunks(b.column("text")):
            out[i:j] = style(Words(data, off))[:, :STYLES]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *(pa.array(c) for c in out.T)], names=["doc_id", "y", *(f"f{i}" for i in range(STYLES))])


def _bucket(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Bins | None, np.ndarray, float]:
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    good = labels.where("quality = 1").where(_bucket() != 0).select("doc_id").distinct().orderBy(*order).limit(SAMPLE)
    free = docs.where(_bucket() != 0).select("doc_id").distinct().orderBy(*order).limit(SAMPLE)
    ids = good.withColumn("y", F.lit(1)).union(free.withColumn("y", F.lit(0)))  # 2 * SAMPLE rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(_styles, "doc_id long, y int, " + ", ".join(f"f{i} double" for i in range(STYLES))).toPandas()
    got = got.sort_values(list(got.columns)).to_numpy(dtype=float)
    p, u = got[got[:, 1] == 1][:, 2:], got[got[:, 1] == 0][:, 2:]
    if not len(p) or not len(u):
        return None, np.zeros(0), 0.0
    bins = Bins(u)
    n = int(bins.start[-1])
    bp, bu = bins.at(p), bins.at(u)
    w, b = _fit(bp, bu, n, None, 150)
    prior = class_prior(w[bp].sum(1) + b, w[bu].sum(1) + b)
    return (bins, *_fit(bp, bu, n, prior))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (its label was not learnt from), score (0 to 1, higher: better), predicted (1 if score >= 0.3): one
    row for each row of docs (doc_id, text; other columns are ignored).

    Null and empty texts are scored by their zeros. Without trusted positives every score is 0.5. Repeated labels count
    once; of texts with one doc_id the least is learnt from. held_out is null for rows without doc_id, which are scored like others. Empty table: no rows.
    """
    bins, w, b = train(docs, labels)

    def run(batches):
        for batch in batches:
            out = np.full(len(batch), 0.5)
            for i, j, data, off in chunks(batch.column("text")) if bins else ():
                out[i:j] = sigmoid(w[bins.at(style(Words(data, off))[:, :STYLES])].sum(1) + b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (_bucket() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
