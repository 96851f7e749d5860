"""Quality rules: fixed limits, then robust multivariate outliers by language and source.

Each text gives a vector of transformed statistics. For each (lang, source) the minimum-covariance-determinant estimate is
found by concentration steps over all its documents: each step keeps the H share of documents with the smallest distances and
takes their mean and covariance. They begin at STARTS (medians, all documents, spatial signs) and go on until no
determinant falls; the least of a group is taken. Documents whose Mahalanobis distance is beyond a far quantile of its
chi-squared law are rejected.

Counts and moments are sums of integers, so results don't depend on the order of rows, and are pre-aggregated before each
shuffle: a hot group fills no task. Only one row for each group and start, not documents, meets in Python to invert its
matrix. Groups with fewer than LEAST documents, too few for a covariance of P dimensions, are judged by the estimate of all
documents of their language, and those of languages with as few by that of all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import Words, chunks, windows
from .store import save, tidy

P = 5
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
UNIT = 1024  # statistics are held in units of 1 / UNIT
H, LEAST = 0.75, 30
STARTS = 3
FALLS = 1e-3  # a determinant that falls by a smaller share stands still
FLOOR = 0.15  # least standard deviation of a statistic
# Fixed values of the chi-squared law with 5 degrees of freedom: the quantile at 0.75, one beyond which 5e-7 lie; P(chi2_7 <= first).
CHI_H, CHI_FAR, CHI7_H = 6.6257, 37.3325, 0.5313
BROADCAST = 1 << 16  # groups; beyond, their estimates are joined by a shuffle
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _counts(batches):
    for b in batches:
        for i, j, data, off in chunks(b.column("text")):
            c = counts(data, off)
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in ("doc_id", "lang", "source")), *(pa.array(x.astype(np.int64)) for x in c)], names=["doc_id", "lang", "source", *BASE])


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """BASE of each text."""
    w = Words(data, off, fold=False)

    def per_text(flags: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(flags)])
        return s[off[1:]] - s[off[:-1]]

    point = (data & 0xC0) != 0x80
    space = (data == 32) | ((data >= 9) & (data <= 13))
    chars, symbols = per_text(point & ~space), per_text(_SYMBOL[data])

    h = w.hashes()
    g, first, per = windows(h, w.at, w.count, 5)
    bounds = np.concatenate([[0], np.cumsum(per)])
    repeated = np.zeros(len(h) + 1, np.int32)
    if len(g):
        doc = np.repeat(np.arange(len(per)), per)
        order = np.lexsort((g, doc))
        gs, ds = g[order], doc[order]
        same = (gs[1:] == gs[:-1]) & (ds[1:] == ds[:-1])
        twice = np.zeros(len(g), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = first[order[twice]]
        np.add.at(repeated, hit, 1)
        np.add.at(repeated, hit + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(repeated[:-1]) > 0)])
    n_repeat = covered[w.at[1:]] - covered[w.at[:-1]]

    # lines with a word: pieces between \n
    ends = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([off[:-1], ends + 1]))
    start = start[start < len(data)]
    dup = np.zeros(len(off) - 1, np.int64)
    if len(start):
        text = np.searchsorted(off, start, "right") - 1
        nxt = np.append(start[1:], len(data))
        stop = np.where((data[nxt - 1] == 10), nxt - 1, nxt)
        words = np.searchsorted(w.start, stop) - np.searchsorted(w.start, start)
        use = words > 0
        line, t = w.slices(start[use], stop[use]), text[use]
        order = np.lexsort((line, t))
        ls, ts = line[order], t[order]
        dup += np.bincount(ts[1:][(ls[1:] == ls[:-1]) & (ts[1:] == ts[:-1])], minlength=len(dup))
    return [w.count, chars, symbols, dup, n_repeat]


def _vector() -> list:
    """The transformed statistics, in units."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    raw = (F.log1p("n_words"), 3 * F.log(chars / words), F.log1p(10 * F.col("n_symbols") / chars), F.log1p("n_dup_lines") / 2, F.sqrt(F.col("n_repeat_words") / words))
    return [F.round(x * UNIT).cast("long").alias(n) for x, n in zip(raw, X)]


_PARAMS = "grp string, start int, det double, " + ", ".join(f"m{i} double" for i in range(P)) + ", " + ", ".join(f"v{i}{j} double" for i, j in PAIRS)


def _row(grp: str, start: int, mean: np.ndarray, cov: np.ndarray, scale: float = 1.0) -> list:
    """det is that of the covariance with the least deviations; scale makes it consistent."""
    cov = cov + np.diag(np.maximum(0, FLOOR**2 - np.diag(cov)) + 1e-6)
    inv = np.linalg.inv(cov * scale)
    return [grp, start, float(np.linalg.det(cov)), *mean.tolist(), *(float(inv[i, j]) * (1 if i == j else 2) for i, j in PAIRS)]


def _frame(rows: list[list]):
    import pandas as pd

    return pd.DataFrame(rows, columns=[f.split()[0] for f in _PARAMS.split(", ")])


def _start(pdf):
    """Median and median deviation of each statistic, from its histogram."""
    mean, scale = np.zeros(P), np.full(P, FLOOR)
    for i in range(P):
        h = pdf[pdf.dim == i].sort_values("bin")
        v, n = h.bin.to_numpy() * 16.0 / UNIT, h.n.to_numpy()
        mean[i] = v[np.searchsorted(np.cumsum(n), n.sum() / 2)]
        d = np.abs(v - mean[i])
        order = np.argsort(d, kind="stable")
        scale[i] = max(FLOOR, 1.4826 * d[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])
    return _frame([_row(pdf.grp.iloc[0], 0, mean, np.diag(scale**2))])


def _estimates(batches):
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            mean = np.array([getattr(r, x) for x in X]) / r.n / UNIT
            cov = np.zeros((P, P))
            for i, j in PAIRS:
                cov[i, j] = cov[j, i] = getattr(r, f"s{i}{j}") / r.n / UNIT**2 - mean[i] * mean[j]
            rows.append(_row(r.grp, r.start, mean, cov, H / CHI7_H))
        yield _frame(rows)


def _signs(batches):
    """Starts from the spatial signs: medians, and the covariance of the directions in which documents lie from them."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            mean, scale = np.array([getattr(r, f"m{i}") for i in range(P)]), np.array([getattr(r, f"v{i}{i}") for i in range(P)]) ** -0.5
            cov = np.zeros((P, P))
            for i, j in PAIRS:
                cov[i, j] = cov[j, i] = P * getattr(r, f"s{i}{j}") / r.n / UNIT**2 * scale[i] * scale[j]
            rows.append(_row(r.grp, r.start, mean, cov))
        yield _frame(rows)


def _small(df: DataFrame, few: bool) -> DataFrame:
    """df has STARTS rows or so for each group: sent to all tasks if there are at most BROADCAST groups."""
    return F.broadcast(df) if few else df


def _moments(rows: DataFrame) -> DataFrame:
    """Sums of the statistics and their products for each group and start."""
    return rows.groupBy("grp", "start").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(x) for x in X), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in PAIRS))


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """STARTS estimates of each group, to begin with."""
    each = F.posexplode(F.array(*X)).alias("dim", "x")
    hist = rows.select("grp", each).groupBy("grp", "dim", F.floor(F.col("x") / 16).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    medians = save(hist.groupBy("grp").applyInPandas(_start, _PARAMS), "estimate")
    every = _moments(rows.withColumn("start", F.lit(1))).mapInPandas(_estimates, _PARAMS)
    d = [(F.col(x) / UNIT - F.col(f"m{i}")) * F.sqrt(F.col(f"v{i}{i}")) for i, x in enumerate(X)]
    far = F.sqrt(sum((x * x for x in d), F.lit(0.0)))
    signs = rows.join(_small(medians.drop("start"), few), "grp").select("grp", F.lit(2).alias("start"), *(F.coalesce(F.round(UNIT * x / F.nullif(far, F.lit(0.0))), F.lit(0.0)).cast("long").alias(n) for x, n in zip(d, X)))
    known = medians.select("grp", *(f"m{i}" for i in range(P)), *(f"v{i}{i}" for i in range(P)))
    signs = _moments(signs).join(known, "grp").mapInPandas(_signs, _PARAMS)
    return save(medians.unionByName(every).unionByName(signs), "estimate")


def _step(rows: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """Estimates of the H share of documents that are nearest by params."""
    key = ["grp", "start"]
    placed = rows.join(_small(params, few), "grp").withColumn("bin", F.floor(F.log2(_distance() + 0.001) * 32))
    bins = placed.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    cut = bins.select(*key, "bin", F.coalesce(upto, F.lit(0)).alias("below"), F.sum("n").over(Window.partitionBy(*key)).alias("all"))
    cut = cut.where(F.col("below") < H * F.col("all")).groupBy(*key).agg(F.max("bin").alias("last"))
    near = placed.join(_small(cut, few), key).where(F.col("bin") <= F.col("last"))
    return save(_moments(near).mapInPandas(_estimates, _PARAMS), "estimate")


def estimates(rows: DataFrame, few: bool = False) -> DataFrame:
    """One row of _PARAMS for each group of rows (grp, X): of all starts and steps, the one with the least determinant.

    A start rests once its determinant doesn't fall. Estimates stay in tables, which are joined with the ones before; the driver only
    learns whether any fell. few tells that there are few groups, so that estimates may be broadcast."""
    key = ["grp", "start"]
    least = params = _step(rows, _starts(rows, few), few)
    while True:
        known = least.select(*key, F.col("det").alias("was"))
        fell = _step(rows, params, few).join(_small(known, few), key).where(F.col("det") < F.col("was") * (1 - FALLS))
        params = save(fell.select(*least.columns), "falling")
        if params.isEmpty():
            break
        least = save(least.join(_small(params.select(*key), few), key, "left_anti").unionByName(params), "least")
    best = least.groupBy("grp").agg(F.min_by(F.struct(*least.columns), F.struct("det", "start")).alias("r"))
    return save(best.select("r.*"), "best")


def _distance():
    d = [F.col(x) / UNIT - F.col(f"m{i}") for i, x in enumerate(X)]
    return sum((F.col(f"v{i}{j}") * d[i] * d[j] for i, j in PAIRS), F.lit(0.0))


@tidy
def checked(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (n_words < 10 or 100 *
    n_repeat_words > 20 * n_words), kept (false if base_failed, else whether the text is no outlier), distance (null if
    base_failed): one row for each row of docs (doc_id, text, lang, source; other columns are ignored).

    Null texts have no words. A null lang or source is one of its own. Rows that repeat count as often as they occur.
    Estimates use the documents that don't fail the base rules. Empty table: no rows.
    """
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in BASE)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("string").alias("text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    light = save(cols.mapInArrow(_counts, schema).withColumn("base_failed", failed).select("*", *_vector()), "statistics")
    good = light.where("not base_failed")

    sizes = save(good.groupBy("lang", "source").count(), "sizes")
    own = F.concat_ws("\t", "lang", "source")
    spoken = F.sum("count").over(Window.partitionBy("lang"))
    group = F.when(F.col("count") >= LEAST, own).when(spoken >= LEAST, F.concat(F.lit("lang\t"), F.col("lang"))).otherwise(F.lit("all"))
    named = save(sizes.select(F.col("lang").alias("l"), F.col("source").alias("s"), group.alias("grp")), "groups")
    few = named.count() <= BROADCAST
    small = lambda df: F.broadcast(df) if few else df
    same = (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s"))
    # a document counts in the estimate of its group, and in the wider ones that some small group takes
    wide = {r.grp for r in named.where("grp = 'all' or grp like 'lang\t%'").select("grp").distinct().collect()}
    rows = good.join(small(named), same).select("lang", "grp", *X).where(~F.col("grp").isin("all") & ~F.col("grp").startswith("lang\t")).select("grp", *X)
    spoken_by = [g[5:] for g in wide if g != "all"]
    if spoken_by:
        rows = rows.union(good.where(F.col("lang").isin(spoken_by)).select(F.concat(F.lit("lang\t"), F.col("lang")), *X))
    if "all" in wide:
        rows = rows.union(good.select(F.lit("all"), *X))
    rows = save(rows, "vectors")

    params = estimates(rows, few)

    out = light.join(small(named), same, "left").join(small(params), "grp", "left")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return out.select("doc_id", *BASE, "base_failed", F.coalesce(~F.col("base_failed") & (F.col("distance") <= CHI_FAR), F.lit(False)).alias("kept"), "distance")
