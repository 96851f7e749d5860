"""Hashed text features and sparse linear models, shared by the two classifiers.

A text's features are its distinct words (A-Z lower-cased, punctuation at both ends left out) and their prefixes of three to
eight bytes, hashed to DIM places, and STYLE numbers about how it is written. Scores never see labels, lang, source or ids.
"""

from __future__ import annotations

import numpy as np

from .kernel import SPACE, Words, mix, seeds, sort_within, windows

BITS = 20
DIM = 1 << BITS
_U = np.uint64
_SALT = seeds(21, 16)
PREFIXES = range(3, 9)
_KIND = {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&|<>", "shout": b"!?", "stop": b".,;:", "quote": b"\"'()[]{}/\\_=+~^`@-"}
_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
STYLE = [*_KIND, "space", "length", "word", "distinct", "repeated", "longest"]


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of words without the punctuation at their ends (three bytes at most); a word of punctuation is empty."""
    a, b = w.start.copy(), w.end.copy()
    for _ in range(3):
        at = a < b
        a += at & _EDGE[w.data[np.minimum(a, max(0, len(w.data) - 1))]]
        at = a < b
        b -= at & _EDGE[w.data[np.maximum(b - 1, 0)]]
    return a, b


def lexical(w: Words, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, bounds): sorted distinct features of text i at places[bounds[i]:bounds[i + 1]]; of those, if given, for
    which only[place] holds."""
    a, b = tokens(w)
    doc = w.doc
    got, of = [], []
    for n in (0, *PREFIXES):
        use = np.flatnonzero(b - a > n)
        end = b[use] if n == 0 else a[use] + n
        with np.errstate(over="ignore"):
            place = mix(w.slices(a[use], end) ^ _SALT[n]) >> _U(64 - BITS)
        if only is not None:
            hit = np.flatnonzero(only[place])
            use, place = use[hit], place[hit]
        got.append(place)
        of.append(doc[use])
    x = (np.concatenate(of).astype(_U) << _U(BITS)) | np.concatenate(got)
    x.sort()
    if len(x):
        x = x[np.concatenate([[True], x[1:] != x[:-1]])]
    return (x & _U(DIM - 1)).astype(np.int64), np.searchsorted(x, np.arange(w.n_docs + 1, dtype=_U) << _U(BITS))


def style(w: Words) -> np.ndarray:
    """One row of STYLE for each text; shares lie between 0 and 1, empty texts have zeros."""
    n = np.maximum(1, np.diff(w.off)).astype(float)
    words = np.maximum(1, w.count).astype(float)

    def per_text(flags: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(flags)])
        return s[w.off[1:]] - s[w.off[:-1]]

    out = []
    for chars in _KIND.values():
        t = np.zeros(256, bool)
        t[list(chars)] = True
        out.append(per_text(t[w.data]) / n)
    out.append(per_text(SPACE[w.data]) / n)
    out.append(np.log1p(w.count) / 10)
    length = np.concatenate([[0], np.cumsum(w.end - w.start)])
    mean = (length[w.at[1:]] - length[w.at[:-1]]) / words
    out.append(np.minimum(mean, 50) / 50)
    h = w.hashes()
    s = sort_within(h, w.at)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[w.at[:-1][w.at[:-1] < len(s)]] = True
    c = np.concatenate([[0], np.cumsum(new)])
    out.append((c[w.at[1:]] - c[w.at[:-1]]) / words)
    g, _, per = windows(h, w.at, w.count, 3)
    b = np.concatenate([[0], np.cumsum(per)])
    g = sort_within(g, b)
    same = np.zeros(len(g), bool)
    same[1:] = g[1:] == g[:-1]
    same[b[:-1][b[:-1] < len(g)]] = False
    c = np.concatenate([[0], np.cumsum(same)])
    out.append((c[b[1:]] - c[b[:-1]]) / np.maximum(1, per))
    size = w.end - w.start
    longest = np.zeros(w.n_docs)
    full = np.flatnonzero(w.count)
    if len(full):
        longest[full] = np.maximum.reduceat(size, w.at[:-1][full])
    out.append(np.log1p(longest) / 10)
    return np.stack(out, 1)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    s = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return s[bounds[1:]] - s[bounds[:-1]]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Adagrad:
    """Full-batch steps with a rate for each weight."""

    def __init__(self, shape, rate: float) -> None:
        self.w, self.g2, self.rate = np.zeros(shape), np.full(shape, 1e-8), rate

    def step(self, g: np.ndarray) -> None:
        self.g2 += g * g
        self.w -= self.rate * g / np.sqrt(self.g2)


def telling(all_: np.ndarray, pos: np.ndarray, n: int, n1: float, least: int = 5, z: float = 4.5) -> np.ndarray:
    """Which features occur in ``least`` of n rows or more and differ between the kinds by z standard errors, from their counts in
    all rows and in the n1 rows of kind 1: rare words that a sample happens to hold in one kind only aren't learnt."""
    p = all_ / n
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / (n - n1)))
    return np.flatnonzero((all_ >= least) & (np.abs(pos / n1 - (all_ - pos) / (n - n1)) >= z * error))
