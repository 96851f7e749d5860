"""Removal of byte strings that an earlier document holds, by sorted suffixes.

A byte goes if a WIDTH-byte string (50) that covers it also starts in a document with a smaller doc_id. Sorting every suffix of
the corpus would move many times the input, so suffixes are first narrowed down, without losing a match:

1. In each run of SPAN consecutive GRAM-byte strings the one with the least hash is an anchor (winnowing). Equal 50-byte
   strings have equal anchors at equal places. Documents are dealt into groups; a group posts each of its anchors' contexts
   once (a context: all bytes that a 50-byte string through the anchor can reach), as hashes only.
2. Where documents of different ids share a gram, the groups send the bytes of its contexts, once for each group that holds
   them. A gram in more than SPLIT contexts is dealt on by the bytes next to it: a 50-byte string holds 15 bytes before
   or 15 bytes behind its gram, so each context goes to two of many places and no match is lost.
3. Contexts, and the 50-byte suffixes of those that share enough with another, are sorted deep-shallow: multikey quicksort,
   with characters of 64 bits, to a shallow depth; groups that are still tied are ordered by blind tries. Runs of equal
   suffixes tell which of them a smaller document holds. Hashes never settle a match: inside a group bytes are compared.

Documents are exchanged once by group, compressed; three steps read that one exchange. What is told between the steps is
aligned with the group's own sorted list of contexts, so it takes one byte or four for each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import columns, given_back, mix, runs, seeds, trim
from .store import pieces, text_bytes

WIDTH, GRAM = 50, 20
SPAN = WIDTH - GRAM + 1  # grams in a string
BACK = SPAN - 1  # bytes of context before an anchor; WIDTH follow from its start
REACH = BACK + WIDTH
HALF = BACK // 2
SHALLOW, SMALL = 40, 64  # bytes; groups of SMALL rows are sorted at once
SPLIT = 1 << 16
GROUP_BYTES, BUCKET_BYTES, RUN_BYTES, TASKS = 6 << 20, 12 << 20, 1 << 18, 1 << 14
PART, TURN = 1 << 16, 6000  # contexts that are sorted together, and whose strings are; more, if one gram has more
_U, _W = np.uint64, np.uint32
_BYTE32 = (seeds(11, 256) >> _U(16)).astype(_W)
_CTX = seeds(12, REACH // 8 + 4)
H_BYTES, C_BYTES = 5, 6
SENT_BYTES = 8 + 1 + 1 + REACH


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True) if raw else b""


def unsqueezed(raw: bytes) -> bytes:
    return pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True) if raw else b""


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each n consecutive values."""
    have = 1
    while have * 2 <= n:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def anchors(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start of each anchor in texts that lie end to end; texts shorter than WIDTH have none."""
    if len(data) < WIDTH:
        return np.zeros(0, np.int64)
    h = _BYTE32[data]
    have, mul = 1, int(0x9E3779B1)
    parts = {1: h}
    while have * 2 <= GRAM:
        h = h[:-have] * _W(mul) + h[have:]
        mul = mul * mul & 0xFFFFFFFF
        have *= 2
        parts[have] = h
    rest = GRAM - have
    at = have
    while rest:
        take = 1 << (rest.bit_length() - 1)
        h = h[: len(data) - at - take + 1] * _W(0x85EBCA6B) + parts[take][at : at + len(h)]
        at, rest = at + take, rest - take
    h = h[: len(data) - GRAM + 1]
    h = (h ^ (h >> _W(15))) * _W(0x2C1B3C6D) | _W(1)
    low = _slide(h, SPAN, np.minimum)  # one for each start of a WIDTH-byte string
    size = np.diff(off)
    ok = np.zeros(len(data) + 1, np.int8)
    full = size >= WIDTH
    ok[off[:-1][full]] += 1
    ok[off[1:][full] - WIDTH + 1] -= 1
    low[np.cumsum(ok)[: len(low)] == 0] = 0
    pad = np.zeros(BACK, _W)
    best = _slide(np.concatenate([pad, low, pad]), SPAN, np.maximum)
    return np.flatnonzero((best == h) & (best > 0))


def reaches(data: np.ndarray) -> np.ndarray:
    """The REACH bytes around each place of a text, zeros beyond it; a view."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(BACK, np.uint8), data, np.zeros(WIDTH + 8, np.uint8)]), REACH)


def bounded(view: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The contexts of places: zeros where another text begins."""
    ctx, col = view[at], np.arange(REACH)
    edge = np.flatnonzero((left < BACK) | (right < WIDTH))
    if len(edge):
        ctx[edge] *= ((col >= BACK - left[edge, None].astype(int)) & (col < BACK + right[edge, None].astype(int))).astype(np.uint8)
    return ctx


def contexts(data: np.ndarray, off: np.ndarray, at: np.ndarray):
    """(gram hash, context hash, text, bytes before, bytes after) of anchors."""
    text = np.searchsorted(off, at, "right") - 1
    left = np.minimum(at - off[text], BACK)
    right = np.minimum(off[text + 1] - at, WIDTH)
    ctx = bounded(reaches(data), at, left, right)
    with np.errstate(over="ignore"):
        gram = np.ascontiguousarray(ctx[:, BACK : BACK + GRAM])
        g = gram.view(_W).astype(_U) if GRAM % 8 else gram.view(_U)
        h = np.zeros(len(at), _U)
        for i in range(g.shape[1]):
            h = mix(h + g[:, i] * _CTX[i])
        wide = np.zeros((len(at), -(-REACH // 8) * 8), np.uint8)
        wide[:, :REACH] = ctx
        wide = wide.view(_U)
        c = left.astype(_U) * _CTX[-1] + right.astype(_U) * _CTX[-2]
        for i in range(wide.shape[1]):
            c = mix(c + wide[:, i] * _CTX[i])
    return h, c >> _U(64 - 8 * C_BYTES), text, left, right


def keyed(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each gram, its key: the bucket and H_BYTES more of the hash)."""
    b = ((h >> _U(32)) * _U(buckets)) >> _U(32)
    return b.astype(np.int64), (b << _U(8 * H_BYTES)) | (h & _U((1 << 8 * H_BYTES) - 1))


def both(k: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(k ^ (c * _U(0x9E3779B97F4A7C15)))


def _short(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n])


def _long(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def _pack(batches):
    """Documents (grp, doc_id, text, and rest if there is one) to one row for each group in a batch."""
    for b in batches:
        trim()
        if not len(b):
            continue
        grp = b.column("grp").to_numpy()
        order = np.argsort(grp, kind="stable")
        data, off = columns(b.column("text"))
        ids = b.column("doc_id")
        known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        groups, at = np.unique(grp[order], return_index=True)
        cut = np.append(at, len(grp))
        rows = []
        for i, j in zip(cut[:-1], cut[1:]):
            mine = order[i:j]
            raw = b"".join(data[off[r] : off[r + 1]].tobytes() for r in mine.tolist())
            rows.append((ids[mine].tobytes(), known[mine].tobytes(), (off[mine + 1] - off[mine]).tobytes(), squeezed(raw)))
        cols = [pa.array(groups.astype(np.int32)), *(pa.array([r[m] for r in rows], pa.binary()) for m in range(4))]
        names = ["grp", "ids", "known", "sizes", "data"]
        if "rest" in b.schema.names:
            cols.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), b.column("rest").take(pa.array(order))))
            names.append("rest")
        yield pa.RecordBatch.from_arrays(cols, names=names)
    trim()


class Group:
    """The documents of a group, and its contexts: distinct ones in the order (bucket, smallest holder, key, hash), which
    doesn't depend on the order of rows."""

    def __init__(self, table: pa.Table, buckets: int) -> None:
        join = lambda c: b"".join(table.column(c).to_pylist())
        self.ids, self.known = np.frombuffer(join("ids"), np.int64), np.frombuffer(join("known"), bool)
        self.off = np.concatenate([[0], np.cumsum(np.frombuffer(join("sizes"), np.int64))])
        self.data = np.frombuffer(b"".join(unsqueezed(x) for x in table.column("data").to_pylist()), np.uint8)
        self.grp = table.column("grp")[0].as_py() if len(table) else 0
        self.buckets = buckets
        got = []
        for i, j in runs(self.off, RUN_BYTES):
            d, o = self.data[self.off[i] : self.off[j]], self.off[i : j + 1] - self.off[i]
            at = anchors(d, o)
            for a in range(0, len(at), 1 << 16):
                p = at[a : a + (1 << 16)]
                h, c, text, left, right = contexts(d, o, p)
                use = self.known[i + text]
                got.append([x[use] for x in (h, c, self.ids[i + text], p + self.off[i], left.astype(np.uint8), right.astype(np.uint8))])
        none = (np.zeros(0, _U), np.zeros(0, _U), *(np.zeros(0, np.int64),) * 2, *(np.zeros(0, np.uint8),) * 2)
        h, c, self.doc, self.place, self.left, self.right = [np.concatenate(x) for x in zip(*got)] if got else none
        del got
        b, k = keyed(h, buckets)
        x = both(k, c)
        order = np.lexsort((self.doc, x))
        new = np.ones(len(x), bool)
        new[1:] = x[order[1:]] != x[order[:-1]]
        first = order[new]  # an anchor of the smallest holder
        rank = np.lexsort((c[first], k[first], self.doc[first], b[first]))
        self.first = first[rank]
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        self.entry = np.empty(len(x), np.int64)
        self.entry[order] = place[np.cumsum(new) - 1]
        self.bucket, self.k, self.c, self.least = b[self.first], k[self.first], c[self.first], self.doc[self.first]
        self.cut = np.searchsorted(self.bucket, np.arange(buckets + 1))
        self.view = reaches(self.data)

    def bytes_of(self, anchor: np.ndarray) -> np.ndarray:
        """Contexts of some anchors."""
        return bounded(self.view, self.place[anchor], self.left[anchor], self.right[anchor])

    def sends(self, codes: list[tuple[int, bytes]]):
        """(bucket, side, entries) of what is sent, from the codes told of each bucket: 1 sends to the bucket itself, 2 to the
        places of the bytes behind and before the gram."""
        code = np.zeros(len(self.first), np.uint8)
        for b, raw in codes:
            code[self.cut[b] : self.cut[b + 1]] = np.frombuffer(unsqueezed(raw), np.uint8)
        for side in range(3):
            at = np.flatnonzero(code == (1 if side == 0 else 2))
            if side == 0:
                to = self.bucket[at]
            else:
                a = BACK if side == 1 else BACK - HALF
                part = self.bytes_of(self.first[at])[:, a : a + GRAM + HALF]
                x = np.zeros(len(at), _U)
                for n in range(part.shape[1]):
                    x = mix(x + part[:, n] + _U(side))
                to = ((x >> _U(32)) * _U(self.buckets) >> _U(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            at, to = at[order], to[order]
            for i, j in zip(*(lambda c: (c[:-1], c[1:]))(np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to)))):
                if j > i:
                    yield int(to[i]), side, at[i:j]


def _post(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        trim()
        g, rows = Group(table, buckets), []
        for b in np.flatnonzero(np.diff(g.cut)).tolist():
            s = slice(g.cut[b], g.cut[b + 1])
            ids, n = np.unique(g.least[s], return_counts=True)
            rows.append((b, squeezed(ids.tobytes()), squeezed(n.astype("<i4").tobytes()), _short(g.k[s], H_BYTES).tobytes(), _short(g.c[s], C_BYTES).tobytes()))
        return _rows_of(g.grp, rows, _POST)

    return run


_POST = "grp int, bucket int, ids binary, n binary, h binary, c binary"
_TOLD = "grp int, bucket int, side int, codes binary, masks binary"


def _rows_of(grp: int, rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")][1:]
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.table([pa.array([grp] * len(rows), pa.int32()), *(pa.array([r[m] for r in rows], kinds[t]) for m, (_, t) in enumerate(fields))], names=["grp", *(n for n, _ in fields)])


def _meet(table: pa.Table) -> pa.Table:
    """All posts of a bucket to codes for the groups, one for each of their contexts: 0 if its gram is in documents of one id
    only, 1 if it is to be sent, 2 if its gram is in very many contexts."""
    trim()
    hs, docs = [], []
    for ids, n, h in zip(*(table.column(x).to_pylist() for x in ("ids", "n", "h"))):
        hs.append(_long(h, H_BYTES))
        docs.append(np.repeat(np.frombuffer(unsqueezed(ids), np.int64), np.frombuffer(unsqueezed(n), "<i4")))
    h, doc = np.concatenate(hs), np.concatenate(docs)
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]])) if len(h) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(h)))
    of = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first) if len(h) else np.zeros(0, bool)
    code = np.zeros(len(h), np.uint8)
    code[order] = np.repeat(np.where(of, np.where(n > SPLIT, 2, 1), 0), n)
    rows, groups, at = [], [], 0
    for g, b, mine in zip(table.column("grp").to_pylist(), table.column("bucket").to_pylist(), hs):
        own = code[at : at + len(mine)]
        at += len(mine)
        if own.any():
            groups.append(g)
            rows.append((b, 0, squeezed(own.tobytes()), b""))
    return _rows_of(0, rows, _TOLD).set_column(0, "grp", pa.array(groups, pa.int32()))


def _codes(told: pa.Table) -> list[tuple[int, bytes]]:
    return [(b, c) for b, c in zip(told.column("bucket").to_pylist(), told.column("codes").to_pylist()) if c]


def _send(buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        g, rows = Group(left if len(right) else left.slice(0, 0), buckets), []
        for to, side, entries in g.sends(_codes(right)) if len(left) else ():
            at = g.first[entries]
            # columns one behind the other compress better than records
            rows.append((to, side, squeezed(b"".join(np.ascontiguousarray(x[at]).tobytes() for x in (g.doc, g.left, g.right)) + g.bytes_of(at).tobytes())))
        return _rows_of(g.grp, rows, _SENT)

    return run


_SENT = "grp int, bucket int, side int, sent binary"


def _received(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, left, right, bytes) of what was sent."""
    x = np.frombuffer(unsqueezed(raw), np.uint8)
    n = len(x) // SENT_BYTES
    return x[: 8 * n].view(np.int64), x[8 * n : 9 * n], x[9 * n : 10 * n], x[10 * n :].reshape(n, REACH)


class BlindTrie:
    """Strings of one length, ordered by the first byte in which they differ. Only branching bytes are looked at on the way
    down; one comparison at the leaf then tells the true branching place. Equal strings share a leaf."""

    def __init__(self) -> None:
        self.root = None  # a leaf [string, members], or a node (depth, {byte: below})

    def add(self, s: bytes, member: int) -> None:
        if self.root is None:
            self.root = [s, [member]]
            return
        node = self.root
        while isinstance(node, tuple):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = node[0]
        if t == s:
            node[1].append(member)
            return
        d = next(i for i in range(len(s)) if s[i] != t[i])
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < d:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == d:
            node[1][s[d]] = [s, [member]]
            return
        split = (d, {t[d]: node, s[d]: [s, [member]]})
        if above is None:
            self.root = split
        else:
            above[1][s[above[0]]] = split

    def leaves(self) -> list[list[int]]:
        """Members of each leaf, in the order of the strings."""
        out, todo = [], [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.append(node[1])
        return out


def _median(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def deep_shallow(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, new) of the rows of a byte matrix: order sorts them; new tells where a row differs from the one before.

    Multikey quicksort: a segment is parted in three by a pivot character (the median of three); the equal part goes on with
    the next character, until SMALL rows are left or the shallow depth is reached. All open segments take a step together.
    """
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(_U)
    deep = min(shallow, width) // 8
    order, new = np.arange(n), np.ones(n, bool)
    start, size, depth = np.array([0]), np.array([n]), np.array([0])
    small, tied = [], []  # (start, size) of segments to be finished
    while len(start):
        at_depth = depth == deep
        few = ~at_depth & (size <= SMALL)
        tied.append(np.stack([start[at_depth], size[at_depth]]))
        small.append(np.stack([start[few], size[few]]))
        go = ~at_depth & ~few
        start, size, depth = start[go], size[go], depth[go]
        if not len(start):
            break
        seg = np.repeat(np.arange(len(start)), size)
        begin = np.concatenate([[0], np.cumsum(size)])
        where = np.arange(begin[-1]) - begin[seg] + start[seg]
        w = words[order[where], depth[seg]]
        pivot = _median(w[begin[:-1]], w[(begin[:-1] + begin[1:]) // 2], w[begin[1:] - 1])[seg]
        side = 1 + (w > pivot).astype(np.int64) - (w < pivot)
        count = np.bincount(seg * 3 + side, minlength=3 * len(start))
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        moved = np.empty(len(w), np.int64)
        for s in range(3):
            mine = np.flatnonzero(side == s)
            k = seg[mine]
            rank = np.arange(len(mine)) - np.searchsorted(k, k)  # in its segment, in order
            moved[first[k * 3 + s] + rank] = order[where[mine]]
        order[where] = moved
        starts = (first.reshape(-1, 3) - begin[:-1, None] + start[:, None]).ravel()
        depths = (depth[:, None] + np.array([0, 1, 0])).ravel()
        go = count > 1
        start, size, depth = starts[go], count[go], depths[go]
    start, size = np.concatenate(small, 1) if small else np.zeros((2, 0), np.int64)
    if len(start):
        seg = np.repeat(np.arange(len(start)), size)
        where = np.arange(len(seg)) - np.concatenate([[0], np.cumsum(size)])[seg] + start[seg]
        some = order[where]
        by = np.lexsort((*(words[some, d] for d in reversed(range(deep))), seg))
        order[where] = some = some[by]
        same = np.zeros(len(some), bool)
        same[1:] = (words[some[1:], :deep] == words[some[:-1], :deep]).all(1) & (seg[1:] == seg[:-1])
        first = np.flatnonzero(~same)
        length = np.diff(np.append(first, len(some)))
        tied.append(np.stack([where[first[length > 1]], length[length > 1]]))
    start, size = np.concatenate(tied, 1) if tied else np.zeros((2, 0), np.int64)
    tails = np.ascontiguousarray(rows[:, deep * 8 :])
    if len(start):
        seg = np.repeat(np.arange(len(start)), size)
        where = np.arange(len(seg)) - np.concatenate([[0], np.cumsum(size)])[seg] + start[seg]
        differ = np.zeros(len(seg), bool)
        differ[1:] = (tails[order[where[1:]]] != tails[order[where[:-1]]]).any(1) & (seg[1:] == seg[:-1])
        new[where] = False
        new[start] = True
        for s in np.unique(seg[differ]).tolist():
            a, trie = int(start[s]), BlindTrie()
            for m in order[a : a + size[s]].tolist():
                trie.add(tails[m].tobytes(), m)
            for leaf in trie.leaves():
                order[a : a + len(leaf)] = leaf
                new[a] = True
                a += len(leaf)
    return order, new


def _likest(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the row most like it, a neighbour in sorted order."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        same = rows[order[1:]] == rows[order[:-1]]
        n = np.where(same.all(1), rows.shape[1], same.argmin(1))
        out[order[1:]] = n
        out[order[:-1]] = np.maximum(out[order[:-1]], n)
    return out


def _full(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Mask of all strings of a context: bit i is the one that starts i bytes into its reach."""
    n = np.maximum(left.astype(np.int64) + right - WIDTH + 1, 0)
    return (((_U(1) << n.astype(_U)) - _U(1)) << (BACK - left.astype(np.int64)).astype(_U)).astype(_W)


def held(doc: np.ndarray, left: np.ndarray, right: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Masks of contexts: which of their strings a smaller document among them holds."""
    mask = np.zeros(len(doc), _W)
    if not len(doc):
        return mask
    # equal contexts: all but the smallest holder lose every string
    order, new = deep_shallow(np.hstack([raw[:, BACK:], left[:, None], right[:, None], raw[:, :BACK][:, ::-1]]))
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], first)[np.cumsum(new) - 1]
    later = order[doc[order] > least]
    mask[later] = _full(left[later], right[later])
    # one of each kind of context, still sorted by what follows from the anchor
    one = order[np.lexsort((doc[order], np.cumsum(new)))][new]
    rows = np.ascontiguousarray(raw[one])
    place = np.arange(len(one))
    on = np.minimum(_likest(rows[:, BACK:], place), right[one])
    gram = np.cumsum(np.concatenate([[True], (rows[1:, BACK : BACK + GRAM] != rows[:-1, BACK : BACK + GRAM]).any(1)]))
    lead = np.ascontiguousarray(gram.astype(">u8")).view(np.uint8).reshape(-1, 8)
    before = np.hstack([lead, rows[:, :BACK][:, ::-1]])
    back = np.clip(_likest(before, deep_shallow(before, 24)[0]) - 8, 0, left[one])
    at = np.flatnonzero(on + back >= WIDTH)
    # equal strings have equal anchors, so grams can be sorted apart, in turns of bounded size
    a = 0
    while a < len(at):
        b = a + TURN
        b = len(at) if b >= len(at) else int(np.searchsorted(gram[at], gram[at[b - 1]], "right"))
        own = at[a:b]
        start = np.arange(SPAN)
        ok = (start >= BACK - back[own, None]) & (start + WIDTH <= BACK + on[own, None])
        i, s = np.nonzero(ok)
        if len(i):
            view = np.lib.stride_tricks.sliding_window_view(rows[own], WIDTH, axis=1)
            order, new = deep_shallow(view[i, s])
            docs = doc[one[own[i]]][order]
            least = np.minimum.reduceat(docs, np.flatnonzero(new))[np.cumsum(new) - 1]
            hit = order[least < docs]
            np.bitwise_or.at(mask, one[own[i[hit]]], (_U(1) << s[hit].astype(_U)).astype(_W))
        a = b
    return mask


def held_in_parts(doc: np.ndarray, left: np.ndarray, right: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """held, PART contexts or about that at a time: contexts of one gram stay together, and others share no string."""
    parts = -(-len(doc) // PART)
    if parts <= 1:
        return held(doc, left, right, raw)
    mask, part = np.zeros(len(doc), _W), np.empty(len(doc), np.int32)
    for a in range(0, len(doc), 1 << 16):
        gram = np.ascontiguousarray(raw[a : a + (1 << 16), BACK : BACK + GRAM]).view(_W).astype(_U)
        h = np.zeros(len(gram), _U)
        for i in range(gram.shape[1]):
            h = mix(h + gram[:, i] * _CTX[i])
        part[a : a + (1 << 16)] = ((h >> _U(32)) * _U(parts)) >> _U(32)
    for p in range(parts):
        at = np.flatnonzero(part == p)
        mask[at] = held(doc[at], left[at], right[at], raw[at])
    return mask


def _sort(table: pa.Table) -> pa.Table:
    """Contexts that were sent to a bucket to their masks, in the order in which they came."""
    trim()
    got = [_received(x) for x in table.column("sent").to_pylist()]
    sizes, whole = [len(x[0]) for x in got], [np.concatenate(x) for x in zip(*got)]
    del got
    mask = held_in_parts(*whole)
    groups, rows, at = [], [], 0
    for g, b, side, n in zip(*(table.column(c).to_pylist() for c in ("grp", "bucket", "side")), sizes):
        own = mask[at : at + n]
        at += n
        if own.any():
            groups.append(g)
            rows.append((b, side, b"", squeezed(own.tobytes())))
    return _rows_of(0, rows, _TOLD).set_column(0, "grp", pa.array(groups, pa.int32()))


def _cut(buckets: int, output):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        g = Group(left, buckets)
        told = {(b, s): m for b, s, m in zip(*(right.column(c).to_pylist() for c in ("bucket", "side", "masks"))) if m}
        mask = np.zeros(len(g.first), _W)
        for to, side, entries in g.sends(_codes(right)):
            if (to, side) in told:
                mask[entries] |= np.frombuffer(unsqueezed(told[to, side]), _W)
        twin = g.first[g.entry]  # equal contexts of a group are told by bytes, not by hashes
        for a in range(0, len(twin), 1 << 15):
            at = np.arange(a, min(a + (1 << 15), len(twin)))
            at = at[twin[at] != at]
            if not (g.bytes_of(at) == g.bytes_of(twin[at])).all():
                raise RuntimeError("two contexts of a group share a hash; choose other seeds")
        full = _full(g.left, g.right)
        mine = np.where(g.doc > g.least[g.entry], full, mask[g.entry])
        cover = np.zeros(len(g.data) + 1, np.int32)
        whole = (mine == full) & (full > 0)
        np.add.at(cover, g.place[whole] - g.left[whole], 1)
        np.add.at(cover, g.place[whole] + g.right[whole], -1)
        some = np.flatnonzero((mine > 0) & ~whole)
        for s in range(SPAN):
            at = g.place[some[(mine[some] >> _W(s)) & _W(1) > 0]] - BACK + s
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WIDTH, -1)
        return output(left, g, np.cumsum(cover, out=cover)[:-1] > 0)

    return run


def _ids(g: Group) -> pa.Array:
    return pa.array(g.ids, pa.int64(), mask=~g.known)


def _digest(table: pa.Table, g: Group, gone: np.ndarray) -> pa.Table:
    n_removed, n_spans, sha = [], [], []
    for i, j in zip(g.off[:-1].tolist(), g.off[1:].tolist()):
        x = gone[i:j]
        n = int(x.sum())
        n_removed.append(n)
        n_spans.append(int(x[0]) + int((x[1:] > x[:-1]).sum()) if n else 0)
        sha.append(hashlib.sha256(g.data[i:j][~x] if n else g.data[i:j]).hexdigest())
    return pa.table([_ids(g), pa.array(np.diff(g.off)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(table: pa.Table, g: Group, gone: np.ndarray) -> pa.Table:
    texts = [g.data[i:j][~gone[i:j]].tobytes().decode("utf-8", "ignore") for i, j in zip(g.off[:-1].tolist(), g.off[1:].tolist())]
    out = {"doc_id": _ids(g), "text": pa.array(texts, pa.string())}
    if "rest" in table.column_names:
        rest = table.column("rest").combine_chunks()
        out["rest"] = (pa.concat_arrays(rest.chunks) if isinstance(rest, pa.ChunkedArray) else rest).flatten()
    return pa.table(out)


def _run(docs: DataFrame, output, schema: str, keep: list[str]) -> DataFrame:
    total = text_bytes(docs)
    groups, buckets = pieces(total, GROUP_BYTES), min(1 << 23, pieces(total, BUCKET_BYTES, 12))
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    rest = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("rest")] if keep else []
    packed = "grp int, ids binary, known binary, sizes binary, data binary" + (", rest array<struct<" + ", ".join(f"`{c}`: {types[c]}" for c in keep) + ">>" if keep else "")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    grp = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(groups)).cast("int")
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), grp.alias("grp"), *rest)
    grouped = flat.mapInArrow(_pack, packed).repartition(min(groups, TASKS), "grp")
    posts = grouped.drop("rest").groupBy("grp").applyInArrow(given_back(_post(buckets)), _POST).repartition(min(buckets, TASKS), "bucket")
    codes = posts.groupBy("bucket").applyInArrow(given_back(_meet), _TOLD)
    sent = grouped.drop("rest").groupBy("grp").cogroup(codes.groupBy("grp")).applyInArrow(given_back(_send(buckets)), _SENT).repartition(min(buckets, TASKS), "bucket")
    masks = sent.groupBy("bucket").applyInArrow(given_back(_sort), _TOLD)
    return grouped.groupBy("grp").cogroup(codes.union(masks).groupBy("grp")).applyInArrow(given_back(_cut(buckets, output)), schema)


def repeated_strings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that stay, end to end): one
    row for each row of docs (doc_id, text; other columns are ignored).

    Null texts are empty; texts shorter than 50 bytes lose nothing. Rows with one doc_id aren't compared with each other.
    Rows without doc_id lose nothing and are no source. Empty table: no rows.
    """
    return _run(docs, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", [])


def drop_repeated_strings(docs: DataFrame) -> DataFrame:
    """docs without the repeated bytes: all rows and columns stay; a character that lost some of its bytes goes. n_chars, if
    there is one, is counted again. Null texts become empty."""
    keep = [c for c in docs.columns if c not in ("doc_id", "text")]
    types = {f.name: f.dataType for f in docs.schema}
    rest = ", rest struct<" + ", ".join(f"`{c}`: {types[c].simpleString()}" for c in keep) + ">" if keep else ""
    out = _run(docs, _texts, f"doc_id long, text string{rest}", keep)
    cols = {c: F.col(f"rest.`{c}`") for c in keep} | {"doc_id": F.col("doc_id").cast(types["doc_id"]), "text": F.col("text")}
    if "n_chars" in keep:
        cols["n_chars"] = F.length("text").cast(types["n_chars"])
    return out.select(*(cols[c].alias(c) for c in docs.columns))


SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), k AS (
  SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, greatest(len(x) // 2 - 49, 0))) AS p FROM d)
), f AS (
  SELECT s, min(doc_id) AS least FROM k GROUP BY s HAVING count(DISTINCT doc_id) > 1
), hit AS (
  SELECT doc_id, p FROM k JOIN f USING (s) WHERE least < doc_id
), b AS (
  SELECT doc_id, substr(x, 2 * p + 1, 2) AS x, p FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM hit))
), c AS (
  SELECT b.doc_id, b.p, b.x, coalesce(b.p - max(hit.p) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 50, false) AS gone
  FROM b LEFT JOIN hit ON b.doc_id = hit.doc_id AND b.p = hit.p
), e AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM c
), r AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT gone), '') AS x FROM e GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_spans, 0) AS n_spans, sha256(unhex(coalesce(r.x, d.x))) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
