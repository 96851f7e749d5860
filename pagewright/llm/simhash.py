"""Near-duplicate documents by a self-join of SimHash fingerprints over a binary trie.

A fingerprint's bits lead from the root of a trie to its leaf. Two nodes of one depth are traversed together: the bits in which
their paths differ add up, and a pair of nodes is pruned as soon as they are more than the budget. Links are between equal or
near fingerprints, so equal ones are one from the start, whatever the size of a group of copies.

The top of the trie is a table of nodes and their counts. Two fingerprints that differ in at most `budget` of their bits agree in
one of budget + 1 blocks of bits, so the trie is built once for each block, over the bits in an order that begins with it. Down to
the end of the block a node then needs to meet itself only, and a fingerprint is in one node of each trie, whatever the size of the
corpus; below it, pairs of nodes are traversed together. A pair of nodes that both hold LEAF fingerprints at most is done: its
fingerprints go to one task, which traverses the rest of the two subtries. A node that holds more is always split, by STEP bits,
so no task grows with a common prefix. No partner is dropped.

Inside a pair of nodes links are merged as they are found, and what a task sends is one link for each fingerprint that it joined to
another at most, so a dense group makes no more rows than it has fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernel import columns, grouped, trim
from .store import save, tidy

STEP, LEAF = 4, 4096
SMALL = 64  # pairs of fingerprints below a pair of nodes that are compared at once
FRONT = 1 << 15  # pairs of nodes in one step
HASHES = 1 << 16  # shingles whose bits are counted at once
SEED = 42
_U = np.uint64


def fingerprint(text: bytes, size: int = 3) -> int:
    """Of a text's word shingles (A-Z lower-cased, joined by one space, with repeats): a bit is 1 if it is set in over half of
    their XXH64. With fewer words than size the whole sequence is the only shingle; without words: 0."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[min(size, len(words)) - 1 :].tolist()
    first = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    for a in range(0, n, HASHES):
        h = np.fromiter((digest(line[i:j], SEED) for i, j in zip(first[a : a + HASHES], last[a : a + HASHES])), _U, min(HASHES, n - a))
        count += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def _fingerprints(size: int):
    def run(batches):
        for b in batches:
            trim()
            data, off = columns(b.column("text"))
            out = np.array([fingerprint(data[i:j].tobytes(), size) for i, j in zip(off[:-1].tolist(), off[1:].tolist())], _U)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return run


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Links:
    """Members of one class point to its smallest one; links are merged a batch at a time."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            on = a != b
            if not on.any():
                return
            i, j = i[on], j[on]
            np.minimum.at(self.root, np.maximum(a[on], b[on]), np.minimum(a[on], b[on]))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def _products(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with a <= i < b, c <= j < d, for each of several pairs of ranges."""
    wide, n = d - c, (b - a) * (d - c)
    at = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a[at] + k // wide[at], c[at] + k % wide[at]


def traverse(x: np.ndarray, y: np.ndarray | None, depth: int, budget: int):
    """Batches (i, j) of all x[i], y[j] that differ in at most budget bits; without y, of x[i], x[j] with i < j. x and y are
    sorted and without repeats, and each shares its first depth bits. Pairs of nodes are ranges of the two: (a, b, c, d,
    bits that differ so far); FRONT of them are split or compared at a time, the deepest first."""
    if not len(x) or y is not None and not len(y):
        return
    own, y = y is None, x if y is None else y
    apart = 0 if own or not depth else int(_bits((x[:1] ^ y[:1]) >> _U(64 - depth))[0])
    if apart > budget:
        return
    todo = [(depth, np.array([[0], [len(x)], [0], [len(y)], [apart]]))]
    while todo:
        bit, front = todo.pop()
        if front.shape[1] > FRONT:
            todo.append((bit, front[:, FRONT:]))
            front = front[:, :FRONT]
        a, b, c, d, _ = front
        few = ((b - a) * (d - c) <= SMALL) | (bit == 64)
        if few.any():
            i, j = _products(a[few], b[few], c[few], d[few])
            near = _bits(x[i] ^ y[j]) <= budget
            if own:
                near &= i < j
            yield i[near], j[near]
        a, b, c, d, apart = front[:, ~few]
        if not len(a):
            continue
        one = _U(1) << _U(63 - bit)
        high = ~(one - _U(1))  # the bits down to this one
        s = np.searchsorted(x, (x[a] & high) | one)
        t = np.searchsorted(y, (y[c] & high) | one)
        s, t = np.clip(s, a, b), np.clip(t, c, d)
        twin = (a == c) if own else np.zeros(len(a), bool)  # a node with itself: its halves meet once
        again = ~twin
        parts = [(a, s, c, t, apart), (s, b, t, d, apart), (a, s, t, d, apart + 1), (s[again], b[again], c[again], t[again], apart[again] + 1)]
        after = np.concatenate([np.array(p) for p in parts], axis=1)
        after = after[:, (after[0] < after[1]) & (after[2] < after[3]) & (after[4] <= budget)]
        if after.shape[1]:
            todo.append((bit + 1, after))


def _joined(budget: int):
    """Rows (pair, depth, trie, side, fp), sorted by pair, to links (trie, a, b) that connect what the pair's nodes connect."""

    def run(batches):
        for g in grouped(batches, "pair"):
            trim()
            fp, side = g.column("fp").to_numpy().view(_U), g.column("side").to_numpy()
            x, y = np.sort(fp[side == 0]), np.sort(fp[side == 1])
            links, every = Links(len(x) + len(y)), np.r_[x, y]
            for i, j in traverse(x, y if len(y) else None, g.column("depth")[0].as_py(), budget):
                links.add(i, j + len(x) if len(y) else j)
            at = np.flatnonzero(links.root != np.arange(len(every)))
            cols = [pa.array(np.full(len(at), g.column("trie")[0].as_py(), np.int32)), pa.array(every[at].view(np.int64)), pa.array(every[links.root[at]].view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["trie", "a", "b"])

    return run


def _prefix(fp: Column, depth: int) -> Column:
    return F.shiftrightunsigned(fp, 64 - depth) if depth else F.lit(0).cast("long")


def _turned(fp: Column, n: int) -> Column:
    """The bits of a fingerprint, beginning with the n-th."""
    return F.shiftleft(fp, n).bitwiseOR(F.shiftrightunsigned(fp, 64 - n)) if n % 64 else fp


def node_pairs(keys: DataFrame, n: int, budget: int) -> DataFrame:
    """(trie, depth, a, b): pairs of nodes, given by their paths, which between them hold every link; a <= b. keys: (trie, fp), the
    n distinct fingerprints in the order of bits of each trie."""
    block = 64 // (budget + 1)
    depth = min(block, (n // LEAF).bit_length())  # where nodes of an even trie are small enough
    at = keys.groupBy("trie", _prefix(F.col("fp"), depth).alias("a")).agg(F.count(F.lit(1)).alias("na"))
    if depth == 0:
        at = at.where("trie = 0")  # all meet there
    front = save(at.select("trie", "a", F.col("a").alias("b"), "na", F.col("na").alias("nb")), "front")
    done = None
    while True:
        small = (F.col("na") <= LEAF) & (F.col("nb") <= LEAF) if depth < 64 else F.lit(True)
        leaves = front.where(small).select("trie", F.lit(depth).alias("depth"), "a", "b")
        done = leaves if done is None else done.union(leaves)
        large = front.where(~small)
        if large.isEmpty():
            return done
        step = min(STEP, block - depth) if depth < block else min(STEP, 64 - depth)
        depth += step
        wanted = large.select("trie", F.col("a").alias("up")).union(large.select("trie", "b")).distinct()
        nodes = keys.groupBy("trie", _prefix(F.col("fp"), depth).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        nodes = save(nodes.withColumn("up", F.shiftrightunsigned("p", step)).join(wanted, ["trie", "up"], "left_semi"), "nodes")
        if depth <= block:
            front = nodes.select("trie", F.col("p").alias("a"), F.col("p").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb"))
            continue
        left = nodes.select("trie", F.col("up").alias("a"), F.col("p").alias("x"), F.col("n").alias("na"))
        right = nodes.select("trie", F.col("up").alias("b"), F.col("p").alias("y"), F.col("n").alias("nb"))
        both = large.select("trie", "a", "b").join(left, ["trie", "a"]).join(right, ["trie", "b"])
        both = both.where((F.col("a") != F.col("b")) | (F.col("x") <= F.col("y"))).where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= budget)
        front = save(both.select("trie", F.col("x").alias("a"), F.col("y").alias("b"), "na", "nb"), "front")


def links(fps: DataFrame, budget: int) -> DataFrame:
    """(a, b): links between fingerprints that differ in at most budget bits, as many as it takes to connect them."""
    block = 64 // (budget + 1)
    tries = F.array(*(F.struct(F.lit(i).alias("trie"), _turned(F.col("fp"), i * block).alias("fp")) for i in range(budget + 1)))
    keys = save(fps.select(F.inline(tries)), "keys")
    pairs = save(node_pairs(keys, fps.count(), budget), "leaves").withColumn("pair", F.monotonically_increasing_id())
    pairs = save(pairs, "pairs")
    rows = None
    for depth in [r.depth for r in pairs.select("depth").distinct().collect()]:  # 64 at most
        here = pairs.where(F.col("depth") == depth)
        ends = here.select("pair", "depth", "trie", F.col("a").alias("p"), F.lit(0).alias("side")).union(here.where("a <> b").select("pair", "depth", "trie", "b", F.lit(1)))
        some = keys.withColumn("p", _prefix(F.col("fp"), depth)).join(ends, ["trie", "p"]).select("pair", "depth", "trie", "side", "fp")
        rows = some if rows is None else rows.union(some)
    if rows is None:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    found = rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(_joined(budget), "trie int, a long, b long")
    back = lambda c: F.coalesce(*(F.when(F.col("trie") == i, _turned(F.col(c), 64 - i * block)) for i in range(budget + 1)))
    return save(found.select(back("a").alias("a"), back("b").alias("b")).distinct(), "links")


@tidy
def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id of the class): one row for each row of docs
    (doc_id, text; other columns are ignored). Rows are linked if their fingerprints differ in at most budget bits.

    Null, empty and wordless texts have the fingerprint zero and are linked like any other. Rows that share a doc_id are rows of
    their own, and so are rows without one; a class of only such rows has no component_id. Empty table: no rows.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = save(text.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "fingerprints")
    classes = save(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = links(classes.select("fp"), budget)
    label = components(found)
    least = classes.join(label.withColumnRenamed("id", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    of = least.groupBy("comp").agg(F.min("least").alias("component_id"))
    least = least.select("fp", "comp").join(of, "comp").select("fp", "component_id")
    return marked.join(least, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
