"""Near-duplicate documents by an inverted join over signature coordinates.

Each distinct shingle set gets a signature of M coordinates, each made of two minima. Two sets of similarity s agree in a
coordinate with probability s * s, so a link's pair agrees in the match threshold T of them or more but for a share of LOST.

1. Post. Every (coordinate, value) has one place in a global order, rare ones first; a set is posted under the first M - T + 1
   of its own in that order. Two sets that agree in T coordinates or more meet in one of these lists (prefix filter), and
   what very many sets share is hardly ever posted. The order is by counts in 2**SKETCH_BITS cells, a table of fixed size;
   any order is right, a good one keeps lists short.
2. Count. Each member of a list meets the list's smallest member; their agreeing coordinates are counted, and pairs that
   reach T (and whose sizes allow a link) are confirmed on the full sets.
3. Lists whose other members then lie in different components: members of the largest component of a list are compared with
   the rest, not among each other, and a pair only in the first list of the order that holds both (skip merging). Again
   pairs that reach T are confirmed on the full sets, if they still lie in different components.

Only connectivity is asked for, so lists aren't expanded into pairs: a list of n members, m of them outside its largest
component, makes n + m * n / BLOCK rows. No list, partner or candidate is capped.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import merged
from .kernel import Words, chunks, columns, grouped, mix, seeds, sort_within, trim, windows
from .store import few, save, tidy

M, WIDTH = 48, 2
MINIMA = M * WIDTH
LOST = 3e-6
SKETCH_BITS = 18
BLOCK = 1024  # members in a block of a long list
PIECE = 64  # pairs of one text that are confirmed in a row
_U, _W = np.uint64, np.uint32
_A, _B = (seeds(x, MINIMA).astype(_W) | _W(1) for x in (101, 202))
_S = seeds(303, M + 1)


@functools.cache
def threshold(percent: int) -> int:
    """How many of M coordinates a pair at the least similarity agrees in, but for a share of LOST of such pairs."""
    p, below, t = (percent / 100) ** WIDTH, 0.0, 0
    while t < M:
        below += math.comb(M, t) * p**t * (1 - p) ** (M - t)
        if below > LOST:
            break
        t += 1
    return max(1, t)


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): hashes of a text's word shingles, in order and with repeats, at bounds[i]..bounds[i+1]. A text
    with fewer words than size, but one, has its whole sequence as its only shingle."""
    w = Words(data, off)
    h = w.hashes()
    s, _, per = windows(h, w.at, w.count, size)
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    n = per.copy()
    n[short] = 1
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(bounds[-1], _U)
    whole = np.ones(len(out), bool)
    whole[bounds[short]] = False
    out[whole] = s
    for i in short.tolist():
        x = _U(7 + w.count[i])
        for y in h[w.at[i] : w.at[i + 1]]:
            x = mix(np.array([x ^ y]))[0] + _U(1)
        out[bounds[i]] = x
    return out, bounds


def distinct_within(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each slice, and their bounds."""
    t = sort_within(h, bounds)
    new = np.ones(len(t), bool)
    new[1:] = t[1:] != t[:-1]
    new[bounds[:-1][bounds[:-1] < len(t)]] = True
    n = np.concatenate([[0], np.cumsum(new)])[bounds]
    return t[new], n


def _signatures(size: int):
    """Arrow batches of doc_id, text to: doc_id, n, two sums that identify the set, keys (M values of 32 bits)."""

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                trim()
                for i, j, data, off in chunks(b.column("text")):
                    h, at = distinct_within(*shingles(data, off, size))
                    n = np.diff(at)
                    full = np.flatnonzero(n)
                    s1, s2 = np.zeros((2, j - i), _U)
                    keys = np.zeros((j - i, M), _W)
                    if len(full):
                        first = at[:-1][full]
                        s1[full] = np.add.reduceat(mix(h), first)
                        s2[full] = np.add.reduceat(mix(h ^ _S[M]), first)
                        low = (h >> _U(32)).astype(_W)
                        for c in range(M):
                            value = np.zeros(len(full), _U)
                            for k in range(c * WIDTH, c * WIDTH + WIDTH):
                                x = (low ^ _B[k]) * _A[k]
                                x ^= x >> _W(15)
                                x *= _A[k - 1]
                                value = mix(value + (np.minimum.reduceat(x, first).astype(_U) ^ _S[c]))
                            keys[full, c] = (value >> _U(32)).astype(_W)
                    sums = [pa.array(x.view(np.int64)) for x in (s1, s2)]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(n), *sums, _rows(keys)], names=["doc_id", "n", "s1", "s2", "keys"])

    return run, "doc_id long, n long, s1 long, s2 long, keys binary"


def _rows(x: np.ndarray) -> pa.Array:
    """A matrix as one binary value for each row."""
    return pa.array([r.tobytes() for r in x], pa.binary())


def _matrix(arr, kind=_W) -> np.ndarray:
    """The matrix back; M columns."""
    return columns(arr)[0].view(kind).reshape(len(arr), M)


def _posted(keys: np.ndarray) -> np.ndarray:
    """(coordinate, value) as one number."""
    return (np.arange(M, dtype=_U) << _U(32)) | keys.astype(_U)


def _cell(posted: np.ndarray) -> np.ndarray:
    return (mix(posted) >> _U(64 - SKETCH_BITS)).astype(np.int64)


def _tally(batches):
    """How many sets have a (coordinate, value) of each cell."""
    n = np.zeros(1 << SKETCH_BITS, np.int64)
    for b in batches:
        if len(b):
            n += np.bincount(_cell(_posted(_matrix(b.column("keys")))).ravel(), minlength=len(n))
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["cell", "n"])


def _ordered(held, posts: int):
    """id, n, keys with order (coordinates in the global order, as bytes) and prefix (what is posted)."""

    def run(batches):
        often = held.value
        for b in batches:
            trim()
            if not len(b):
                continue
            posted = _posted(_matrix(b.column("keys")))
            place = (np.minimum(often[_cell(posted)], 0x7FFFFFFF).astype(_U) << _U(32)) | (mix(posted) >> _U(32))
            order = np.argsort(place, axis=1, kind="stable")
            prefix = np.take_along_axis(posted, order[:, :posts], 1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, prefix.size + 1, posts, dtype=np.int32)), pa.array(prefix.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "n", "keys")), _rows(order.astype(np.uint8)), lists], names=["id", "n", "keys", "order", "prefix"])

    return run


def _sizes_allow(x, y, percent: int):
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def _counted(least: int, percent: int):
    """Of pairs with both sides' signatures, those whose collisions reach the threshold."""

    def run(batches):
        for b in batches:
            trim()
            if len(b):
                same = (_matrix(b.column("x")) == _matrix(b.column("y"))).sum(1)
                ok = (same >= least) & _sizes_allow(b.column("nx").to_numpy(), b.column("ny").to_numpy(), percent)
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _tiles(least: int, percent: int):
    """Rows of a tile (t, key, id, comp, rest, home, own, n, keys, order) to its members that have partners to be confirmed:
    rows of the tile's rest block (own) against rows of its member block (home)."""

    def run(batches):
        for g in grouped(batches, "t"):
            num = {k: g.column(k).to_numpy() for k in ("id", "comp", "n")}
            flag = {k: g.column(k).to_numpy(zero_copy_only=False) for k in ("rest", "home", "own")}
            keys, order = _matrix(g.column("keys")), _matrix(g.column("order"), np.uint8)
            c = int(g.column("key")[0].as_py() >> 32)
            before = np.zeros(keys.shape, bool)  # coordinates that come before this list's in a member's order
            np.put_along_axis(before, order.astype(np.int64), np.arange(M)[None, :] < (order == c).argmax(1)[:, None], 1)
            wanted, partners = np.zeros(len(g), bool), [b""] * len(g)
            home = np.flatnonzero(flag["home"])
            for a in np.flatnonzero(flag["own"]).tolist():
                # two rest members meet from the smaller id
                b = home[(num["comp"][home] != num["comp"][a]) & (~flag["rest"][home] | (num["id"][home] > num["id"][a]))]
                b = b[_sizes_allow(num["n"][b], num["n"][a], percent)]
                if len(b):
                    same = keys[b] == keys[a]
                    b = b[(same.sum(1) >= least) & ~(same & before[a]).any(1)]
                if len(b):
                    wanted[a] = wanted[b] = True
                    bits = np.zeros(len(g), bool)
                    bits[b] = True
                    partners[a] = np.packbits(bits).tobytes()
            at = np.flatnonzero(wanted)
            if len(at):
                yield pa.RecordBatch.from_arrays([g.column("t").combine_chunks().take(pa.array(at)), pa.array(at), *(pa.array(num[k][at]) for k in ("id", "comp")), pa.array([partners[k] for k in at], pa.binary())], names=["t", "pos", "id", "comp", "partners"])

    return run


def _sets(arr, size: int):
    """(row, its set) of an Arrow column of texts."""
    for i, j, data, off in chunks(arr):
        h, at = distinct_within(*shingles(data, off, size))
        for k in range(j - i):
            yield i + k, h[at[k] : at[k + 1]]


def _confirm_tiles(size: int, percent: int):
    """Links of tiles that join components; a tile's members are BLOCK or about that on either side."""

    def run(batches):
        for g in grouped(batches, "t"):
            ids, comp, pos = (g.column(k).to_numpy() for k in ("id", "comp", "pos"))
            sets = [x.copy() for _, x in _sets(g.column("text"), size)]
            rows: dict[int, list[int]] = {}
            for i, p in enumerate(pos.tolist()):
                rows.setdefault(p, []).append(i)
            root = {x: x for x in comp.tolist()}

            def top(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            out = []
            for a, near in enumerate(g.column("partners").to_pylist()):
                for b in (r for p in np.flatnonzero(np.unpackbits(np.frombuffer(near, np.uint8))).tolist() for r in rows.get(p, ())):
                    x, y = top(int(comp[a])), top(int(comp[b]))
                    if x != y and _linked(sets[a], sets[b], percent):
                        root[max(x, y)] = min(x, y)
                        out.append((int(ids[a]), int(ids[b])))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not _sizes_allow(len(x), len(y), percent):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(size: int, percent: int):
    """Rows (a, piece, b, text), sorted, the text of a (b null) before those of its partners, to links. One head is held."""

    def run(batches):
        now, heads = None, []
        for b in batches:
            trim()
            a, piece, other = (b.column(k) for k in ("a", "piece", "b"))
            a, piece, member = a.to_numpy(), piece.to_numpy(), other.is_valid().to_numpy(zero_copy_only=False)
            ok = np.zeros(len(b), bool)
            for i, x in _sets(b.column("text"), size):
                if (a[i], piece[i]) != now:
                    now, heads = (a[i], piece[i]), []
                if member[i]:
                    ok[i] = any(_linked(y, x, percent) for y in heads)
                else:
                    heads.append(x.copy())
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _texts_of(text: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of text (id, text) with an id of ids (id, distinct)."""
    return text.join(few(ids), "id", "left_semi")


def _links(text: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those that are links by their full sets. The text of a is sent once for each PIECE partners."""
    ids = save(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts = save(_texts_of(text, ids), "texts")
    n = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    dealt = save(pairs.join(n, "a").select("a", F.pmod(F.xxhash64("b"), F.col("pieces")).alias("piece"), "b"), "dealt")
    heads = dealt.select("a", "piece").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "piece", F.lit(None).cast("long").alias("b"), "text")
    both = heads.union(dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "piece", "b", "text"))
    order = ["a", "piece", F.col("b").asc_nulls_first()]
    return save(both.repartition("a", "piece").sortWithinPartitions(*order).mapInArrow(_confirm(size, percent), "a long, b long"), "links")


@tidy
def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """Classes of documents linked, directly or through others, by 100 * |A & B| >= percent * |A | B| over their sets of
    word shingles (A-Z lower-cased). Input: doc_id, text; other columns are ignored. One row for each input row:

    doc_id, n_shingles (set size), component_id (smallest doc_id in the class), kept (doc_id = component_id).

    Null and wordless texts have empty sets and are linked with nothing. A row without doc_id is linked with nothing
    either: component_id null, kept true. Rows with one doc_id are one document, whose versions' links all count.
    Empty table: no rows.
    """
    spark, least = docs.sparkSession, threshold(percent)
    run, schema = _signatures(shingle)
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    light = save(text.withColumnRenamed("id", "doc_id").mapInArrow(run, schema), "signatures")
    some = light.where("n > 0 and doc_id is not null")
    reps = save(some.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"), F.min_by("keys", "doc_id").alias("keys")), "classes")

    tally = reps.select("keys").mapInArrow(_tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(1 << SKETCH_BITS, np.int64)
    often[tally.cell.to_numpy()] = tally.n.to_numpy()
    held = spark.sparkContext.broadcast(often)  # 2 MB, whatever the corpus
    nodes = save(reps.select("id", "n", "keys").mapInArrow(_ordered(held, M - least + 1), "id long, n long, keys binary, order binary, prefix array<long>"), "nodes")
    posts = nodes.select("id", F.explode("prefix").alias("key"))
    heads = posts.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a <> most").select("key", "a")
    lists = save(posts.join(heads, "key").where("a <> id").select("key", "id", "a"), "lists")  # of two or more, without their heads

    signed = nodes.select("id", "n", "keys")
    star = lists.select("a", F.col("id").alias("b")).distinct()
    star = star.join(signed.select(F.col("id").alias("b"), F.col("keys").alias("y"), F.col("n").alias("ny")), "b").join(signed.select(F.col("id").alias("a"), F.col("keys").alias("x"), F.col("n").alias("nx")), "a")
    near = save(star.select("a", "b", "x", "y", "nx", "ny").mapInArrow(_counted(least, percent), "a long, b long"), "pairs")
    label = merged(None, _links(text, near, shingle, percent))

    member = lists.join(label, "id", "left").select("id", "key", F.coalesce("comp", "id").alias("comp"))
    shares = member.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = shares.groupBy("key").agg(F.sum("n").alias("all"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most")).where("all > most")
    mixed = mixed.select("key", "main", F.ceil(F.col("all") / BLOCK).alias("homes"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("owns"))
    dealt = member.join(mixed, "key").withColumn("rest", F.col("comp") != F.col("main"))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("id"), F.col("homes"))).withColumn("j", F.pmod(F.xxhash64("id", F.lit(1)), F.col("owns")))
    here = F.transform(F.sequence(F.lit(0).cast("long"), F.col("owns") - 1), lambda j: F.struct(F.col("i").alias("i"), j.alias("j")))
    there = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("homes") - 1), lambda i: F.col("rest") & (i != F.col("i"))), lambda i: F.struct(i.alias("i"), F.col("j").alias("j")))
    dealt = dealt.select("key", "id", "comp", "rest", "i", "j", F.explode(F.concat(here, there)).alias("at"))
    tile = dealt.select("key", "id", "comp", "rest", (F.col("at.i") == F.col("i")).alias("home"), (F.col("rest") & (F.col("at.j") == F.col("j"))).alias("own"), F.xxhash64("key", "at.i", "at.j").alias("t"))
    tile = tile.join(nodes.drop("prefix"), "id").select("t", "key", "id", "comp", "rest", "home", "own", "n", "keys", "order")
    wanted = tile.repartition("t").sortWithinPartitions("t").mapInArrow(_tiles(least, percent), "t long, pos long, id long, comp long, partners binary")
    wanted = save(wanted, "wanted")
    if not wanted.isEmpty():
        texts = _texts_of(text, save(wanted.select("id").distinct(), "ids"))
        both = wanted.join(texts, "id").select("t", "pos", "id", "comp", "partners", "text").repartition("t").sortWithinPartitions("t")
        label = merged(label, save(both.mapInArrow(_confirm_tiles(shingle, percent), "a long, b long"), "links"))

    classes = reps.drop("keys").join(label, "id", "left").select("n", "s1", "s2", F.coalesce("comp", "id").alias("comp"))
    out = light.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
    comp = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("comp"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """The documents that stay: the one with the smallest doc_id of each class. All columns are kept as they are.
    Documents without words and rows without doc_id stay; rows that repeat a doc_id stay or go together."""
    gone = near_duplicates(docs, shingle, percent).where("not kept").select("doc_id").distinct()
    return docs.join(few(gone), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id
)
SELECT id AS doc_id, coalesce(max(n), 0) AS n_shingles, min(r) AS component_id, id = min(r) AS kept
FROM reach LEFT JOIN n ON n.doc_id = id GROUP BY id
"""
