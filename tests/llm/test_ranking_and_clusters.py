"""Operators 11 to 13 against brute force, on edge cases, and where their cuts and pieces are small."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pagewright.llm import clusters, lexical, queries, simhash

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, cluster int, v string, n long"


# ---- centroid clustering


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        for j, vs in of.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(i, *near(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, d, j in out:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in out), key=str)


def clusters_of(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in clusters.clustered(df).collect()), key=str)


def test_clusters(spark):
    """Nulls, other widths, non-finite components, repeated rows and ids, no id, equal vectors, clashing columns."""
    r = random.Random(1)
    vec = lambda: [np.float32(r.gauss(0, 1)).item() for _ in range(64)]
    rows = [(i, vec()) for i in range(60)]
    rows += [(60, rows[3][1]), (60, rows[4][1]), rows[5], rows[5], (None, vec()), (61, None), (62, [0.5] * 63), (63, [None] + [0.5] * 63), (64, [float("nan")] * 64), (65, [float("inf")] + [0.0] * 63), (66, []), (67, [0.0] * 64), (68, [-0.0] * 64)]
    df = spark.createDataFrame([(i, v, 7, "x", 8) for i, v in rows], VECTORS)
    assert clusters_of(df) == brute_clusters(rows)
    few = rows[:5] + [rows[60], rows[4]]
    assert clusters_of(spark.createDataFrame([(i, v, 7, "x", 8) for i, v in few], VECTORS)) == brute_clusters(few)
    assert clusters.clustered(spark.createDataFrame([], VECTORS)).collect() == []


def test_clusters_with_ties_and_large_numbers(spark):
    """Grids of equal distances, and components that float32 can't hold."""
    r = random.Random(2)
    for scale, base in ((1 / 64, 0), (3e5, 0), (1.0, 2.0**40)):
        rows = [(i, [base + float(r.randint(-2, 2)) * scale for _ in range(64)]) for i in range(50)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert clusters_of(df) == brute_clusters(rows)


def test_intervals_hold_the_exact_value():
    r = np.random.default_rng(3)
    for size in (3, 64, 10**4, 10**7, 2**40):
        v, c = (r.integers(-size, size + 1, (n, 64)) for n in (200, 16))
        low, high = clusters.intervals(v, c)
        exact = (c.astype(object) ** 2).sum(1)[None, :] - 2 * (v.astype(object) @ c.astype(object).T)
        assert all(lo <= x <= hi for lo, x, hi in zip(low.ravel().tolist(), exact.ravel().tolist(), high.ravel().tolist()))
        # neighbours that differ by one in one place: the screening can't tell them apart, the integers do
        c[1:] = c[0]
        c[np.arange(1, 16), np.arange(1, 16)] += 1
        want = [min(range(16), key=lambda j: (sum((int(a) - int(b)) ** 2 for a, b in zip(x, c[j])), j)) for x in v]
        assert clusters.nearest(v, c).tolist() == want


def test_clusters_equal_sql(spark, duck, same):
    same(queries.op11_clusters(spark, SMALL).toPandas(), duck.execute(clusters.SQL).df())


def test_sums_that_do_not_fit(spark):
    far = spark.createDataFrame([(0, [1e16] * 64), (1, [-1e16] * 64), (2, [1e16] * 64)], "vec_id long, embedding array<double>")
    assert {r.distance for r in clusters.clustered(far).collect()} == {0}
    with pytest.raises(Exception, match="doesn't fit a long"):
        clusters.clustered(far, k=1).collect()
    with pytest.raises(Exception, match="doesn't fit a long"):
        clusters.clustered(spark.createDataFrame([(0, [1e300] * 64)], "vec_id long, embedding array<double>")).collect()


# ---- ranked lexical search


def brute_ranking(docs, items, k=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    held = [(i, collections.Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n, total = len(held), sum(x for _, _, x in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, size in held:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def ranking(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, 2.0, 3) for i, t in docs], "doc_id long, text string, n long, score double, terms int")
    b = spark.createDataFrame([(i, t, 1, 2.0) for i, t in items], "item_id long, text string, q long, rank double")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.ranked(d, b, **more).collect()), key=str)


def corpus(n, seed=4):
    r = random.Random(seed)
    words = ["The", "the", "Cat", "dog", "É", "é", "naïve", "x1", "42", "straße", "日本", "_", "--", "K", "k", "K"] + [f"w{i}" for i in range(40)]
    return [(r.randrange(-(10**6), 10**6), r.choice([" ", "_", ", ", "\n"]).join(r.choices(words, k=r.randint(0, 60)))) for _ in range(n)]


def test_ranking(spark):
    """Nulls, empty and termless texts, ties, repeated rows and ids, a term often in one text, a very long text."""
    docs = corpus(120)
    docs += [(None, docs[0][1]), (None, "cat cat"), docs[1], docs[1], (docs[2][0], "dog dog dog"), (7, None), (8, ""), (9, "-- __ !"), (10, "cat " * 200_000), (11, "the cat"), (12, "The CAT!"), (13, "the\x00cat")]
    items = [(1, "the cat sat"), (1, "dog dog the"), (2, None), (3, "..."), (4, "nowhere"), (None, "É é 日本 k"), (5, "w1 w2 w3 w4 the the the"), (6, docs[5][1])]
    assert ranking(spark, docs, items) == brute_ranking(docs, items)
    assert ranking(spark, [], items) == [] and ranking(spark, docs, []) == [] and ranking(spark, docs[:3], [(1, "--")]) == []


def test_ranking_in_small_windows_and_batches(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERIES", 2)
    docs = corpus(300, 5)
    docs += [(5, f"the w{i % 7}") for i in range(100)]  # one id for a quarter of all rows
    items = [(i, t) for i, (_, t) in enumerate(corpus(9, 6))]
    want = brute_ranking(docs, items)
    assert ranking(spark, docs, items) == want
    monkeypatch.setattr(lexical, "QUERIES", 4096)
    monkeypatch.setattr(lexical, "WINDOW_BITS", 3)
    monkeypatch.setattr(lexical, "WINDOW_POSTINGS", 40)
    assert ranking(spark, docs, items) == want


def test_windows(monkeypatch):
    monkeypatch.setattr(lexical, "WINDOW_BITS", 4)
    monkeypatch.setattr(lexical, "WINDOW_POSTINGS", 30)
    r = random.Random(7)
    ids = [None] * 20 + sorted(r.choices(range(-100, 300), k=400)) + [500] * 50
    rows = [list(range(r.randint(0, 40))) for _ in ids]
    batches, i = [], 0
    while i < len(ids):
        n = r.randint(1, 90)
        batches.append(pa.RecordBatch.from_arrays([pa.array(ids[i : i + n], pa.int64()), pa.array(rows[i : i + n], pa.list_(pa.int32()))], names=["doc_id", "terms"]))
        i += n
    got = list(lexical._windows(iter(batches)))
    assert [x for t in got for x in t.column("doc_id").to_pylist()] == ids and [x for t in got for x in t.column("terms").to_pylist()] == rows
    for t in got:
        at = t.column("doc_id").to_pylist()
        assert len(t) <= 16 and len({None if x is None else x >> 4 for x in at}) == 1
        assert len(t) == 1 or sum(map(len, t.column("terms").to_pylist())) <= 30


def test_words_that_share_a_hash(monkeypatch):
    """Bytes decide, not hashes."""
    monkeypatch.setattr(lexical.Words, "hashes", lambda w: (w.end - w.start).astype(np.uint64))
    v = lexical.Vocabulary([b"ab", b"cd", b"efg", b"h"])
    data = np.frombuffer(b"CD ab xy efg h i abc", np.uint8)
    assert v.numbers(lexical.Words(data, np.array([0, len(data)]), gap=lexical.GAP)).tolist() == [1, 0, -1, 2, 3, -1, -1]


def test_ranking_equals_sql(spark, duck, same):
    same(queries.op12_lexical(spark, SMALL).toPandas(), duck.execute(lexical.SQL).df())


# ---- SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min((x for x in (least.get(top(i)), d) if x is not None), default=None)
    return sorted(((d, f"{fp[i]:016x}", least[top(i)]) for i, (d, _) in enumerate(rows)), key=str)


def components_of(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, fp long, comp long, pair string")
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)


def near_texts(n, seed):
    r = random.Random(seed)
    base = [" ".join(f"w{r.randrange(500)}" for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(300)] = f"new{r.randrange(1000)}"
        rows.append((1000 - i, " ".join(w)))
    return rows


def test_simhash(spark):
    rows = near_texts(60, 8)
    rows += [(None, rows[0][1]), (None, "nothing like it at all"), (5, None), (6, ""), (7, " \n\t"), (8, "one"), (9, "One"), (10, "one two"), (11, "one  TWO"), (12, "É é ß"), rows[1], (rows[1][0], "another text with this id"), (13, "ab " * 400_000), (14, "ab ab ab"), (15, "a b c d e")]
    assert components_of(spark, rows) == brute_components(rows)
    assert components_of(spark, []) == []
    assert components_of(spark, rows[:1]) == brute_components(rows[:1])


@pytest.mark.parametrize("leaf", [1, 5])
def test_simhash_with_small_leaves(spark, monkeypatch, leaf):
    """Every link is found, however deep the top of the trie is."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "SMALL", 1)
    rows = near_texts(50 if leaf == 1 else 120, 9)
    assert components_of(spark, rows) == brute_components(rows)


def test_traversal(monkeypatch):
    monkeypatch.setattr(simhash, "FRONT", 50)
    r = np.random.default_rng(10)
    for n, bits, small in ((300, 12, 1), (900, 14, 64), (400, 64, 4), (1, 8, 1)):
        monkeypatch.setattr(simhash, "SMALL", small)
        low = np.uint64((1 << min(bits, 56)) - 1)
        x, y = (np.unique(r.integers(0, 1 << 63, size=n, dtype=np.uint64) & low | np.uint64(p << 56)) for p in (5, 4))
        for budget in (0, 1, 2, 3):
            got = {p for i, j in simhash.traverse(x, None, 0, budget) for p in zip(i.tolist(), j.tolist())}
            assert got == set(zip(*(k.tolist() for k in np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= budget, 1)))))
            got = {p for i, j in simhash.traverse(x, y, 8, budget) for p in zip(i.tolist(), j.tolist())}
            assert got == set(zip(*(k.tolist() for k in np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= budget))))


def test_fingerprints_are_those_of_spark(spark):
    """The hash is the one Spark calls xxhash64."""
    words = "a bb ccc dddd é zz".split()
    got = [r.h & (2**64 - 1) for r in spark.createDataFrame([(" ".join(words[i : i + 3]),) for i in range(4)], "s string").selectExpr("xxhash64(s) as h").collect()]
    assert got == [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(4)]
