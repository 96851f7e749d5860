"""The corpus operators against brute force, and on edge cases: nulls, empty and long texts, ties, repeats, empty tables,
extra columns with clashing names."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from pagewright.llm import licenses, minhash, mixing, packing, quality, rules, sharding, suffix, topk, toxicity
from pagewright.llm.components import components
from pagewright.llm.queries import queries
from pagewright.llm.store import documents

SMALL = "/root/testdata/sf0.001"
QUERIES = queries()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key long, t string, grp int, score double, comp long"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_rows():
    base = words(120, 1)
    texts = [base, base, base.replace("a", "b", 3), None, "", "one two", "One  two", " \n\t", words(4000, 2), words(4000, 2) + " x", "é" * 60, "é" * 60, "ab" * 200, "ab" * 200, base[100:260] + words(30, 3), words(30, 4) + base[100:260]]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, len(t or ""), 1, 2, "x", 3, 0.5, 9) for i, t in enumerate(texts)]
    return rows + [(None, base, None, None, 3, 1, 2, "x", 3, 0.5, 9), rows[0]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(rows):
    sets = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            sets[r[0]].append(shingles(r[1]))
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def test_near_duplicates(odd, none):
    rows = odd.collect()
    want = near(rows)
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id == r.component_id)
    assert minhash.near_duplicates(none).collect() == []
    stay = minhash.drop_near_duplicates(odd)
    assert stay.columns == odd.columns and {r.doc_id for r in stay.collect()} == {i for i, c in want.items() if i == c} | {None}


def test_near_duplicates_of_a_long_list(spark, monkeypatch):
    """Near copies around one base, many of which aren't linked with the first: tiles of several blocks find all links."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base = words(100, 5).split()
    r = random.Random(6)
    rows = []
    for i in range(60):
        w = list(base)
        for k in r.sample(range(100), 3 + i % 3):
            w[k] = f"new{i}x{k}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near(rows)


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (101, 100)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def cut(rows):
    out = []
    held = collections.defaultdict(set)
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    for i, b in raw:
        for k in range(len(b) - 49):
            if i is not None:
                held[b[k : k + 50]].add(i)
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if i is not None and min(held[b[k : k + 50]]) < i:
                gone[k : k + 50] = True
        stay = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = sum(1 for k, _ in itertools.groupby(gone.tolist()) if k)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(stay).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group, split", [(12 << 20, 1 << 16), (3000, 1 << 16), (3000, 1)])
def test_repeated_strings(spark, odd, none, monkeypatch, group, split):
    monkeypatch.setattr(suffix, "GROUP_BYTES", group)
    monkeypatch.setattr(suffix, "SPLIT", split)
    rows = odd.collect()
    assert sorted(map(tuple, suffix.repeated_strings(odd).collect()), key=str) == cut(rows)
    assert suffix.repeated_strings(none).collect() == []
    if group == 3000:
        texts = suffix.drop_repeated_strings(odd)
        assert texts.columns == odd.columns
        got = {r.doc_id: r for r in texts.collect()}
        assert got[1].text == "" and got[1].n_chars == 0 and got[0].text == rows[0].text and got[4].comp == 9


@pytest.mark.parametrize("split", [1 << 16, 2])
def test_repeated_strings_of_the_small_table(spark, monkeypatch, split):
    monkeypatch.setattr(suffix, "GROUP_BYTES", 100_000)
    monkeypatch.setattr(suffix, "SPLIT", split)
    docs = documents(spark, SMALL)
    assert sorted(map(tuple, suffix.repeated_strings(docs).collect()), key=str) == cut([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("shallow", [8, 24, 40])
def test_deep_shallow(shallow):
    r = np.random.default_rng(1)
    rows = r.integers(97, 99, (3000, 50)).astype(np.uint8)
    rows[100:900] = rows[:800]
    rows[1000:1400, :45] = rows[0, :45]
    rows[1400:2000, :20] = rows[0, :20]
    order, new = suffix.deep_shallow(rows, shallow)
    texts = [rows[i].tobytes() for i in order]
    assert texts == sorted(x.tobytes() for x in rows) and sorted(order.tolist()) == list(range(3000))
    assert [True] + [a != b for a, b in zip(texts, texts[1:])] == new.tolist()


def test_mixing(odd, none):
    got = mixing.copies(odd).collect()
    size = {r.doc_id: len((r.text or "").split()) for r in odd.collect()}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.copies <= 3 for r in got) and len(got) == len(odd.collect())
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum({r.source: r.source_size for r in got}.values()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.copies(odd).collect()))
    assert mixing.copies(none).collect() == [] and mixing.mix(odd).columns == odd.columns


def test_mixing_of_the_small_table(spark):
    got = mixing.copies(documents(spark, SMALL)).toPandas()
    g = got.assign(taken=got["size"] * got.copies).groupby("source").agg(t=("target", "first"), k=("taken", "sum"), m=("size", "max"))
    assert ((g.k - g.t).abs() <= g.m + 1).mean() > 0.8 and abs(g.k.sum() / g.t.sum() - 1) < 0.05


def test_targets(spark):
    s = spark.createDataFrame([("a", 10), ("b", 10), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    assert got["a"] == 30 and got["b"] == 30 and got[None] == 15 and got["c"] == pytest.approx(950)


def test_boundaries():
    r = random.Random(3)
    for _ in range(20):
        lengths = np.array(sorted(r.sample(range(1, 60), 9)))
        counts = np.array([r.randint(1, 9) for _ in lengths])

        def cost(ends):
            return sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts))

        best = min(cost([*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1].tolist(), 2))
        assert cost(packing.boundaries(lengths, counts, 3)) == best


def test_packing(odd, none):
    rows = packing.packed(odd, budget=400, buckets=4).collect()
    assert len(rows) == len(odd.collect()) and packing.packed(none).collect() == []
    for (_, _), g in itertools.groupby(sorted(rows, key=lambda r: (r.bucket, r.batch_id)), key=lambda r: (r.bucket, r.batch_id)):
        g = list(g)
        assert sorted(r.slot for r in g) == list(range(len(g))) and len(g) <= max(1, 400 // max(1, g[0].bucket_length))
        assert all(r.n_tokens <= r.bucket_length for r in g)


def test_sharding(spark, odd, none, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_ROWS", 8)
    for docs in (odd, documents(spark, SMALL)):
        texts = collections.defaultdict(set)
        for r in docs.collect():
            texts[r.doc_id].add(((len((r.text or "").encode()) + 1), zlib.crc32((r.text or "").encode())))
        rows = sharding.sharded(docs).collect()
        assert len(rows) == docs.count() and all((r["size"], r.text_crc32) in texts[r.doc_id] for r in rows)
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values()) and set(by) <= set(range(16))
    size = {s: sum(r["size"] for r in g) for s, g in by.items()}
    biggest = max(r["size"] for r in rows)
    assert max(size.values()) - min(size.values()) <= 2 * biggest
    assert sharding.sharded(none).collect() == []


def best_rows(vec, every=50, k=5):
    """(query_id, rank, vec_id, score) of all rows by brute force, in Python's integers."""
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vec if i is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v)]
    out = []
    for at, (q, x) in enumerate(good):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for n, (i, y) in enumerate(good) if n != at)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("bits", [12, 4])
def test_top_k(spark, monkeypatch, bits):
    """Nulls, copies, repeated ids, empty and shorter vectors; with small blocks most lists send too few at first."""
    monkeypatch.setattr(topk, "BLOCK_BITS", bits)
    monkeypatch.setattr(topk, "LOCAL", bits // 2)
    monkeypatch.setattr(topk, "SEEN", bits)
    r = np.random.default_rng(2)
    vec = [(i, (r.normal(size=8) / 3).tolist()) for i in range(300)]
    vec[7:60] = [(i, vec[0][1]) for i in range(7, 60)]
    vec += [(500, None), (550, [None] * 8), (600, [float("nan")] * 8), (610, [float("inf")] * 8), (None, vec[1][1]), (650, []), (650, vec[2][1]), (100, vec[100][1]), (700, [9.0] * 3), (701, [8.0] * 11)]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<double>").selectExpr("*", "1 as row", "2 as block", "'x' as q", "3 as p0")
    assert sorted(map(tuple, topk.top_k(df).collect())) == best_rows(vec)


def test_top_k_of_few(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert list(map(tuple, topk.top_k(few).collect())) == [(0, 1, 1, 131072)]
    assert topk.top_k(few.limit(0)).collect() == [] and topk.top_k(few.where("vec_id = 1")).collect() == []


def test_top_k_of_large_components(spark):
    """Scores are exact up to 61 bits and an error beyond, never wrapped."""
    vec = [(0, [3e6, 1.0]), (1, [3e6, 0.5]), (2, [1.0, 0.0]), (3, [-2e6, 4e6]), (4, [0.0, 1e12])]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df).collect())) == best_rows(vec)
    for big in (1e8, 1e300):
        wide = spark.createDataFrame([(0, [big, 0.0]), (1, [big, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="fit a long"):
            topk.top_k(wide).collect()


def base_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(win)
    hit = {k for i, x in enumerate(win) if n[x] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_rules(spark, odd, none):
    for docs in (odd, documents(spark, SMALL)):
        want = collections.Counter((r.doc_id, *base_counts(r.text)) for r in docs.collect())
        rows = rules.checked(docs).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in rows)
    assert sum(r.kept for r in rows) > 0.7 * len(rows)
    assert rules.checked(none).collect() == []
    assert rules.counts(*_bytes(["A a\na A\n\nA a\n", "x\n x", ""]))[3].tolist() == [1, 0, 0]


def test_rules_of_small_sources(spark):
    """Sources of 60 documents are judged by their own spread: a document in another's style is an outlier of its source."""
    r = random.Random(9)

    def text(style):
        one, many = ("abcdefgh", (2, 4)) if style == "a" else ("stuvwxyz", (9, 14))
        plain = ["".join(r.choice(one) for _ in range(r.randint(*many))) for _ in range(r.randint(80, 160))]
        return " ".join(w + ("#$%" if style == "b" else "") for w in plain)

    rows = [(i, text("ab"[i % 2]), "en", "ab"[i % 2]) for i in range(120)] + [(500, text("b"), "en", "a"), (501, text("a"), "en", "b")]
    got = {x.doc_id: x.kept for x in rules.checked(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[500] and not got[501] and sum(got.values()) >= 118


def test_rules_of_tiny_groups(spark):
    """A lone document is judged by the others of its language, or by all: junk is rejected wherever it stands."""
    r = random.Random(12)
    good = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randint(0, 9999)) for _ in range(r.randint(60, 200))) for _ in range(300)]
    junk = " ".join("#$%&|<>*#$%&"[: 2 + i % 9] * 9 + str(i) for i in range(100))
    rows = [(i, t, "en", "a") for i, t in enumerate(good)] + [(900, junk, "en", "b"), (901, junk, "de", "c"), (902, good[0], "en", "d"), (903, good[1], None, None)]
    got = {x.doc_id: x.kept for x in rules.checked(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[900] and not got[901] and got[902] and got[903] and sum(got.values()) >= 298


def test_rules_by_brute_force(spark):
    """kept follows from the least-determinant estimate, found here by many random starts; row order doesn't matter."""
    from pyspark.sql import functions as F

    docs = documents(spark, SMALL).withColumn("lang", F.lit("en")).withColumn("source", F.lit("one"))
    rows = [r.asDict() for r in rules.checked(docs).collect()]
    again = {r.doc_id: r.kept for r in rules.checked(docs.orderBy(F.desc("doc_id")).repartition(3)).collect()}
    assert again == {r["doc_id"]: r["kept"] for r in rows}
    good = [r for r in rows if not r["base_failed"]]
    x = np.array([_vector(r) for r in good]) / rules.UNIT
    det, mean, cov = _least(x, np.random.default_rng(3))
    full = cov + np.diag(np.maximum(0, rules.FLOOR**2 - np.diag(cov)) + 1e-6)
    d = x - mean
    far = (d @ np.linalg.inv(full * rules.H / rules.CHI7_H) * d).sum(1) > rules.CHI_FAR
    assert 0 < far.sum() and sum(bool(f) == r["kept"] for f, r in zip(far, good)) <= 0.02 * len(good)


def _vector(r):
    w, c = max(1, r["n_words"]), max(1, r["word_chars"])
    raw = (np.log1p(r["n_words"]), 3 * np.log(c / w), np.log1p(10 * r["n_symbols"] / c), np.log1p(r["n_dup_lines"]) / 2, np.sqrt(r["n_repeat_words"] / w))
    return [round(v * rules.UNIT) for v in raw]


def _least(x, g):
    """(determinant, mean, covariance) of the H share with the least determinant that random starts lead to."""
    h, best = int(np.ceil(rules.H * len(x))), (np.inf, None, None)
    for _ in range(60):
        near, last = x[g.choice(len(x), 8, False)], np.inf
        for _ in range(50):
            cov = np.cov(near.T, bias=True)
            full = cov + np.diag(np.maximum(0, rules.FLOOR**2 - np.diag(cov)) + 1e-6)
            det = np.linalg.det(full)
            if len(near) == h and det >= last * (1 - 1e-9):
                break
            last = det if len(near) == h else np.inf
            d = x - near.mean(0)
            near = x[np.argsort((d @ np.linalg.inv(full) * d).sum(1))[:h]]
        if last < best[0]:
            best = (last, near.mean(0), np.cov(near.T, bias=True))
    return best


def test_rules_take_the_least_determinant(spark):
    g = np.random.default_rng(10)
    rows, want = [], {}
    for k in range(6):
        x = g.normal(size=(80, 5)) @ g.normal(size=(5, 5))
        x[:16] = x[:16] * 0.3 + g.normal(size=5) * 6
        x = np.round(x * 1024).astype(int)
        rows += [(f"g{k}", *row) for row in x.tolist()]
        want[f"g{k}"] = np.inf
        for _ in range(60):
            near, last = x[g.choice(80, 8, False)] / 1024, np.inf
            while True:
                cov = np.cov(near.T, bias=True) + 1e-6 * np.eye(5)
                if np.linalg.det(cov) >= last and len(near) == 60:
                    break
                last = np.linalg.det(cov) if len(near) == 60 else np.inf
                d = x / 1024 - near.mean(0)
                near = x[np.argsort((d @ np.linalg.inv(cov) * d).sum(1))[:60]] / 1024
            want[f"g{k}"] = min(want[f"g{k}"], last)
    got = rules.estimates(spark.createDataFrame(rows, ["grp", *rules.X])).collect()
    assert {r.grp for r in got} == set(want)
    assert all(r.det < 1.1 * want[r.grp] for r in got), [(r.det / want[r.grp], r.start) for r in got]


def _bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_licenses(spark, none):
    texts = ["Licensed under the Apache License, Version 2.0.", "x CC BY cc-by MIT  License", None, "", "the gnu general public license!", "commit licenses", "SPDX-License-Identifier: MPL-2.0"]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].labels) == (1, 3, 3, "apache", "apache,apache-2.0")
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (7, 3, 1, 5, "cc-by,mit")
    assert all(got[i].labels == "" and got[i].first_word is None and got[i].score == 0 for i in (2, 3, 5))
    assert got[4].base_labels == "gpl" and got[6].labels == "mpl-2.0" and got[6].base_labels == ""
    assert licenses.scanned(none).collect() == [] and len(licenses.rules()) > 200


def written(pattern, r):
    """A text that a pattern matches, with random choices."""
    out = []
    for op, arg in pattern:
        op = str(op)
        if op == "LITERAL":
            out.append(chr(arg))
        elif op == "ANY":
            out.append("x")
        elif op == "IN":
            kind, c = r.choice(arg)
            out.append(chr(c) if str(kind) == "LITERAL" else "7")
        elif op == "BRANCH":
            out.append(written(r.choice(arg[1]), r))
        elif op == "SUBPATTERN":
            out.append(written(arg[-1], r))
        elif op.endswith("REPEAT"):
            out += [written(arg[2], r) for _ in range(r.randint(arg[0], min(arg[1], 9)))]
        else:
            assert op.startswith("ASSERT")
    return "".join(out)


def test_license_keywords_lose_no_match():
    r, table = random.Random(8), licenses.rules()
    for *_, words, pattern in table:
        for _ in range(12):
            norm = written(re._parser.parse(pattern.pattern.decode()), r).encode() + b" "
            assert pattern.search(norm) is None or any(w in norm for w in words), (words, norm)
            every = [(m.start(), m.end(), p, t, label) for p, t, label, _, x in table for m in x.finditer(norm)]
            assert licenses.detect(norm, table) == licenses.stand(every), norm


def test_licenses_without_their_short_names(spark):
    cases = [
        ("under Common Development and Distribution License", "cddl-1.0"),
        ("the Zero-Clause BSD License", "0bsd"),
        ("The person who associated a work with this deed has dedicated the work to the public domain.", "cc0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License.", "mpl-2.0"),
        ("MIT No Attribution", "mit-0"),
        ("Apache License 2.0", "apache,apache-2.0"),
        ("GPLv3", "gpl-3.0"),
        ("GPL-2.0", "gpl-2.0"),
        ("GNU General Public License v3", "gpl,gpl-3.0"),
        ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "gpl"),
    ]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(len(cases))] == [x for _, x in cases] and all(r.score > 0 for r in got.values())


def test_licenses_of_odd_texts(spark, odd):
    rows = licenses.scanned(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect()) and all(r.labels == "" for r in rows)
    many = spark.createDataFrame([(1, "mit license " * 200_000), (1, "x " * 300_000 + "cc by"), (2, "y" * 500_000)], "doc_id long, text string")
    got = licenses.scanned(many).orderBy("doc_id", "n_words").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word) for r in got] == [(300_002, 1, 300_000, 300_000), (400_000, 200_000, 0, 399_998), (1, 0, None, None)]


def test_containment():
    d = [(0, 50, 2, 0.9, "long"), (10, 30, 6, 0.7, "inside"), (40, 60, 6, 0.7, "overlap"), (10, 30, 1, 0.99, "better")]
    assert {x[4] for x in licenses.stand(list(d))} == {"long", "overlap", "better"}


def test_toxicity(spark, odd, none):
    docs, labels = documents(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    y = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
    apart = {t: [rows[i].predicted for i in y if rows[i].held_out and y[i] == t] for t in (0, 1)}  # not learnt from
    assert np.mean(apart[1]) >= 0.8 and np.mean(apart[0]) <= 0.01
    assert len(toxicity.scored(odd, labels.limit(0)).collect()) == len(odd.collect()) and toxicity.scored(none, labels).collect() == []
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


def test_counterfactual_term():
    """A group term that goes with toxic labels by chance gets hardly any weight, as its swapped twin must score alike."""
    r = random.Random(4)
    texts, y = [], []
    for _ in range(600):
        bad = r.random() < 0.3
        group = r.choice(["muslim", "christian"] if not bad else ["muslim"] * 5 + ["christian"])
        texts.append(" ".join([words(5, r.random()), group, "idiot" if bad and r.random() < 0.8 else "neighbour"]))
        y.append(float(bad))
    assert toxicity.swap("A Muslim she, muslims x") == "A christian he, christians x"
    x, twin = toxicity._rows(texts), toxicity._rows([toxicity.swap(t) for t in texts])
    probe = toxicity._rows(["muslim neighbour", "christian neighbour"])

    def gap(twins):
        w, b = toxicity.fit(np.array(y), x, twins)
        s = toxicity.Sparse(probe)
        z = s.score(w[s.names])
        return abs(z[0] - z[1])

    assert gap(twin) < 0.5 * gap([None] * len(x))


def test_trained_models_on_odd_texts(spark, odd, monkeypatch):
    """Nulls, empty and long texts, repeats and clashing names meet trained models; the sample is bounded in bytes; columns that
    aren't the text change nothing."""
    from pyspark.sql import functions as F

    mid = SMALL.replace("0.001", "0.01")
    docs, labels = documents(spark, mid), spark.read.parquet(f"{mid}/labels.parquet")
    both = docs.select("doc_id", "text", "lang", "source").union(odd.select(F.col("doc_id") + 10_000_000, "text", "lang", "source"))
    both = both.union(both.where("doc_id % 7 = 0")).withColumn("score", F.lit(7)).withColumn("y", F.lit("x")).withColumn("h", F.lit(1))
    for one, limit in ((toxicity, 2 << 20), (quality, None)):
        if limit:
            monkeypatch.setattr(toxicity, "SAMPLE_BYTES", limit)
        got = one.scored(both, labels).collect()
        other = one.scored(both.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")).orderBy(F.desc("doc_id")), labels).collect()
        assert len(got) == both.count() and sorted(map(str, got)) == sorted(map(str, other))
        assert all(0 <= r.score <= 1 for r in got) and len({round(r.score, 6) for r in got}) > 10
        by = {r.doc_id: r.score for r in got}
        assert by[10_000_003] == by[10_000_004] and by[10_000_000] == by[10_000_001]  # null and empty; copies


def test_quality(spark, odd, none):
    docs, labels = documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if rows[r.doc_id].held_out}
    good, bad = [rows[i].score for i in y if y[i] == 1], [rows[i].score for i in y if y[i] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([x >= 0.3 for x in good]) > 0.85 and np.mean([x >= 0.3 for x in bad]) < 0.2
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert {r.score for r in quality.scored(odd, labels.limit(0)).collect()} == {0.5} and quality.scored(none, labels).collect() == []


def test_pipeline(spark, duck, same, tmp_path):
    """Each stage against brute force or SQL on what its predecessor kept; the whole gives the last stage's rows."""
    import corpus_pipeline
    import duckdb

    steps = dict(corpus_pipeline.STAGES)
    docs = documents(spark, SMALL)

    def step(name):
        out = steps[name](spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    scores = {r.doc_id: r.predicted for r in toxicity.scored(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    rows = docs.collect()
    docs = step("toxicity")
    assert docs.columns == documents(spark, SMALL).columns and sorted(docs.collect()) == sorted(r for r in rows if not scores[r.doc_id])

    rows = docs.collect()
    comp = near([(r.doc_id, r.text) for r in rows])
    docs = step("near copies")
    assert sorted(docs.collect()) == sorted(r for r in rows if comp[r.doc_id] == r.doc_id) and docs.count() < len(rows)

    rows = docs.collect()
    sha = {r[0]: r[4] for r in cut([(r.doc_id, r.text) for r in rows])}
    docs = step("repeated strings")
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {r.doc_id for r in rows} and all(r.n_chars == len(r.text) for r in got.values())
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == sha[i] for i, r in got.items() if "\ufffd" not in r.text) and any(got[r.doc_id].text != r.text for r in rows)

    def sql(text):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{at}/*.parquet'")
        return con.execute(text).df()

    at, rows = "repeated strings", docs.collect()
    want = collections.Counter({r.doc_id: int(r.taken // max(1, r["size"])) for _, r in sql(mixing.SQL).iterrows() if r["size"]})
    docs = step("mixing")
    drawn = collections.Counter(r.doc_id for r in docs.collect())
    sizes = {r.doc_id: len((r.text or "").split()) for r in rows}
    assert {i: n for i, n in drawn.items() if sizes[i]} == {i: n for i, n in want.items() if n}

    at = "mixing"
    last = step("packing")
    same(last.toPandas(), sql(packing.SQL))
    assert sorted(corpus_pipeline.run(spark, SMALL).collect()) == sorted(last.collect())


def test_pipeline_on_odd_tables(spark, odd, none):
    import corpus_pipeline

    for docs in (odd, none):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL).cache()
            assert name == "packing" or out.columns == docs.columns
            assert (out.count() > 0) == (n > 0)
            docs = out


def test_shards_keep_equal_texts_together(spark, monkeypatch):
    """Within a shard rows stand by text; a group of equal texts spreads over neighbouring shards only if it must; shards are
    equal within the tolerance."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "PIECE_ROWS", 500)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 700).cast("string")).alias("text"))
    rows = sharding.sharded(docs).orderBy("shard", "slot").collect()
    assert len(rows) == 6000
    place = collections.defaultdict(list)
    for i, r in enumerate(rows):
        place[r.text_crc32].append(i)
    assert all(p == list(range(p[0], p[0] + len(p))) for p in place.values())
    size = collections.Counter()
    for r in rows:
        size[r.shard] += r["size"]
    assert len(size) == 16 and max(size.values()) - min(size.values()) <= 2 * (0.002 * sum(size.values()) / 16 + max(r["size"] for r in rows))


def test_mixing_comes_near_its_targets(spark):
    """Per source, taken words miss the target by less than a hundredth, though a source's longest document is a tenth of it."""
    got = mixing.copies(documents(spark, SMALL.replace("0.001", "0.1"))).toPandas()
    g = got.assign(taken=got["size"] * got.copies).groupby("source").agg(t=("target", "first"), k=("taken", "sum"), m=("size", "max"))
    assert ((g.k - g.t).abs() <= 0.01 * g.t).all(), ((g.k - g.t).abs() / g.t).max()


def test_clashing_columns(spark):
    """A user's columns named like an operator's own stay as they are."""
    rows = [(i, f"some words of text {i % 5} " * (1 + i % 3), "s", 77, 78, "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copy int, copies int, `a.b` string")
    for out in (mixing.mix(docs), minhash.drop_near_duplicates(docs), suffix.drop_repeated_strings(docs)):
        assert out.columns == docs.columns and {(r["_copy"], r["copies"], r["a.b"]) for r in out.collect()} == {(77, 78, "x")}


def shared(spark):
    import os

    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return set(os.listdir(base))


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pipeline"])
def test_tables_are_deleted(spark, name):
    """An operator leaves one table in the shared folder at most: its result."""
    before = shared(spark)
    out = QUERIES[name](spark, SMALL)
    assert len(shared(spark) - before) <= 1 and out.count() > 0


def test_tables_of_the_pipeline_are_deleted(spark):
    import os

    before = shared(spark)
    out = QUERIES["pipeline"](spark, SMALL)
    (left,) = shared(spark) - before
    assert len(os.listdir(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/{left}")) == 1 and out.count() > 0


def test_tables_of_an_operator_that_fails(spark):
    before = shared(spark)
    with pytest.raises(Exception, match="doesn't fit a long"):
        topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [1e300])], "vec_id long, embedding array<double>"))
    assert shared(spark) == before


def test_mixing_has_one_prefix_sum_for_each_source(spark):
    """The copies of a source are the floor of its expected copies plus its offset: whatever its classes, no emission is
    lost or made between them."""
    docs = documents(spark, SMALL.replace("0.001", "0.01"))
    light = docs.select("source", mixing.word_count(docs.text).alias("size")).toPandas()
    light["g"] = np.floor(np.log2(light["size"] + 1) * 8).astype(int)
    known = mixing.targets(spark.createDataFrame(light.groupby("source")["size"].sum().reset_index().rename(columns={"size": "source_size"}), "source string, source_size long"))
    classes = light.groupby(["source", "g"])["size"].agg(["count", "sum"]).reset_index()
    classes = spark.createDataFrame(classes, "source string, g int, n long, size long")
    given = mixing.rates(classes, known, 7).join(classes, ["source", "g"]).toPandas()
    got = mixing.copies(docs).toPandas().groupby("source").copies.sum()
    for source, rows in given.groupby("source"):
        rows = rows.sort_values("g", ascending=False)
        upto = 0.0
        for r in rows.itertuples():
            assert r.base == pytest.approx(upto)
            upto = r.base + r.n * r.r
        assert got[source] == np.floor(upto + rows.u.iloc[0])


def test_identity_terms_that_only_fold_alike(spark):
    """Words that Unicode folds to a term, but that aren't spelt like one, stay; training goes on."""
    odd = "\u017fhe is here, chr\u0131stian and musl\u0130m women"
    assert toxicity.swap(odd) == odd.replace("women", "men")
    docs = spark.createDataFrame([(i, f"{odd} {'hate' if i % 2 else 'fine'} {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(docs, labels).count() == 40


def test_identity_terms_of_four_languages():
    for text, twin in (
        ("Women and a black man", "men and a white woman"),
        ("Les femmes et un homme noir", "Les hommes et un femme blanc"),
        ("Die Frauen und ein christlicher Mann", "Die männer und ein christlicher frau"),
        ("Las mujeres y un hombre judío", "Las hombres y un mujer hindú"),
    ):
        assert toxicity.swap(text).lower() == twin.lower()
    assert all(toxicity._SWAP[t] != t for kind in toxicity.IDENTITY for t in kind)


LONG = " ".join(f"w{i % 997} word{i % 89}" for i in range(100_000))  # over a megabyte


@pytest.fixture(scope="module")
def long_rows(spark):
    rows = [(i, f"{words(30 + i % 50, i)} line {i}\n" * (1 + i % 2), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, LONG, "en", "s0"), (101, LONG + " more", "en", "s1"), (102, "x" * 1_200_000, "en", "s2"), (103, "\n" * 1_000_000, "en", "s0")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_very_long_texts(spark, long_rows):
    """Texts of over a megabyte pass whole through every operator on documents."""
    rows = {r.doc_id: r.text for r in long_rows.collect()}
    count = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows.items()}
    assert {r.doc_id: r["size"] for r in mixing.copies(long_rows).collect()} == count
    assert {r.doc_id: r.n_tokens for r in packing.packed(long_rows).collect()} == count
    assert {r.doc_id: r.n_words for r in rules.checked(long_rows).collect()} == count
    assert {r.doc_id: r["size"] for r in sharding.sharded(long_rows).collect()} == {i: len(t.encode()) + 1 for i, t in rows.items()}
    got = {r.doc_id: r for r in minhash.near_duplicates(long_rows).collect()}
    assert got[101].component_id == 100 and got[100].n_shingles == len(shingles(LONG)) and got[103].n_shingles == 0
    cuts = {r.doc_id: r for r in suffix.repeated_strings(long_rows).collect()}
    # the words repeat within the text, so its last ones stand before a space there as well
    assert cuts[100].n_removed == 0 and cuts[101].n_removed == len(LONG) + 1 and cuts[102].n_bytes == 1_200_000
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (*range(40), 100, 101, 102, 103)], "doc_id long, quality int, toxic int")
    for out in (quality.scored(long_rows, labels), toxicity.scored(long_rows, labels)):
        assert {r.doc_id for r in out.collect()} == set(rows) and out.where("score < 0 or score > 1 or score is null").count() == 0


def test_very_long_texts_in_the_pipeline(spark, long_rows, tmp_path):
    import corpus_pipeline

    long_rows.select("*", long_rows.text.substr(1, 5).alias("extra")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


WORD = r"[^\x20\x09-\x0D]+"


def test_base_columns_of_rules(spark, odd):
    """What the quality rules count, against a count by hand, on the small table and on odd rows."""

    def counted(text):
        text = text or ""
        w = re.findall(WORD, text)
        five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = collections.Counter(five)
        held = {i + k for i, x in enumerate(five) if often[x] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(WORD, x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held)

    for docs in (documents(spark, SMALL), odd):
        want = sorted((r.doc_id is None, r.doc_id or 0, *counted(r.text)) for r in docs.select("doc_id", "text").collect())
        rows = rules.checked(docs).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in rows)


def test_base_columns_of_licenses(spark, odd):
    """Words and places of the fixed phrases, against a search by hand."""
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

    def scan(text):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))

    more = spark.createDataFrame([(1, "MIT License, the Apache-License; cc by cc by\nGNU general public LICENSE mit licenses"), (2, "cc\u00e9 by cc\x00by"), (3, None)], "doc_id long, text string")
    for docs in (documents(spark, SMALL), odd, more):
        want = sorted(((r.doc_id, *scan(r.text)) for r in docs.select("doc_id", "text").collect()), key=str)
        got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scanned(docs).collect()), key=str)
        assert got == want


def test_sharding_against_the_texts(spark):
    """Sizes and checksums by hand, slots without gaps, sizes of shards near equal."""
    rows = {r.doc_id: r.text for r in documents(spark, SMALL).collect()}
    got = sharding.sharded(documents(spark, SMALL)).toPandas()
    assert {r.doc_id: (r["size"], r.text_crc32) for _, r in got.iterrows()} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows.items()}
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard")) and set(got.shard) == set(range(16))
    total = got.groupby("shard")["size"].sum()
    assert total.max() - total.min() <= 2 * got["size"].max()
