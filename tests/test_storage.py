"""Commits, snapshots, indexes, the ledger and feeds: what readers and several writers see, and what a crash leaves."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import records, retrieval
from pagewright.storage.feed import Feed
from pagewright.storage.ledger import Ledger, ProviderError
from pagewright.storage.log import Files, Log
from pagewright.storage.postings import Index
from pagewright.storage.snapshots import Conflict, Table
from pagewright.storage.vectors import VectorIndex

SMALL = "/root/testdata/sf0.001"


def rows(spark, *x, schema="document_id long, text string"):
    return spark.createDataFrame(list(x), schema)


def held(table, **more):
    return sorted(tuple(r) for r in table.read(**more).select("document_id", "text").collect())


# ---- the log


def test_a_version_is_put_once(spark, tmp_path):
    log = Log(Files(spark, str(tmp_path / "t")))
    assert log.latest() == (-1, {})
    won, start = [], threading.Barrier(8)

    def put(i):
        start.wait()
        if log.put(0, {"by": i}):
            won.append(i)

    threads = [threading.Thread(target=put, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and log.latest() == (0, {"by": won[0]})
    assert log.put(1, {"by": "x"}) and not log.put(1, {"by": "y"}) and log.versions() == [0, 1]
    assert log.forget(1) == [{"by": "x"}] and log.versions() == [1]
    assert not [p for p in (tmp_path / "t" / "_log").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_a_version_is_put_once_by_rename(spark, tmp_path, monkeypatch):
    """Elsewhere than on a local file system."""
    files = Files(spark, str(tmp_path / "t"))

    class Other:
        def __getattr__(self, name):
            return getattr(real, name)

        def getUri(self):
            class Uri:
                def getScheme(self):
                    return "other"

            return Uri() if asked.pop() else real.getUri()

    real, asked = files.fs, [False, True, False, True]
    files.fs = Other()
    log = Log(files)
    assert log.put(0, {"n": 1})
    assert not log.put(0, {"n": 2}) and log.latest() == (0, {"n": 1})


# ---- tables


def test_publish(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        t.read()
    with pytest.raises(FileNotFoundError):
        t.delete(rows(spark, (1, "")))
    t.publish(rows(spark, (1, "a"), (1, "b"), (2, "c")))
    before = t.read()
    t.publish(rows(spark, (1, "new")))
    assert held(t) == [(1, "new"), (2, "c")]
    t.publish(rows(spark, (1, "new")))
    assert held(t) == [(1, "new"), (2, "c")]
    t.publish(rows(spark, (9, "x")).limit(0), documents=rows(spark, (2, "")))
    assert held(t) == [(1, "new")] and held(t, version=1) == [(1, "new"), (2, "c")]
    # who opened the first version still reads it
    assert sorted(map(tuple, before.collect())) == [(1, "a"), (1, "b"), (2, "c")]
    t.publish(rows(spark, (3, "z", 7), schema="document_id long, text string, more int"))
    assert sorted((r.document_id, r.more) for r in t.read().collect()) == [(1, None), (3, 7)]
    with pytest.raises(TypeError):
        t.publish(rows(spark, (3, 5), schema="document_id long, text int"))
    assert t.publish(rows(spark).limit(0)) == t.snapshot().version


def test_changes(spark, tmp_path):
    schema = "id long, text string, error string"
    t = Table(spark, str(tmp_path / "t"), key="id", bucket_rows=3)
    t.publish(rows(spark, *((i, f"t{i}", "e") for i in range(20)), schema=schema))
    t.patch(rows(spark, (3, "new", None), (99, "no", None), schema=schema))
    t.replace(rows(spark, (4, "whole", "x"), (98, "no", "x"), schema=schema))
    t.delete(rows(spark, (5,), (6,), schema="id long"), guard=F.col("text") != "t6")
    t.insert(rows(spark, (20, "t20", "e"), schema=schema))
    want = {i: (f"t{i}", "e") for i in range(21)} | {3: ("new", "e"), 4: ("whole", None)}
    del want[5]
    assert {r.id: (r.text, r.error) for r in t.read().collect()} == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_buckets_split_as_the_table_grows(spark, tmp_path, kind):
    t = Table(spark, str(tmp_path / "t"), bucket_rows=20)
    schema = f"document_id {kind}, text string"
    name = (lambda i: i) if kind == "long" else (lambda i: f"d{i}")
    want = {}
    for step in range(4):
        new = [(name(i), f"{step}") for i in range(step * 50, step * 50 + 100)] + [(name(7), "hot")] * 60
        t.publish(rows(spark, *new, schema=schema))
        want = {k: v for k, v in want.items() if k not in {i for i, _ in new}}
        for i, x in new:
            want.setdefault(i, []).append(x)
        assert held(t) == sorted((k, x) for k, xs in want.items() for x in xs)
    now = t.snapshot()
    assert sum(b.rows for b in now.buckets) == sum(map(len, want.values()))
    large = [b for b in now.buckets if b.rows > 20]
    assert len(now.buckets) > 8 and len(large) <= 1  # that of the one document with 60 rows
    # buckets cover all hashes once
    assert sum(2.0**-b.bits for b in now.buckets) == 1
    # a publish of one document writes one bucket anew
    t.publish(rows(spark, (name(11), "one"), schema=schema))
    assert len(set(now.buckets) - set(t.snapshot().buckets)) == 1
    # a read by key opens its bucket only
    one = t.read(keys=[name(11), name(10**6)])
    assert [r.text for r in one.collect()] == ["one"] and len(one.inputFiles()) < len(t.read().inputFiles())


def test_a_reader_sees_old_or_new(spark, tmp_path):
    """While documents are published together again and again, no reader sees some old and some new."""
    t = Table(spark, str(tmp_path / "t"), bucket_rows=2)
    publish = lambda k: t.publish(spark.range(12).select(F.col("id").alias("document_id"), F.lit(str(k)).alias("text")))
    publish(0)
    seen, over = [], threading.Event()

    def read():
        while not over.is_set():
            seen.append({r.text for r in t.read().collect()})

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 6):
        publish(k)
    over.set()
    reader.join()
    assert seen and all(len(s) == 1 for s in seen) and held(t) == [(i, "5") for i in range(12)]


def test_two_writers(spark, tmp_path):
    """Neither loses rows: on different buckets both commits stand, on the same one the second is done again."""
    t = Table(spark, str(tmp_path / "t"), bucket_rows=2)
    t.publish(spark.range(30).select(F.col("id").alias("document_id"), F.lit("old").alias("text")))
    calls = []

    def between():
        if not calls:  # another writer is first
            calls.append(1)
            Table(spark, str(tmp_path / "t"), bucket_rows=2).insert(rows(spark, (1, "other"), (2, "other")))

    work = []
    t.update(rows(spark, (1, ""), (3, "")), lambda old: work.append(1) or old.withColumn("text", F.when(F.col("document_id").isin(1, 3), F.concat("text", F.lit("+"))).otherwise(F.col("text"))), before_commit=between)
    got = held(t)
    assert len(work) == 2 and [x for i, x in got if i == 1] == ["old+", "other+"] and (2, "other") in got and (3, "old+") in got and len(got) == 32
    calls.clear()
    apart = next(i for i in range(3, 30) if not set(t._touched(t.snapshot(), rows(spark, (i, "")))) & set(t._touched(t.snapshot(), rows(spark, (1, ""), (2, "")))))
    work.clear()
    t.update(rows(spark, (apart, "")), lambda old: work.append(1) or old.withColumn("text", F.lit("mine")), before_commit=between)
    assert len(work) == 1 and (apart, "mine") in held(t) and len(held(t)) == 34

    def always():
        Table(spark, str(tmp_path / "t"), bucket_rows=2).insert(rows(spark, (1, "again")))

    with pytest.raises(Conflict):
        t.update(rows(spark, (1, "")), lambda old: old, attempts=2, before_commit=always)


def test_writers_in_threads(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), bucket_rows=4)
    t.publish(rows(spark, (0, "first")))
    failed = []

    def write(k):
        try:
            for i in range(3):
                Table(spark, str(tmp_path / "t"), bucket_rows=4).insert(rows(spark, (k, f"{k}.{i}")), attempts=20)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2, 3)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not failed and held(t) == [(0, "first")] + [(k, f"{k}.{i}") for k in (1, 2, 3) for i in range(3)]


def test_a_crash_leaves_the_table(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.publish(rows(spark, (1, "a"), (2, "b")))

    def crash():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        t.publish(rows(spark, (1, "half")), before_commit=crash)
    assert held(t) == [(1, "a"), (2, "b")] and t.snapshot().version == 0
    with pytest.raises(Exception, match="isn't one of those"):
        Table(spark, str(tmp_path / "t"), bucket_rows=1).publish(rows(spark, *((i, "x") for i in range(40))))
        Table(spark, str(tmp_path / "t"), bucket_rows=1).update(rows(spark, (1, "")), lambda old: spark.range(50).select(F.col("id").alias("document_id"), F.lit("x").alias("text")))
    n = len(list((tmp_path / "t" / "data").iterdir()))
    assert t.vacuum(keep=1, grace=3600) == 0
    before = held(t)
    t.vacuum(keep=1, grace=0)
    assert held(t) == before and len(list((tmp_path / "t" / "data").iterdir())) < n


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    for n in (0, 1, 1, 0, 2):
        t.insert(rows(spark, (n, f"batch {n}")), applied=("writer", n))
    t.insert(rows(spark, (0, "other")), applied=("other", 0))
    assert held(t) == [(0, "batch 0"), (0, "other"), (1, "batch 1"), (2, "batch 2")]


def test_feeds(spark, tmp_path):
    f = Feed(spark, str(tmp_path / "f"))
    events = lambda *x: spark.createDataFrame([(t,) for t in x], "value string")
    assert f.read().collect() == []
    assert f.append(events("a", "b"), "w", 0) and f.append(events("c"), "w", 1) and not f.append(events("c"), "w", 1) and not f.append(events("a"), "w", 0)
    assert f.append(events("d"), "v", 0)
    assert sorted(r.value for r in f.read().collect()) == ["a", "b", "c", "d"] and [r.value for r in f.read(after=1).collect()] == ["d"]
    assert len([p for p in (tmp_path / "f" / "data").iterdir()]) == 3
    # a stream whose checkpoint lost its last commit does a batch again
    events("x", "y").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("value string").parquet(str(tmp_path / "in")).writeStream.foreachBatch(f.sink("stream")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(60)
    assert stream()
    for p in (tmp_path / "ck" / "commits").iterdir():
        p.unlink()
    assert stream() and sorted(r.value for r in f.read(after=2).collect()) == ["x", "y"]


# ---- cursors


def test_composite_cursors(spark):
    """Every row once, in order, with nulls and ties."""
    r = random.Random(1)
    data = [(i, r.choice([None, 1.5, -0.1, 2.25, 1e300]), r.choice([None, "a", "b", "é,\"\\"]), i % 3 == 0) for i in range(120)]
    df = spark.createDataFrame(data, "id long, price double, name string, flag boolean")
    for order in ([("price", "desc"), ("name", "asc"), ("id", "desc")], [("flag", "asc"), ("price", "asc"), ("id", "asc")], [("name", "desc"), ("id", "asc")]):
        want = [x.id for x in df.where("id <> 7").orderBy(*records._sorted_by(order)).collect()]
        got, cursor, done = [], None, False
        while not done:
            page = records.sorted_page(df, [{"field": "id", "operator": "ne", "value": 7}], order, 17, cursor).collect()
            got += [x.id for x in page]
            cursor, done = page[-1].continue_cursor, page[-1].is_done
        assert got == want
    with pytest.raises(ValueError):
        records.sorted_page(df, [], [("id", "asc")], 5, cursor)
    assert records.sorted_page(df.limit(0), [], [("id", "asc")], 5).collect() == []


def test_cursors_on_a_snapshot(spark, tmp_path):
    """What is written between two pages neither repeats nor hides a row."""
    t = Table(spark, str(tmp_path / "t"))
    t.publish(spark.range(30).select(F.col("id").alias("document_id"), (F.col("id") % 4).cast("string").alias("text")))
    order, cursor, got = [("text", "desc"), ("document_id", "asc")], None, []
    version = t.snapshot().version
    while True:
        page = records.sorted_page(t.read(records.cursor_version(cursor) if cursor else version), [], order, 7, cursor, version).collect()
        got += [r.document_id for r in page]
        if page[-1].is_done:
            break
        cursor = page[-1].continue_cursor
        t.publish(rows(spark, (got[-1] + 1, "9"), (100 + len(got), "0")))
    assert got == sorted(range(30), key=lambda i: (-(i % 4), i))


def test_cursors_reach_the_scan(spark):
    df = spark.read.parquet(f"{SMALL}/orders.parquet")
    order = [("o_totalprice", "desc"), ("o_orderkey", "asc")]
    first = records.sorted_page(df, [], order, 5).collect()
    plan = records.sorted_page(df, [], order, 5, first[-1].continue_cursor)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(o_totalprice" in plan


# ---- the posting index


def corpus(n, seed=1, words=60):
    r = random.Random(seed)
    return [(i, " ".join(f"w{min(r.randrange(words), r.randrange(words))}" for _ in range(r.randint(0, 40)))) for i in range(n)]


def same_as_scan(index, live, queries, spark, key=None, k=12):
    df = spark.createDataFrame(live, "id long, text string, owner string") if key is not None or len(live[0]) == 3 else spark.createDataFrame(live, "id long, text string")
    base = df if key is None else df.where(F.col("owner") == key)
    for q in queries:
        want = [tuple(r) for r in retrieval.lexical_top_k(base, q, k).orderBy("rank").collect()]
        assert [tuple(r) for r in index.top_k(q, k, key).orderBy("rank").collect()] == want, q


def test_posting_index(spark, tmp_path, monkeypatch):
    from pagewright.storage import postings

    monkeypatch.setattr(postings, "BLOCK", 8)
    monkeypatch.setattr(postings, "SEEN", 2)
    queries = ["w0 w1 W7 w55 nothing", "w59"]
    index = Index(spark, str(tmp_path / "i"))
    assert index.top_k("w1").collect() == []
    docs = dict(corpus(300))
    docs[300] = None
    index.add(spark.createDataFrame(list(docs.items()), "id long, text string"))
    same_as_scan(index, list(docs.items()), [*queries, "nothing", "", "w0 w1 w2 w3 w4 w5 w6"], spark)
    new = dict(corpus(60, 2)) | {i: f"w1 w{i % 60} fresh" for i in range(400, 450)}  # sixty are other texts of known ids
    index.add(spark.createDataFrame(list(new.items()), "id long, text string"))
    docs |= new
    same_as_scan(index, list(docs.items()), ["fresh w1"], spark)
    gone = [i for i in docs if i % 7 == 0]
    index.delete(spark.createDataFrame([(i,) for i in gone + [10**6]], "id long"))
    docs = {i: t for i, t in docs.items() if i not in gone}
    same_as_scan(index, list(docs.items()), [*queries, "fresh w1"], spark)
    index.compact()
    assert len(index._segments()) == 1 and {r.id for r in index.ids().collect()} == set(docs)
    index.vacuum(keep=1, grace=0)
    same_as_scan(index, list(docs.items()), [*queries, "fresh w1"], spark)
    assert len(list((tmp_path / "i" / "segments").iterdir())) == 1
    index.delete(spark.createDataFrame([(i,) for i in docs], "id long"))
    assert index.top_k("w1").collect() == [] and index.ids() is None


def test_posting_index_by_owner(spark, tmp_path):
    """N, lengths and df are the owner's; a key without documents finds nothing."""
    docs = [(i, t, f"o{i % 3}") for i, t in corpus(200, 3)]
    index = Index(spark, str(tmp_path / "i"), key="owner")
    df = spark.createDataFrame(docs, "id long, text string, owner string")
    index.add(df.where("id < 150"))
    index.add(df.where("id >= 140"))
    index.delete(spark.createDataFrame([(3,), (4,)], "id long"))
    live = [d for d in docs if d[0] not in (3, 4)]
    for key in ("o0", "none"):
        same_as_scan(index, live, ["w0 w50 w2"], spark, key)


def test_postings_are_read_by_term(spark, tmp_path):
    """The plan opens the files of the query's terms and pushes them to the scan; heads are read without postings."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = Index(spark, str(tmp_path / "i"))
        index.add(spark.createDataFrame(corpus(400, 4), "id long, text string"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = len([p for p in (tmp_path / "i").glob("segments/*/postings/*.parquet")])
    ((_, blocks),) = index.postings(["w17"])
    assert len(blocks.inputFiles()) < files
    plan = blocks.select("window", "n", "tf", "dl")._jdf.queryExecution().toString()
    assert "EqualTo(term,w17)" in plan and "postings" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_block_bounds_leave_windows_out(spark, tmp_path, monkeypatch):
    """With one document far ahead, most windows are never scored."""
    from pagewright.storage import postings

    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "SEEN", 4)
    docs = [(i, "rare common " * 5 if i < 3 else "common " + "other " * 30) for i in range(200)]
    index = Index(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame(docs, "id long, text string"))
    scored, whole = [], index._scored

    def count(kept, *rest):
        scored.append(sum(b.select("window").distinct().count() for _, b in kept))
        return whole(kept, *rest)

    monkeypatch.setattr(index, "_scored", count)
    assert [r.id for r in index.top_k("rare common", 2).orderBy("rank").collect()] == [0, 1]
    assert scored[-1] <= 3 and index.postings(["common"])[0][1].select("window").distinct().count() > 30


# ---- the vector index


def test_vector_index(spark, tmp_path):
    r = np.random.default_rng(1)
    base = r.normal(size=(20, 16))
    x = {i: (base[i % 20] + 0.3 * r.normal(size=16)).tolist() for i in range(600)}
    x |= {600: [0.0] * 16, 601: [0.0] * 16}
    schema = "id long, embedding array<double>, label int"
    df = lambda d: spark.createDataFrame([(i, v, i % 4) for i, v in d.items()], schema)
    index = VectorIndex(spark, str(tmp_path / "v"), 16)
    index.add(df({1: [1.0]}))
    assert index.search(x[3]).collect() == []
    index.add(df({i: v for i, v in x.items() if i < 400}))
    index.add(df({i: x[i] for i in x if i >= 380}).union(spark.createDataFrame([(900, [1.0] * 15, 0), (901, None, 0), (902, [float("nan")] * 16, 0)], schema)))
    moved = {5: x[77], 6: (-np.array(x[6])).tolist()}
    index.add(df(moved))
    index.delete(spark.createDataFrame([(8,), (9,)], "id long"))
    live = {i: v for i, v in (x | moved).items() if i not in (8, 9)}
    for q in (x[77], [0.0] * 16, np.ones(16).tolist()):
        want = [tuple(t) for t in retrieval.vector_top_k(df(live), q).orderBy("rank").collect()]
        assert [tuple(t) for t in index.search(q, exact=True).orderBy("rank").collect()] == want
    found = 0
    for i in range(20, 28):
        want = {t.id for t in retrieval.vector_top_k(df(live), live[i], 10).collect()}
        found += len(want & {t.id for t in index.search(live[i], 10, probes=3).collect()})
    assert found >= 0.9 * 80
    with pytest.raises(ValueError):
        index.search([1.0])
    index.add(df({77: None, 97: [2.0]}))  # no vectors any more
    assert not {77, 97} & {r.id for r in index.ids().collect()}


def test_vector_index_with_a_filter(spark, tmp_path):
    """Lists are found by partition pruning, and the filter reaches their scan."""
    v = spark.read.parquet(f"{SMALL}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    index = VectorIndex(spark, str(tmp_path / "v"), 64, key="label")
    index.add(v)
    q = [float(c) for c in v.where("id = 7").first().embedding]
    for label in (3, 99):
        want = [tuple(t) for t in retrieval.vector_top_k(v, q, where=F.col("label") == label).orderBy("rank").collect()]
        assert [tuple(t) for t in index.search(q, key=label, exact=True).orderBy("rank").collect()] == want
    plan = index.probed([0, 1], 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan and "EqualTo(key,3)" in plan


def test_recall_of_the_vector_index(spark, tmp_path):
    """Over all queries whose id is divisible by 20, against brute force."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumnRenamed("vec_id", "id")
    index = VectorIndex(spark, str(tmp_path / "v"), 64)
    index.add(v)
    rows = v.select("id", "embedding").toPandas()
    x = np.array(rows["embedding"].tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rows["id"].to_numpy()
    ask = np.flatnonzero(ids % 20 == 0)
    listed = {}
    for s in index._segments():
        listed |= {r.id: set(r.at) for r in spark.read.parquet(f"{index.files.path}/{s['path']}/vectors").groupBy("id").agg(F.collect_set("list").alias("at")).collect()}
    c = index.centroids()
    lists = sorted({i for at in listed.values() for i in at})
    n = -(-len(lists) * 35 // 100)
    found = total = 0
    for a in ask:
        best = np.lexsort((ids, -np.round(x @ x[a], 9)))[:12]
        probed = set(sorted(lists, key=lambda i: np.arccos(np.clip(c[i] @ x[a], -1, 1)))[:n])
        found, total = found + sum(bool(listed[i] & probed) for i in ids[best].tolist()), total + len(best)
    assert len(ask) == 100 and found / total >= 0.9, found / total
    got = [r.id for r in index.search(list(map(float, rows["embedding"][ask[3]]))).collect()]
    best = ids[np.lexsort((ids, -np.round(x @ x[ask[3]], 9)))[:12]].tolist()
    assert len(got) == len(set(got)) == 12 and len(set(got) & set(best)) >= 9


# ---- the ledger


def test_each_text_is_asked_for_once(spark, tmp_path):
    """Over a failed and a repeated attempt."""
    said = tmp_path / "calls"
    said.mkdir()
    down = tmp_path / "down"
    down.touch()
    folder, flag = str(said), str(down)

    def provider(texts):
        import os
        import uuid

        if os.path.exists(flag) and any(t.startswith("w1") for t in texts):
            raise OSError("connection reset by peer")
        assert len(texts) <= 3
        for t in texts:
            open(f"{folder}/{uuid.uuid4().hex}", "w").write(t)
        return [t.upper() for t in texts]

    ledger = Ledger(spark, str(tmp_path / "ledger"))
    df = spark.createDataFrame([(i, f"w{i % 30}" if i % 31 else None) for i in range(200)], "id long, text string").repartition(7)
    ask = lambda: ledger.answered(df, F.col("text"), "m", provider, batch=3)
    with pytest.raises(ProviderError, match="connection reset"):
        ask()
    before = len(list(said.iterdir()))
    down.unlink()
    out = ask()
    for _ in range(2):
        assert {(r.id, r.text, r.answer) for r in out.collect()} == {(r.id, r.text, r.text and r.text.upper()) for r in df.collect()}
    assert ask().count() == 200 and out.columns == [*df.columns, "answer"]
    asked = [p.read_text() for p in said.iterdir()]
    assert len(asked) == len(set(asked)) == len({r.text for r in df.collect()} - {None}) and before < len(asked)
    more = ledger.answered(df.where('id < 3'), F.col("text"), "other", lambda texts: [[1.0, 2.0] for _ in texts], "array<double>")
    assert all(r.answer == [1.0, 2.0] for r in more.where("text is not null").collect())
    with pytest.raises(ProviderError, match="1 answers"):
        ledger.answered(df, F.col("text"), "short", lambda texts: texts[:1])


def test_a_new_table_is_written_once(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), bucket_rows=50)
    t.publish(spark.range(1000).select(F.col("id").alias("document_id"), F.lit("x").alias("text")))
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1  # rows were put into one bucket, read and split: two folders
    assert sum(b.rows for b in t.snapshot().buckets) == 1000 and t.read().count() == 1000


def test_postings_are_dealt_once(spark, tmp_path, monkeypatch):
    from pagewright.storage.postings import Index

    seen, stored = [], Index._stored
    monkeypatch.setattr(Index, "_stored", lambda self, segment, tf, n: (seen.append(tf), stored(self, segment, tf, n))[1])
    index = Index(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame([(1, "b a B c"), (2, None), (3, "a")], "id long, text string"))
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()  # tf took an exchange of all postings
    rows = spark.read.parquet(*[str(p) for p in (tmp_path / "i" / "segments").glob("*/postings")]).select("term", F.inline("postings"))
    assert sorted(map(tuple, rows.collect())) == [("a", 1, 1, 4), ("a", 3, 1, 1), ("b", 1, 2, 4), ("c", 1, 1, 4)]


def test_texts_are_cut_into_words_once(spark, tmp_path):
    """an index read and cut each text four times, twice only to learn where postings are dealt."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(t):
        read.add(1)
        return t

    texts = ["İx Naïve\x00a1 ß", "b", "", None, "b a", "-", "z" * 300, "ａ b-B"] * 50
    docs = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "id long, text string")
    index = Index(spark, str(tmp_path / "i"))
    index.add(df.withColumn("text", told("text").alias("text")))
    assert read.value == len(docs)
    same_as_scan(index, docs, ["a1 b x", "z" * 300, "na ve"], spark)
    assert not list((tmp_path / "i").glob("segments/*/made"))


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_what_is_gone_leaves_blocks(spark, tmp_path, monkeypatch, sent):
    """compaction takes postings out of their blocks, whether ids are sent to all tasks or joined."""
    from pagewright.storage import postings

    monkeypatch.setattr(postings, "GONE", sent)
    docs = corpus(120, 5)
    index = Index(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame(docs, "id long, text string"))
    index.add(spark.createDataFrame([(i, f"w1 new {i}") for i in range(10, 20)], "id long, text string"))
    index.delete(spark.createDataFrame([(i,) for i in range(40, 80)], "id long"))
    live = [(i, f"w1 new {i}" if 10 <= i < 20 else t) for i, t in docs if not 40 <= i < 80]
    index.compact()
    same_as_scan(index, live, ["w1 w2 new", "w7"], spark)
    ((_, blocks),) = index.postings(["w1"])
    assert sum(r.n for r in blocks.collect()) == sum("w1" in t.split() for _, t in live)
