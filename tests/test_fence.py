"""The fence by composition equals the fold, wherever a log is cut."""

import random

import numpy as np
import pytest

from pagewright.operators import fence

NAMES = ["begin", "ready", "failed", "retry", "other"]


def fold(log, status=0, attempt=0):
    n = 0
    for kind, a in log:
        if a is None or kind == 4:
            continue
        if kind == 0:
            if status != fence.READY and attempt < a:
                status, attempt, n = fence.PROCESSING, a, n + 1
        elif a == attempt:
            status, n = (fence.PROCESSING if kind == 3 else kind + 1), n + 1
    return status, attempt, n


def test_effects():
    r = random.Random(1)
    for _ in range(150):
        runs = [[(r.randrange(5), r.randint(-2, r.choice([2, 4, 9, 40]))) for _ in range(r.randint(1, 60))] for _ in range(r.randint(1, 9))]
        flat = np.array([e for run in runs for e in run])
        got = fence.effects(flat[:, 0], flat[:, 1], np.array([len(x) for x in runs]))
        whole, log = got[0], list(runs[0])
        for run, e in zip(runs[1:], got[1:]):
            whole, log = fence.compose(whole, e), log + run
        for s in range(4):
            for a in range(-3, 12):
                assert all(fence.apply(e, s, a) == fold(run, s, a) for run, e in zip(runs, got))
                assert fence.apply(whole, s, a) == fold(log, s, a)


def test_composition_is_associative():
    r = random.Random(2)
    for _ in range(50):
        flat = np.array([(r.randrange(5), r.randint(0, 6)) for _ in range(30)])
        f, g, h = fence.effects(flat[:, 0], flat[:, 1], np.array([10, 10, 10]))
        a, b = fence.compose(fence.compose(f, g), h), fence.compose(f, fence.compose(g, h))
        assert all((x == y).all() for x, y in zip(a, b))


def test_tables_of_many_attempts(monkeypatch):
    monkeypatch.setattr(fence, "CELLS", 100)
    r = random.Random(3)
    runs = [[(r.randrange(4), r.randint(0, 300)) for _ in range(n)] for n in (500, 1, 3, 200)]
    flat = np.array([e for run in runs for e in run])
    got = fence.effects(flat[:, 0], flat[:, 1], np.array([len(x) for x in runs]))
    assert [fence.apply(e, 0, 0) for e in got] == [fold(run) for run in runs]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_random_logs(spark, kind):
    """One document holds a third of all events; some have no id, an unknown kind or no attempt."""
    r = random.Random(4)
    log = []
    for i in range(6000):
        key = r.choice([None, *range(40)]) if r.random() > 0.34 else 7
        log.append((key if key is None or kind == "long" else f"d{key}", i, r.randrange(5), None if r.random() < 0.02 else r.randint(0, 5)))
    want = {}
    for key, _, k, a in log:
        want.setdefault(key, []).append((k, a))
    shuffled = r.sample(log, len(log))
    df = spark.createDataFrame([(k, i, NAMES[c], a) for k, i, c, a in shuffled], f"doc {kind}, seq long, kind string, attempt int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = fence.fence(df, "doc", "seq", "kind", "attempt").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc: (fence.STATUSES.index(r.status), r.attempt, r.applied) for r in rows} == {k: fold(v) for k, v in want.items()} and len(rows) == len(want)
    assert fence.fence(df.limit(0), "doc", "seq", "kind", "attempt").collect() == []
