"""Streams give what the batch forms give, whatever comes between; timers fire."""

import json
import random
import re
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pagewright.operators import lifecycle, store
from pagewright.queries import QUERIES
from pagewright.streaming import wire
from pagewright.streaming.answers import folded_answers, sse_deltas, streamed_answers
from pagewright.streaming.cache import read_through
from pagewright.streaming.lists import live_lists, replayed
from pagewright.streaming.timers import supervised

SMALL = "/root/testdata/sf0.001"


class Source:
    """A folder that a stream reads, one batch after another, and a query over it that can be stopped and begun again."""

    def __init__(self, spark, base, schema, build):
        self.spark, self.base, self.schema, self.build, self.n = spark, base, schema, build, 0
        (base / "in").mkdir(parents=True)

    def put(self, *rows):
        self.n += 1
        made = self.base / f"made{self.n}"
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.parquet(str(made))
        (part,) = made.glob("*.parquet")
        part.rename(self.base / "in" / f"{self.n:04d}.parquet")

    def start(self, **trigger):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.base / "in"))
        out = self.build(stream).writeStream.format("parquet").option("path", str(self.base / "out")).option("checkpointLocation", str(self.base / "ck"))
        return out.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()

    def run(self):
        q = self.start()
        assert q.awaitTermination(90)
        return self.out()

    def out(self):
        """What the sink has committed so far."""
        try:
            return self.spark.read.parquet(str(self.base / "out")).collect()
        except AnalysisException:  # nothing yet
            return []


def until(check, seconds=40):
    end = time.time() + seconds
    while time.time() < end:
        if check():
            return True
        time.sleep(0.3)
    return False


def test_answers(spark, tmp_path):
    text = '{"answer":"one \\"two\\" three","citations":[]}'
    rows = [(c, i, text[i * 5 : i * 5 + 5]) for c in (1, 2) for i in range(len(text) // 5 + 1)]
    schema = "conv_id long, seq long, delta string"
    s = Source(spark, tmp_path, schema, streamed_answers)
    s.put(*(r for r in rows if r[1] < 4))
    s.put(*(r for r in rows if r[1] >= 4))
    q = s.start()
    q.awaitTermination(20)  # timers keep a query alive
    q.stop()
    got = {}
    for r in sorted(s.out(), key=lambda r: r.seq):
        got[r.conv_id] = got.get(r.conv_id, "") + r.token
    assert got == {r.conv_id: r.answer for r in folded_answers(spark.createDataFrame(rows, schema)).collect()} == {1: 'one "two" three', 2: 'one "two" three'}


def test_answers_of_a_long_conversation(spark, tmp_path):
    """More turns than 1,000, whose conv_id * 1000 + turn is also another conversation's: each is a row, as in the SQL."""
    import duckdb

    from pagewright.queries import QUERIES, SQL

    rows = [(1, t, f"one {t}") for t in (0, 999, 1000, 1001, 2500)] + [(2, t, f"two {t}") for t in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["answer_stream_fold"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(SQL["answer_stream_fold"]).fetchall()) and len(got) == len(rows)


# ---- timers

EVENT = "id long, seq long, kind string, attempt int, transient boolean"


def test_supervisor(spark):
    log = [(1, 0, "reserve", 0, False), (1, 1, "begin", 1, False), (1, 2, "failed", 1, False), (2, 0, "begin", 1, False), (2, 1, "ready", 2, False), (2, 2, "ready", 1, False), (2, 3, "begin", 5, False), (3, 0, "begin", 3, False), (3, 1, "failed", 3, True)]
    got = supervised(spark.createDataFrame(log, EVENT)).collect()
    assert sorted(map(tuple, got)) == [(1, "begin", 1), (1, "failed", 1), (2, "begin", 1), (2, "ready", 1), (3, "begin", 3), (3, "failed", 3)]


def test_timers_fire_with_stray_events_and_a_restart_between(spark, tmp_path):
    """A retry and a reservation's end come, though events of other attempts, and a stop of the query, come before them."""
    s = Source(spark, tmp_path, EVENT, lambda e: supervised(e, reservation=16, retries=(14, 4), settled=60))
    s.put((1, 0, "begin", 1, False), (1, 1, "failed", 1, True), (2, 0, "reserve", 0, False), (3, 0, "reserve", 0, False))
    q = s.start(processingTime="300 milliseconds")
    has = lambda *rows: lambda: set(rows) <= {tuple(r) for r in s.out()}
    try:
        assert until(has((1, "begin", 1), (1, "retry", 1)))
        s.put((1, 2, "ready", 7, False), (2, 1, "ready", 3, False), (3, 1, "begin", 1, False), (3, 2, "ready", 1, False))  # strays; 3 is completed
        assert until(has((3, "ready", 1)))
        assert (1, "begin", 2) not in {tuple(r) for r in s.out()}
    finally:
        q.stop()
    q = s.start(processingTime="300 milliseconds")
    try:
        s.put((1, 3, "failed", 9, True), (2, 2, "failed", 1, False))
        assert until(has((1, "begin", 2), (2, "expired", 0)))
        s.put((1, 4, "failed", 2, True), (2, 3, "begin", 1, False))
        assert until(has((1, "retry", 2), (1, "begin", 3)))
        s.put((1, 5, "failed", 3, True))
        assert until(has((1, "failed", 3)))
    finally:
        q.stop()
    got = sorted(tuple(r) for r in s.out())
    assert got == [(1, "begin", 1), (1, "begin", 2), (1, "begin", 3), (1, "failed", 3), (1, "retry", 1), (1, "retry", 2), (2, "expired", 0), (3, "begin", 1), (3, "ready", 1)]


# ---- the cache


def test_cache(spark, tmp_path):
    """A replayed stream gives what the batch fold gives, and an entry's state goes when its time is over."""
    r = random.Random(5)
    reads = sorted((f"2024-05-01 {10 + k % 5}:{r.randrange(60):02d}:{r.randrange(60):02d}", f"k{r.randrange(6)}") for k in range(150))
    df = spark.createDataFrame(reads, "ts string, key string").select("key", F.col("ts").cast("timestamp").alias("ts"))
    want = sorted((x.key, x.ts, x.hit) for x in lifecycle.cached_reads(df, "key", "ts").collect())
    url = lambda key: f"signed/{key}"
    assert sorted((x.key, x.ts, x.hit) for x in read_through(df, "key", "ts", url).collect()) == want
    s = Source(spark, tmp_path, "key string, ts timestamp", lambda e: read_through(e, "key", "ts", url, late="0 seconds"))
    rows = [tuple(x) for x in df.orderBy("ts").collect()]
    for i in range(0, 150, 50):
        s.put(*rows[i : i + 50])
    got = s.run()
    assert sorted((x.key, x.ts, x.hit) for x in got) == want and all(x.value == f"signed/{x.key}" for x in got)


def test_entries_vanish(spark, tmp_path):
    s = Source(spark, tmp_path, "key string, ts timestamp", lambda e: read_through(e, "key", "ts", str, late="0 seconds"))
    import datetime

    at = lambda sec: datetime.datetime(2024, 5, 1) + datetime.timedelta(seconds=sec)
    s.put(("a", at(0)))
    s.put(("b", at(839)))
    s.put(("a", at(840)), ("b", at(900)))
    s.put(("c", at(5000)))
    q = s.start()
    assert q.awaitTermination(90)
    assert sorted((r.key, r.hit) for r in s.out()) == [("a", False), ("a", False), ("b", False), ("b", True), ("c", False)]
    state = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "ck"))
    assert {r.key.key for r in state.collect()} <= {"c"}


# ---- live lists

CHANGE = "owner string, seq long, id long, at long, payload string, deleted boolean"


def test_live_lists(spark, tmp_path):
    """The changes told so far, replayed, give the newest rows of each owner after every batch."""
    r = random.Random(6)
    s = Source(spark, tmp_path, CHANGE, lambda c: live_lists(c, limit=5))
    docs, seq, last = {}, 0, 0
    for batch in range(6):
        rows = []
        for _ in range(40):
            seq += 1
            i = r.randrange(60)
            owner = f"o{i % 3}"
            if r.random() < 0.3:
                rows.append((owner, seq, i, None, None, True))
                docs.pop(i, None)
            else:
                at = r.randrange(50) if r.random() < 0.5 or i not in docs else docs[i][1]
                docs[i] = (owner, at, f"p{r.randrange(3)}")
                rows.append((owner, seq, i, at, docs[i][2], False))
        r.shuffle(rows)
        s.put(*rows)
        told = s.run()
        assert [x.n for x in sorted(told, key=lambda x: (x.owner, x.n))] == [n for o in ("o0", "o1", "o2") for n in range(sum(x.owner == o for x in told))]
        df = spark.createDataFrame([(i, *d) for i, d in docs.items()], "id long, owner string, at long, payload string")
        got = {o: [tuple(x) for x in store.newest(replayed(spark.createDataFrame(told)).where(F.col("owner") == o), 50, "at", "id").select("id", "at", "payload").collect()] for o in ("o0", "o1", "o2")}
        want = {o: [tuple(x) for x in store.newest(store.equal(df, owner=o), 5, "at", "id").select("id", "at", "payload").collect()] for o in ("o0", "o1", "o2")}
        assert got == want, batch
        assert len(told) > last
        last = len(told)
    assert {x.change for x in told} == {"added", "changed", "removed"}


# ---- bytes to events

PIECE = "conv_id long, seq long, piece binary, error string, last boolean"


def sse(answer, step=3, done=True):
    parts = [answer[i : i + step] for i in range(0, len(answer), step)]
    lines = ["event: ping", ": comment", "data: not json", 'data: {"choices":[]}'] + [f"data: {json.dumps({'choices': [{'delta': {'content': p}}]}, ensure_ascii=False)}" for p in parts]
    return ("\n\n".join(lines) + "\n\n" + ("data: [DONE]\n\ndata: {\"choices\":[{\"delta\":{\"content\":\"late\"}}]}\n" if done else "")).encode()


def cut(data, r, most):
    out, i = [], 0
    while i < len(data):
        n = r.randint(1, most)
        out.append(data[i : i + n])
        i += n
    return out


def events_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.seq):
        out.setdefault(r.conv_id, []).append((r.seq, r.type, r.payload))
    return out


def test_events_do_not_depend_on_the_cuts(spark, tmp_path):
    """Bytes are cut anywhere, also inside a character; pieces come out of order, twice, and in several batches."""
    answers = {
        1: json.dumps({"answer": "naïve 日本 \"q\" \\ end 😀", "citations": []}, ensure_ascii=False),
        2: json.dumps({"citations": [], "answer": "after"}),
        3: '{"answer":"cut off',
        4: "no answer at all",
        5: json.dumps({"citations": [{"sourceId": "S1", "quote": '"answer": "x"'}], "answer": " late "}),
    }
    r = random.Random(7)
    seen = []
    for most in (1, 4, 1000):
        rows = []
        for c, a in answers.items():
            pieces = cut(sse(a, done=c != 3), r, most)
            rows += [(c, i, bytearray(p), None, c == 3 and i == len(pieces) - 1) for i, p in enumerate(pieces)]
        rows += [(6, 0, bytearray(sse('{"answer":"part', done=False)), None, False), (6, 1, None, "the model is gone", False), (6, 2, bytearray(b"data: x\n"), None, False)]
        r.shuffle(rows)
        seen.append(events_of(wire.answer_events(spark.createDataFrame(rows + rows[:20], PIECE)).collect()))
    assert seen[0] == seen[1] == seen[2]
    got = seen[0]
    for c, a in answers.items():
        assert [n for n, _, _ in got[c]] == list(range(len(got[c]))) and got[c][0][1:] == ("meta", json.dumps({"conversationId": str(c)})) and got[c][-1][1] == "done"
    told = {c: "".join(p for _, t, p in e if t == "token") for c, e in got.items()}
    assert told[1] == json.loads(answers[1])["answer"] == got[1][-1][2] and told[2] == "after" == got[2][-1][2]
    assert got[3][-1][2] == "cut off" and got[4][-1][2] == wire.NO_ANSWER == told[4] and got[5][-1][2] == "late"
    assert got[6][-1][1:] == ("error", "the model is gone") and told[6] == "part"
    s = Source(spark, tmp_path, PIECE, wire.answer_events)
    for i in range(0, len(rows), 25):
        s.put(*rows[i : i + 25])
    q = s.start()
    assert until(lambda: {c: e[-1] for c, e in events_of(s.out()).items()} == {c: e[-1] for c, e in got.items()}, 60)
    q.stop()
    assert events_of(s.out()) == got


def test_wire_equals_the_batch_forms(spark):
    """Deltas and answers are those of the queries on whole lines."""
    texts = {i: json.dumps({"answer": f"answer {i} é\n\"x\"", "citations": []}) for i in range(8)}
    r = random.Random(8)
    rows = [(c, i, bytearray(p), None, False) for c, a in texts.items() for i, p in enumerate(cut(sse(a, 5), r, 9))]
    told = events_of(wire.answer_events(spark.createDataFrame(rows, PIECE)).collect())
    lines = [(c, n, line) for c, a in texts.items() for n, line in enumerate(sse(a, 5).decode().split("\n"))]
    deltas = sse_deltas(spark.createDataFrame(lines, "conv_id long, seq long, line string"), by=["conv_id"], order="seq").where("delta is not null")
    assert {r.conv_id: r.answer for r in folded_answers(deltas).collect()} == {c: "".join(p for _, t, p in e if t == "token") for c, e in told.items()}


def test_pieces_come_to_a_conversation_side_by_side(spark):
    """What is shuffled, and asked of the state, are rows of many pieces; pieces without bytes or place are read as before."""
    answer = json.dumps({"answer": "a line of words " * 40, "citations": []})
    rows = [(c, i, bytearray(p), None, False) for c in range(8) for i, p in enumerate(cut(sse(answer, 9), random.Random(c), 13))]
    rows += [(9, 1, None, None, False), (9, None, bytearray(b"x"), None, False), (9, 0, bytearray(sse(answer, 9, done=False)), None, False), (9, 2, None, None, True)]
    spark.sparkContext.setJobGroup("side by side", "")
    try:
        told = events_of(wire.answer_events(spark.createDataFrame(rows, PIECE).coalesce(1)).collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [{t: p for _, t, p in told[c] if t == "done"} for c in (*range(8), 9)] == [{"done": json.loads(answer)["answer"].strip()}] * 9
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {i for j in tracker.getJobIdsForGroup("side by side") for i in tracker.getJobInfo(j).stageIds}
    assert 0 < max(store.lastStageAttempt(i).shuffleWriteRecords() for i in stages) < 50 < len(rows) / 20


def test_no_piece_carries_its_whole_stream(spark):
    """In wire_events; what a row is made from would else be copied for each of its pieces."""
    plan = QUERIES["wire_events"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    (kept,) = re.findall(r"Generate posexplode\(reverse.*\), \[([^\]]*)\], false", plan)
    assert sorted(re.findall(r"[a-z_]+(?=#)", kept)) == ["all", "conv_id"]


@pytest.mark.parametrize("line, said", [("data: [DONE]", None), ("data:  [DONE] ", None), ("data: {}", ""), ("data: 7", ""), ("x", ""), ('data: {"choices":[{"delta":{"content":5}}]}', ""), ('data: {"choices":[{"delta":{"content":"a"}}]}\r', "a")])
def test_lines(line, said):
    assert wire.delta(line) == said
