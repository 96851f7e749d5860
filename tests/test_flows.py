"""Ingestion attempts, chat turns and the store's publish, end to end on small tables."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from pagewright import constants as K
from pagewright.functions import providers
from pagewright.operators import pages
from pagewright.plans import flows
from pagewright.sources.tables import ocr_shards, write_payload
from pagewright.storage.snapshots import Table
from pagewright.streaming import answers

NOW = datetime.datetime(2024, 5, 1, 12, 0)


@pytest.fixture
def shards(spark):
    schema = f"document_id string, shard_index int, {pages.SHARD_SCHEMA}"
    return lambda text: (spark.createDataFrame([("d", 0, text, [])], schema), spark.createDataFrame([("d", 2)], "document_id string, page_count int"))


def test_ingestion_attempts(spark, shards, tmp_path):
    documents = spark.createDataFrame([("d", "uploaded", 0), ("r", "ready", 1)], "id string, status string, attempt int")
    run = lambda doc, n, read, facts=None: flows.ingestion_attempt(documents, doc, n, read, str(tmp_path), F.lit(NOW), facts, width=16)

    def fails():
        raise OSError("connection reset by peer")

    first = run("d", 1, fails)
    assert (first["status"], first["next_at"]) == ("processing", NOW + datetime.timedelta(seconds=15)) and "reset" in first["error"]
    assert run("d", 3, fails)["status"] == "failed"
    assert run("d", 1, lambda: 1 / 0)["status"] == "failed"
    assert run("d", 1, lambda: 1 / 0, lambda e: {"http": 503})["status"] == "processing"
    for text, n in (("Grain rose. Then fell.", 1), ("Other words.", 1)):
        out = run("d", 1, lambda text=text: shards(text))
        assert (out["status"], out["pages"], out["chunks"]) == ("ready", 2, n)
    assert [r.text for r in Table(spark, str(tmp_path / "chunks")).read().collect()] == ["Other words."]
    assert run("r", 2, fails) == {"status": "skipped", "attempt": 2} == run("none", 2, fails)


def test_providers_are_asked_once(spark, shards, tmp_path):
    """Over a failed attempt, a repeated one and all outputs: summaries in batches of ten, vectors of 64."""
    calls, down = tmp_path / "calls", tmp_path / "down"
    calls.mkdir()
    down.touch()
    folder, flag = str(calls), str(down)

    def note(kind, texts, most):
        import os
        import uuid

        assert 0 < len(texts) <= most and all(t.strip() for t in texts)
        if kind == "vector" and os.path.exists(flag):
            raise OSError("connection reset by peer")
        for t in texts:
            open(f"{folder}/{uuid.uuid4().hex}", "w").write(f"{kind} {t}")

    def summarise(texts):
        note("summary", texts, 10)
        return [f" on  {t[:9]} " for t in texts]

    def embed(texts):
        note("vector", texts, 64)
        return [[float(len(t)), 1.0] for t in texts]

    words = "|".join(f"page {n} has words" if n % 5 else " " for n in range(1, 31))
    ends = [0]
    for t in words.split("|"):
        ends.append(ends[-1] + len(t) + 1)
    payload = [{"pageNumber": i + 1, "layout": {"textAnchor": {"textSegments": [{"startIndex": str(ends[i]), "endIndex": str(ends[i + 1] - 1)}]}}} for i in range(30)]
    schema = f"document_id string, shard_index int, {pages.SHARD_SCHEMA}"
    read = lambda: (spark.createDataFrame([("d", 0, words, payload)], schema), spark.createDataFrame([("d", 31)], "document_id string, page_count int"))
    documents = spark.createDataFrame([("d", "uploaded", 0)], "id string, status string, attempt int")
    models = flows.Models("s", summarise, "v", embed)
    run = lambda n: flows.ingestion_attempt(documents, "d", n, read, str(tmp_path / "store"), F.lit(NOW), models=models)
    first = run(1)
    assert first["status"] == "processing" and "connection reset" in first["error"]
    down.unlink()
    for n in (2, 3):
        out = run(n)
        assert (out["status"], out["pages"], out["chunks"]) == ("ready", 31, 1) and out["summary"].startswith("on page 1 ha on page 2 ha on")
    said = [p.read_text() for p in calls.iterdir()]
    assert len(said) == len(set(said)) and sum(t.startswith("summary") for t in said) == 24 and sum(t.startswith("vector") for t in said) == 1
    rows = Table(spark, str(tmp_path / "store" / "pages")).read().orderBy("page_number").collect()
    assert [r.summary for r in rows[3:6]] == ["on page 4 ha", K.EMPTY_PAGE_SUMMARY, "on page 6 ha"]


def test_chat_turns(spark):
    documents = spark.createDataFrame([("d", "o", "T", "ready", "all"), ("e", "o", "E", "failed", "x")], "id string, owner string, title string, status string, summary string")
    p = spark.createDataFrame([("d", 1, "alpha beta gamma"), ("d", 2, "delta epsilon")], "document_id string, page_number int, extracted_text string")
    chunks = providers.embedded(flows.page_chunks(p), width=16).withColumn("id", F.lit("d:0"))
    tables = {
        "documents": documents,
        "pages": p.withColumn("summary", F.concat(F.lit("on "), F.col("extracted_text"))),
        "chunks": chunks,
        "conversations": spark.createDataFrame([("c", "o", "d")], "id string, owner string, document_id string"),
        "messages": spark.createDataFrame([("c", "user", "before", NOW)], "conversation_id string, role string, content string, created_at timestamp"),
    }
    seen = []

    def turn(document, owner, question, reply, route=lambda h, q: "{}"):
        def answer(prompt):
            seen.append(prompt)
            return reply

        embed = lambda q: providers.hashed_embeddings([q], 16)[0].tolist()
        return flows.chat_turn(tables, document, "c", owner, question, embed, route, answer, F.lit(NOW))

    assert turn("d", "other", "q", "")[0] == {"status": 404, "reason": "not_found"}
    assert turn("d", "o", " ", "")[0]["reason"] == "missing_fields" and turn("e", "o", "q", "")[0]["reason"] == "not_ready"
    reply = json.dumps({"answer": "yes", "citations": [{"sourceId": "S1", "quote": "gamma  delta"}, {"sourceId": "S1", "quote": "nope"}]})
    out, messages = turn("d", "o", "what is delta", reply)
    assert (out["mode"], out["answer"], [(c["quote"], c["page_number"]) for c in out["citations"]]) == ("chunks", "yes", [("gamma delta", 1)])
    assert [(r.role, r.content) for r in messages.orderBy("created_at").collect()] == [("user", "what is delta"), ("assistant", "yes")]
    assert "[S1] pages 1-2\nalpha beta gamma delta epsilon" in seen[-1]
    reply = json.dumps({"answer": "both", "citations": [{"sourceId": "P2"}, {"sourceId": "P2"}, {"sourceId": "P9"}]})
    out, _ = turn("d", "o", "go on", reply, lambda h, q: json.dumps({"standaloneQuery": "overview", "retrievalMode": "summaries"}) if h == [("user", "before")] else "")
    assert (out["mode"], [c["page_number"] for c in out["citations"]]) == ("summaries", [2]) and "[P2] page 2\non delta epsilon" in seen[-1]
    assert turn("d", "o", "q", "not json")[0]["reason"] == "no_answer"


def test_many_turns_are_each_like_one(spark, tmp_path):
    """Requests that fail each check, both modes, history for the routing, and answers that can't be read."""
    import collections

    documents = spark.createDataFrame([("d", "o", "T", "ready", "all"), ("e", "o", "E", "failed", "x"), ("f", "o", "F", "ready", " "), ("g", "o", "G", "ready", "s"), ("h", "o", "H", "ready", "s")], "id string, owner string, title string, status string, summary string")
    p = spark.createDataFrame([("d", 1, "alpha beta gamma"), ("d", 2, "delta epsilon"), ("h", 1, "other words here")], "document_id string, page_number int, extracted_text string")
    chunks = providers.embedded(flows.page_chunks(p), width=16).withColumn("id", F.concat(F.col("document_id"), F.lit(":0")))
    tables = {
        "documents": documents,
        "pages": p.withColumn("summary", F.concat(F.lit("on "), F.col("extracted_text"))),
        "chunks": chunks,
        "conversations": spark.createDataFrame([("c", "o", "d"), ("ch", "o", "h"), ("cg", "o", "g"), ("ce", "o", "e"), ("cf", "o", "f")], "id string, owner string, document_id string"),
        "messages": spark.createDataFrame([("c", "user", "before", NOW)], "conversation_id string, role string, content string, created_at timestamp"),
    }
    replies = {
        "what is delta": {"answer": " yes ", "citations": [{"sourceId": "S1", "quote": "gamma  delta"}, {"sourceId": "S1", "quote": "nope"}]},
        "go on": {"answer": "both", "citations": [{"sourceId": "P2"}, {"sourceId": "P2"}, {"sourceId": "P9"}]},
        "say other": {"answer": "it does", "citations": []},
        "unread": None,
    }
    rows = [(i, *r) for i, r in enumerate([("d", "c", "o", "what is delta"), ("d", "c", "o", "go on"), ("d", "c", "x", "q"), ("d", "c", None, "q"), ("d", "c", "o", "  "), ("e", "ce", "o", "q"), ("f", "cf", "o", "q"), ("d", "ch", "o", "q"), ("g", "cg", "o", "q"), ("h", "ch", "o", "say other"), ("h", "ch", "o", "unread"), ("z", "c", "o", "q")])]
    asked = spark.createDataFrame(rows, "turn_id long, document_id string, conversation_id string, owner string, question string")

    def answer(prompts):
        out = []
        for t in prompts:
            said = replies[t.rsplit("Question: ", 1)[1]]
            out.append("not json" if said is None else json.dumps(said))
        return out

    def route(texts):
        asked = [json.loads(t) for t in texts]
        return [json.dumps({"standaloneQuery": "overview", "retrievalMode": "summaries"}) if t["question"] == "go on" and t["history"] == [{"role": "user", "content": "before"}] else "{}" for t in asked]

    assistant = flows.Assistant("h", lambda texts: providers.hashed_embeddings(texts, 16).tolist(), "m", answer, "r", route)
    out = flows.chat_turns(tables, asked, str(tmp_path), assistant, F.lit(NOW))
    got = {r.turn_id: r for r in out["outcomes"].collect()}
    cited, written = collections.defaultdict(list), collections.defaultdict(list)
    for r in out["citations"].orderBy("citation").collect():
        cited[r.turn_id].append((r.source_id, r.quote, r.start_offset, r.page_number))
    for r in out["messages"].collect():
        written[r.conversation_id].append((r.created_at, r.role, r.content))
    assert [(got[i].status, got[i].reason) for i in range(12)] == [(200, "ok"), (200, "ok"), (404, "not_found"), (401, "unauthorized"), (400, "missing_fields"), (400, "not_ready"), (400, "no_summary"), (404, "no_conversation"), (500, "no_chunks"), (200, "ok"), (502, "no_answer"), (404, "not_found")]
    assert [(got[i].mode, got[i].answer) for i in (0, 1, 9)] == [("chunks", "yes"), ("summaries", "both"), ("chunks", "it does")]
    assert cited == {0: [("S1", "gamma delta", 11, 1)], 1: [("P2", None, None, 2)]}
    assert len(written["c"]) == 4 and [r[1:] for r in sorted(written["ch"])] == [("user", "say other"), ("assistant", "it does")]

    for turn, (document, conversation, owner, question) in enumerate(r[1:] for r in rows):
        one, _ = flows.chat_turn(tables, document, conversation, owner, question, lambda q: providers.hashed_embeddings([q], 16)[0].tolist(), lambda h, q: route([json.dumps({"history": [{"role": a, "content": b} for a, b in h], "question": q})])[0], lambda t: answer([t])[0], F.lit(NOW))
        assert (one["status"], one["reason"], one.get("mode"), one.get("answer")) == (got[turn].status, got[turn].reason, got[turn].mode, got[turn].answer)
        assert [(c["source_id"], c["page_number"]) for c in one.get("citations", [])] == [(c[0], c[3]) for c in cited[turn]]


def test_payloads_are_read_back_in_order(spark, tmp_path):
    for name, text in (("b.json", "two"), ("a.json", "one"), ("c.txt", "no")):
        (tmp_path / name).write_text(json.dumps({"text": text, "pages": []}, indent=2))
    got = ocr_shards(spark, str(tmp_path), "d").orderBy("shard_index").collect()
    assert [(r.shard_index, r.text) for r in got] == [(0, "one"), (1, "two")]
    uri = write_payload(spark.range(2), str(tmp_path / "out"))
    assert '"id" : 0' in spark.read.text(uri, wholetext=True).first().value or '"id" : 1' in spark.read.text(uri, wholetext=True).first().value


def test_live(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",), ("a",)], "status string").write.parquet(str(tmp_path / "in"))
    rows, shown = spark.readStream.schema("status string").parquet(str(tmp_path / "in")), []
    q = answers.live(rows, lambda df: df.groupBy("status").count(), lambda df, n: shown.append(sorted(map(tuple, df.collect()))), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert shown[-1] == [("a", 2), ("b", 1)]


def test_extractor_keeps_little():
    x = answers.AnswerExtractor()
    assert x.feed("y" * 10_000 + ' "ans') == "" and x.buffer == '"ans'
    assert x.feed('wer" :  "hi\\') == "hi" and x.feed('n"') == "\n" and x.closed and x.buffer == ""


def test_ingestion_deals_no_texts_to_leave_out_other_documents(spark, tmp_path):
    """pages and chunks were dealt as a whole to meet the ids of their documents, and were written by a weaker codec."""
    place = "struct<textAnchor:struct<textSegments:array<struct<startIndex:string,endIndex:string>>>>"
    shards = spark.createDataFrame([(i, 0, f"text of {i}. More", None) for i in range(4)], f"document_id long, shard_index int, text string, pages array<struct<pageNumber:int,layout:{place}>>")
    expected = spark.createDataFrame([(i, 2) for i in range(4)], "document_id long, page_count int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = flows.ingested(shards, expected, str(tmp_path), flows.stand_ins(16), expected.select("document_id"))
        for name, n in (("pages", 8), ("chunks", 4)):
            plan = out[name]._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and out[name].count() == n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(".zstd." in p.name for p in (tmp_path / "chunks" / "data").rglob("*.parquet"))
