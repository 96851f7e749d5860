"""Registered queries of stored tables, indexes and state, each with equivalent DuckDB SQL. Stores are made in the shared folder from
the given tables; those that only serve to answer are deleted again."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K
from .functions import providers
from .functions import text as T
from .operators import chunking, records, retrieval, store
from .plans import flows
from .queries import _CHUNKS, _WANTED, LINES, QUERY, SQL, STATUS, WS, _vector, _vectors, docs, lines, running, texts, wordy
from .registry import query
from .sources.tables import parquet, spread
from .storage.feed import Feed
from .storage.log import Files, shared_dir
from .storage.postings import Index
from .storage.snapshots import Table
from .storage.vectors import VectorIndex
from .streaming.cache import read_through
from .streaming.lists import live_lists, replayed
from .streaming.wire import answer_events


def place(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(s: SparkSession, name: str) -> Iterator[str]:
    at = place(s, name)
    try:
        yield at
    finally:
        Files(s, at).delete("")


def answer(found: DataFrame) -> DataFrame:
    """A handful of rows that are asked for before their index goes."""
    return found.sparkSession.createDataFrame(found.collect(), found.schema)


# indexes


def _text_index(s, d, at: str) -> Index:
    """All documents, on a way: some first with other words, some twice, and some that go again."""
    index, t = Index(s, at), texts(s, d)
    stale = t.where("id % 3 <> 0").withColumn("text", F.when(F.col("id") % 5 == 1, F.reverse("text")).otherwise(F.col("text")))
    index.add(stale.union(t.where("id % 3 = 0").select((-1 - F.col("id")).alias("id"), "text")))
    index.add(t.where("id % 3 = 0 or id % 5 = 1"))
    index.delete(t.where("id % 3 = 0").select((-1 - F.col("id")).alias("id")))
    return index


def _vector_index(s, d, at: str, key: str | None = None) -> VectorIndex:
    v = _vectors(s, d)
    index = VectorIndex(s, at, 64, key)
    index.add(v.withColumn("embedding", F.when(F.col("id") % 4 == 2, F.reverse("embedding")).otherwise(F.col("embedding"))))
    index.add(v.where("id % 4 = 2"))
    return index


@query(SQL["lexical_topk"])
def lexical_topk_indexed(s, d):
    with scratch(s, "postings") as at:
        return answer(_text_index(s, d, at).top_k(" ".join(_WANTED)))


@query(SQL["lexical_topk"])
def lexical_topk_compacted(s, d):
    with scratch(s, "postings") as at:
        index = _text_index(s, d, at)
        index.compact()
        return answer(index.top_k(" ".join(_WANTED)))


@query(SQL["vector_topk"])
def vector_topk_indexed(s, d):
    with scratch(s, "vectors") as at:
        return answer(_vector_index(s, d, at).search(_vector(s, d), exact=True))


@query(SQL["vector_topk_filtered"])
def vector_topk_indexed_filtered(s, d):
    with scratch(s, "vectors") as at:
        return answer(_vector_index(s, d, at, "label").search(_vector(s, d), key=3, exact=True))


@query(SQL["hybrid_retrieve"])
def hybrid_retrieve_indexed(s, d):
    with scratch(s, "hybrid") as at:
        out = flows.retrieve_indexed(texts(s, d), _text_index(s, d, f"{at}/t"), _vector_index(s, d, f"{at}/v"), QUERY, _vector(s, d), exact=True)
        return answer(out.select("id", F.round("hybrid_score", 12).alias("hybrid_score"), "final_rank", "source_id"))


# snapshot tables


@query(f"SELECT document_id, CAST(page_number AS INTEGER) AS page_number, CASE WHEN document_id % 3 = 0 THEN 'again: ' || extracted_text ELSE extracted_text END AS extracted_text FROM ({LINES}) WHERE document_id % 5 <> 4")
def snapshot_publish(s, d):
    """Pages of all documents in three commits: all, a third of them again, and a fifth without any page."""
    t = Table(s, place(s, "pages"), bucket_rows=1 << 16)
    p = lines(s, d).withColumn("page_number", F.col("page_number").cast("int"))
    t.publish(p)
    t.publish(p.where("document_id % 3 = 0").withColumn("extracted_text", F.concat(F.lit("again: "), F.col("extracted_text"))))
    t.publish(p.limit(0), documents=p.where("document_id % 5 = 4").select("document_id"))
    return t.read()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' WHEN o_orderkey % 7 = 1 THEN 'R' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 1 THEN 0.0 ELSE CAST(o_totalprice AS DOUBLE) END AS o_totalprice FROM orders WHERE NOT (o_orderkey % 7 = 2 AND o_orderstatus = 'F')")
def snapshot_changes(s, d):
    """Orders patched, replaced and deleted by commits of a table of small buckets."""
    o = parquet(s, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    t = Table(s, place(s, "orders"), key="o_orderkey", bucket_rows=1 << 14)
    t.publish(o)
    t.patch(o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus")))
    t.replace(o.where("o_orderkey % 7 = 1").select("o_orderkey", F.lit("R").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice")))
    t.delete(o.where("o_orderkey % 7 = 2").select("o_orderkey"), guard=F.col("o_orderstatus") == "F")
    return t.read()


@query("SELECT 'data: {\"turn\":' || turn || ',\"role\":\"' || role || '\"}' AS value, turn AS version FROM conversations WHERE turn < 3")
def event_feed(s, d):
    """Turns as batches of events; each is appended once, though all come twice."""
    feed = Feed(s, place(s, "feed"), between="\n\n")
    for _ in range(2):
        for n in range(3):
            c = parquet(s, d, "conversations").where(F.col("turn") == n)
            feed.append(c.select(F.regexp_replace(store.sse(F.struct("turn", "role")), "\n+$", "").alias("value")), "turns", n)
    return feed.read().where("value <> ''")


# pages by several keys


@query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n > 50 AND n <= 75")
def record_composite_page(s, d):
    """The third page of 25, reached by cursors."""
    order, cursor = [("o_orderpriority", "desc"), ("o_totalprice", "desc"), ("o_orderkey", "asc")], None
    for _ in range(2):
        cursor = records.sorted_page(parquet(s, d, "orders"), [], order, 25, cursor).first().continue_cursor
    return records.sorted_page(parquet(s, d, "orders"), [], order, 25, cursor).select("o_orderkey", "o_totalprice")


# state


@query(SQL["ttl_cache"])
def cache_state(s, d):
    return read_through(parquet(s, d, "events"), "user_id", "ts", lambda key: f"signed/{key}", 86400).select("user_id", "ts", "hit")


@query("SELECT source AS owner, doc_id AS id, CAST(n_chars AS BIGINT) AS at FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents WHERE doc_id % 6 <> 5) WHERE n <= 50")
def live_list_replay(s, d):
    """Documents come, and a sixth of them goes; the changes told of each source's list come to its fifty longest."""
    t = docs(s, d).select(F.col("source").alias("owner"), F.col("doc_id").alias("id"), F.col("n_chars").cast("long").alias("at"), F.lit("").alias("payload"))
    came, went = t.withColumn("seq", F.lit(0)).withColumn("deleted", F.lit(False)), t.where("id % 6 = 5").withColumn("seq", F.lit(1)).withColumn("deleted", F.lit(True))
    return replayed(live_lists(came.unionByName(went))).select("owner", "id", "at")


_TRIM = f"regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g')"


@query(f"""SELECT conv_id, turn, 'meta' AS type, '{{"conversationId": "' || conv_id * 1000 + turn || '"}}' AS payload FROM conversations
UNION ALL SELECT conv_id, turn, 'token', text FROM conversations WHERE text <> ''
UNION ALL SELECT conv_id, turn, 'done', coalesce(nullif({_TRIM}, ''), '{K.NO_ANSWER}') FROM conversations""")
def wire_events(s, d):
    """Each turn as a structured answer that comes as bytes, in lines of nine characters, cut into pieces of thirteen bytes that
    arrive in the opposite order. Its tokens are put together again."""
    c = spread(parquet(s, d, "conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("conv_id"), F.to_json(F.struct(F.col("text").alias("answer"), F.array().cast("array<string>").alias("citations"))).alias("j"))
    parts = F.regexp_extract_all("j", F.lit("(?s).{1,9}"), F.lit(0))
    said = F.transform(parts, lambda p: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(p.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n")))
    whole = F.encode(F.concat(F.array_join(said, ""), F.lit("data: [DONE]\n\n")), "UTF-8")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length("b") / 13) - 1), lambda i: F.substring(F.col("b"), (i * 13 + 1).cast("int"), F.lit(13)))
    counted = c.select("conv_id", whole.alias("b")).select("conv_id", "b", F.ceil(F.octet_length("b") / 13).alias("all"))  # before, so that no piece carries them all
    pieces = counted.select("conv_id", "all", F.posexplode(F.reverse(cut)).alias("n", "piece"))
    told = answer_events(pieces.select("conv_id", (F.col("all") - 1 - F.col("n")).alias("seq"), "piece", F.lit(None).cast("string").alias("error"), F.lit(False).alias("last")))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda x: x["payload"]), "")
    out = told.groupBy("conv_id", "type").agg(line.alias("payload"))
    return out.select(F.floor(F.col("conv_id") / 1000).cast("long").alias("conv_id"), (F.col("conv_id") % 1000).alias("turn"), "type", "payload")


# ingestion

_LINE = f"regexp_replace(regexp_replace(replace(extracted_text, chr(0), ''), '[{WS}]+', ' ', 'g'), '^ | $', '', 'g')"
_FIRST = "coalesce(nullif(regexp_extract(l, '^(.{1,200}?)(?:[.!?](?: |$)|$)', 1), ''), substr(l, 1, 200))"


@query(f"""WITH p AS (SELECT document_id, page_number, {_LINE} AS l FROM ({LINES})),
s AS (SELECT document_id, page_number, l = '' AS blank, CASE WHEN l = '' THEN '{K.EMPTY_PAGE_SUMMARY}' ELSE rtrim({_FIRST}, ' ') END AS s FROM p),
c AS (SELECT doc_id, count(*) AS n FROM ({_CHUNKS}) GROUP BY 1)
SELECT document_id, count(*) AS n_pages, coalesce(any_value(c.n), 1) AS n_chunks, CASE WHEN bool_and(blank) THEN '{K.EMPTY_DOCUMENT_SUMMARY}' ELSE string_agg(s, ' ' ORDER BY page_number) FILTER (NOT blank) END AS summary
FROM s LEFT JOIN c ON c.doc_id = document_id GROUP BY document_id""")
def ingested_documents(s, d):
    """All documents through a whole ingestion: as OCR payloads to pages, summaries, chunks and vectors in committed tables."""
    at = place(s, "ingested")
    t = docs(s, d).select(F.col("doc_id").alias("document_id"), F.split("text", "\n").alias("w"))
    each = t.select("document_id", F.lit(0).alias("shard_index"), F.array_join("w", "").alias("text"), F.col("w"))
    ends = running(F.transform("w", F.length))
    segment = lambda i: F.struct(F.when(i > 0, F.get("ends", i - 1)).cast("string").alias("startIndex"), F.get("ends", i).cast("string").alias("endIndex"))
    page = lambda x, i: F.struct((i + 1).cast("int").alias("pageNumber"), F.struct(F.struct(F.array(segment(i)).alias("textSegments")).alias("textAnchor")).alias("layout"))
    shards = each.withColumn("ends", ends).select("document_id", "shard_index", "text", F.transform("w", page).alias("pages"))
    expected = t.select("document_id", F.size("w").alias("page_count"))
    out = flows.ingested(shards, expected, at, flows.stand_ins(16), expected.select("document_id"))
    n = out["pages"].groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pages"))
    c = out["chunks"].where(F.size("embedding") == 16).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return n.join(c, "document_id").join(out["documents"], "document_id")


# many questions at once

_STOP = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
_MANY = f"""WITH c AS (SELECT doc_id, doc_id * 100000 + i AS id, i, w, array_to_string(w, ' ') AS text FROM ({_CHUNKS})),
q AS (SELECT doc_id, array_to_string(w[1:6], ' ') AS q, lower(array_to_string(w[1:6], ' ')) AS lq FROM c WHERE i = 0),
k AS (SELECT doc_id, q, list_filter(l, lambda x, i: list_position(l, x) = i)[1:12] AS terms FROM (SELECT doc_id, q, list_filter(regexp_extract_all(lq, '[a-z0-9][a-z0-9._/-]*'), lambda t: (length(t) >= 3 OR regexp_matches(t, '[0-9]')) AND t NOT IN ({_STOP})) AS l FROM q)),
a AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(CASE WHEN len(terms) > 0 THEN array_to_string(terms, ' ') ELSE q END), '[a-z0-9]+')) AS term FROM k),
b AS (SELECT doc_id, id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM c),
s AS (SELECT doc_id, count(*) AS n, avg(len(w)) AS avgdl FROM b GROUP BY 1),
tf AS (SELECT doc_id, id, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT doc_id, id, len(w) AS dl, unnest(w) AS term FROM b) JOIN a USING (doc_id, term) GROUP BY doc_id, id, term),
df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
lx AS (SELECT doc_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (doc_id, term) JOIN s USING (doc_id) GROUP BY 1, 2),
lex AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, id) AS rank FROM lx QUALIFY rank <= 12),
h AS (SELECT doc_id, id, h % 64 AS place, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM (
  SELECT doc_id, id, CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) AS h FROM (SELECT doc_id, id, unnest(list_transform(w, lambda t: lower(t))) AS x FROM c)) GROUP BY 1, 2, 3),
g AS (SELECT doc_id, h % 64 AS place, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM (
  SELECT doc_id, CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) AS h FROM (SELECT doc_id, unnest(list_transform(w[1:6], lambda t: lower(t))) AS x FROM c WHERE i = 0)) GROUP BY 1, 2),
hn AS (SELECT doc_id, id, sqrt(sum(v * v)) AS norm FROM h GROUP BY 1, 2), gn AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM g GROUP BY 1),
d AS (SELECT h.doc_id, id, sum(h.v * g.v) AS dot FROM h JOIN g USING (doc_id, place) GROUP BY 1, 2),
vx AS (SELECT doc_id, id, round(CASE WHEN hn.norm * gn.norm > 0 THEN coalesce(dot, 0) / (hn.norm * gn.norm) ELSE 0 END, 9) AS score FROM hn JOIN gn USING (doc_id) LEFT JOIN d USING (doc_id, id)),
vec AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, id) AS rank FROM vx QUALIFY rank <= 12),
f AS (SELECT doc_id, id, coalesce(0.65::DOUBLE / (60 + vec.rank), 0) + coalesce(0.35::DOUBLE / (60 + lex.rank), 0) AS fused, row_number() OVER (PARTITION BY doc_id ORDER BY vec.rank NULLS LAST, lex.rank NULLS LAST) AS pos FROM vec FULL JOIN lex USING (doc_id, id)),
m AS (SELECT f.doc_id, f.id, c.text, pos, fused + CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(lower(c.text), t))) / CAST(len(terms) AS DOUBLE) ELSE 0 END * 0.1 AS score FROM f JOIN k USING (doc_id) JOIN c ON c.id = f.id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM m QUALIFY rank <= 6)"""


def _chunk_table(s, d) -> DataFrame:
    c = chunking.text_chunks(wordy(s, d), "doc_id")
    n = F.length("text")
    span = F.array(F.struct(F.lit(1).alias("page_number"), F.lit(0).alias("start_offset"), n.alias("end_offset")))
    c = c.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") * 100000 + F.col("chunk_index")).alias("id"), "chunk_index", "text", F.lit(1).alias("start_page_number"), F.lit(1).alias("end_page_number"), span.alias("page_spans"))
    return providers.embedded(c, width=64)


def _first_words(s, d) -> DataFrame:
    w = wordy(s, d).select(F.col("doc_id").alias("document_id"), T.tokens(F.coalesce(F.col("text"), F.lit(""))).alias("w")).where(F.size("w") > 0)
    return w.select("document_id", F.array_join(F.slice("w", 1, 6), " ").alias("query"))


@query(_MANY + " SELECT doc_id, 'S' || rank AS source_id, id, round(score, 12) AS hybrid_score FROM best")
def hybrid_retrieve_many(s, d):
    """Every document is asked for its first six words."""
    q = providers.embedded(_first_words(s, d).select("document_id", "query", F.col("query").alias("text"), F.lit(0).alias("chunk_index")), width=64)
    q = q.select(F.col("document_id").alias("question_id"), "document_id", "query", F.col("embedding").alias("vector"))
    out = retrieval.retrieve_many(q, _chunk_table(s, d))
    return out.select(F.col("question_id").alias("doc_id"), "source_id", "id", F.round("hybrid_score", 12).alias("hybrid_score"))


def _model(prompts: list[str]) -> list[str]:
    """Cites the first word of its first source, an unknown source, and the last word of its last one."""
    import json

    out = []
    for p in prompts:
        blocks = p.split("Sources:\n", 1)[1].rsplit("\n\nQuestion: ", 1)[0].split("\n\n[")
        bodies = [b.split("\n", 1) for b in blocks]
        label = lambda b: b[0].lstrip("[").split("]")[0]
        quotes = [(label(bodies[0]), bodies[0][1].split(" ")[0]), ("S9", "x"), (label(bodies[-1]), bodies[-1][1].split(" ")[-1])]
        out.append(json.dumps({"answer": f" from {len(blocks)} sources ", "citations": [{"sourceId": a, "quote": b} for a, b in quotes]}))
    return out


@query(_MANY + f""", st AS (SELECT doc_id, {STATUS} AS status, source FROM documents),
o AS (SELECT st.doc_id, CASE WHEN doc_id % 7 = 6 THEN 'not_found' WHEN status <> 'ready' THEN 'not_ready' WHEN doc_id % 11 = 10 THEN 'no_conversation' WHEN doc_id NOT IN (SELECT doc_id FROM c) THEN 'no_chunks' ELSE 'ok' END AS reason FROM st),
n AS (SELECT doc_id, count(*) AS n, max(rank) AS last FROM best GROUP BY 1),
x AS (SELECT doc_id, id, rank, text, string_split(text, ' ') AS w FROM best),
u AS (SELECT x.doc_id, 0 AS pos, id, text, w[1] AS quote FROM x WHERE rank = 1 UNION ALL SELECT x.doc_id, 2, id, text, w[-1] FROM x JOIN n ON n.doc_id = x.doc_id AND rank = last),
v AS (SELECT doc_id, id, min(pos) AS pos, instr(text, quote) - 1 AS begins, any_value(quote) AS quote FROM u GROUP BY doc_id, id, instr(text, quote) - 1, length(quote)),
z AS (SELECT doc_id, string_agg(id || ':' || begins || ':' || quote, ' | ' ORDER BY pos) AS citations FROM v GROUP BY 1)
SELECT o.doc_id, o.reason, CASE WHEN o.reason = 'ok' THEN 'from ' || n || ' sources' END AS answer, CASE WHEN o.reason = 'ok' THEN citations END AS citations, CASE WHEN o.reason = 'ok' THEN 2 ELSE 0 END AS n_messages
FROM o LEFT JOIN n ON n.doc_id = o.doc_id LEFT JOIN z ON z.doc_id = o.doc_id""")
def chat_turns_in_bulk(s, d):
    """A whole turn about every document, most of which can't be asked: asked for its first six words, with a model that quotes
    from its sources."""
    owner = F.when(F.col("document_id") % 7 == 6, F.lit("someone else")).otherwise(F.lit("o"))
    t = docs(s, d).select(F.col("doc_id").alias("document_id"), F.expr(STATUS).alias("status"))
    documents = t.select(F.col("document_id").alias("id"), F.lit("o").alias("owner"), F.concat(F.lit("T"), F.col("document_id").cast("string")).alias("title"), "status", F.lit("all of it").alias("summary"))
    talks = t.where("document_id % 11 <> 10").select(F.col("document_id").alias("id"), F.lit("o").alias("owner"), "document_id")
    pages_ = s.createDataFrame([], "document_id long, page_number int, summary string")
    said = s.createDataFrame([], "conversation_id long, role string, content string, created_at timestamp")
    asked = t.join(_first_words(s, d), "document_id", "left").select(F.col("document_id").alias("turn_id"), "document_id", F.col("document_id").alias("conversation_id"), owner.alias("owner"), F.coalesce("query", F.lit("nothing")).alias("question"))
    at = place(s, "turns")
    _chunk_table(s, d).write.parquet(f"{at}/chunks")
    tables = {"documents": documents, "pages": pages_, "chunks": s.read.parquet(f"{at}/chunks"), "conversations": talks, "messages": said}
    assistant = flows.Assistant("hashed-64", lambda texts: providers.hashed_embeddings(texts, 64).tolist(), "quoting", _model)
    out = flows.chat_turns(tables, asked, at, assistant, F.lit("2024-05-01 12:00:00").cast("timestamp"))
    line = F.concat_ws(":", F.col("chunk_id").cast("string"), F.col("start_offset").cast("string"), "quote")
    cited = out["citations"].groupBy("turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation", line.alias("t")))), lambda x: x["t"]), " | ").alias("citations"))
    n = out["messages"].groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_messages"))
    whole = out["outcomes"].join(cited, "turn_id", "left").join(n.withColumnRenamed("conversation_id", "turn_id"), "turn_id", "left")
    return whole.select(F.col("turn_id").alias("doc_id"), "reason", "answer", "citations", F.coalesce("n_messages", F.lit(0)).alias("n_messages"))
