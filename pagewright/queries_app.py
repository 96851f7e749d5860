"""Registered queries of the store, the lists, the streams and the flows, each with equivalent DuckDB SQL where SQL can express
it. Stand-ins are those of queries.py; conversations belong to the owner 'o' and the remainder of conv_id by 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import constants as K
from .functions import providers
from .functions import text as T
from .operators import browse, chunking, grounding, lifecycle, pages, records, store
from .plans import flows
from .queries import _CHUNKS
from .registry import query
from .sources.tables import list_items, parquet, payload_json, spread, without_internal
from .streaming import answers

NOW = "1998-08-02 12:00:00"
STATUS = "CASE doc_id % 5 WHEN 0 THEN 'uploading' WHEN 1 THEN 'uploaded' WHEN 2 THEN 'processing' WHEN 3 THEN 'ready' ELSE 'failed' END"
WS = T.WS_CHARS
LINES = "SELECT doc_id AS document_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_number, unnest(string_split(text, chr(10))) AS extracted_text FROM documents"


def _normal(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '[{WS}]+', ' ', 'g'), '^[{WS}]+|[{WS}]+$', '', 'g')"


def _blank(c: str) -> str:
    return f"NOT regexp_matches({c}, '[^{WS}]')"


def docs(s, d):
    return parquet(s, d, "documents")


def talk(s, d):
    return parquet(s, d, "conversations")


def wordy(s, d, *more):
    return spread(docs(s, d).select("doc_id", "text", *more))


def lines(s, d):
    cut = wordy(s, d).select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("i", "extracted_text"))
    return cut.select("document_id", (F.col("i") + 1).alias("page_number"), "extracted_text")


# reads


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 17")
def point_lookup(s, d):
    return store.point(docs(s, d), "doc_id", 17).select("doc_id", "lang", "source")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7 AND n_regionkey = 2")
def owned_document(s, d):
    return store.owned(parquet(s, d, "nation"), "n_nationkey", 7, "n_regionkey", 2).select("n_nationkey", "n_name")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id = 4 AND 'o' || conv_id % 3 = 'o1'")
def owned_conversation(s, d):
    c = talk(s, d).withColumn("owner", F.concat(F.lit("o"), (F.col("conv_id") % 3).cast("string")))
    return store.owned(c, "conv_id", 4, "owner", "o1").select("conv_id", "turn")


@query("SELECT request, position, doc_id, lang FROM (SELECT o_orderkey AS request, unnest([0, 1, 2]) AS position, (o_orderkey * 7 + unnest([0, 1, 2]) * 31) % 1500 AS doc_id FROM orders) JOIN documents USING (doc_id)")
def multi_get_bulk(s, d):
    asked = parquet(s, d, "orders").select(F.col("o_orderkey").alias("request"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("position")).withColumn("doc_id", (F.col("request") * 7 + F.col("position") * 31) % 1500)
    return store.multi_get_of(docs(s, d), asked, "doc_id").select("request", "position", "doc_id", "lang")


@query("SELECT conv_id, count(*) AS turns FROM conversations WHERE conv_id % 3 = 1 GROUP BY conv_id ORDER BY conv_id DESC LIMIT 50")
def list_newest_conversations(s, d):
    c = talk(s, d).where("conv_id % 3 = 1").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return store.newest(c, K.LIST_CONVERSATIONS, "conv_id")


@query("SELECT turn, role, row_number() OVER (ORDER BY turn) AS position FROM (SELECT * FROM conversations WHERE conv_id = 4 ORDER BY turn DESC LIMIT 20)")
def history_owned(s, d):
    c = talk(s, d)
    own = c.select(F.col("conv_id").alias("id"), F.concat(F.lit("o"), (F.col("conv_id") % 3).cast("string")).alias("owner")).distinct()
    m = c.withColumnRenamed("conv_id", "conversation_id").withColumnRenamed("turn", "created_at")
    mine = store.history(m, own, 4, "o1")
    return mine.union(store.history(m, own, 5, "o1")).select(F.col("created_at").alias("turn"), "role", "position")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 10")
def ring_buffer(s, d):
    return browse.ring(parquet(s, d, "events"), "event_id").select("event_id", "event_type")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS n FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 128)")
def first_pages_sorted(s, d):
    from pyspark.sql import Window

    top = store.first_n_then_sort(parquet(s, d, "part"), K.LIST_PAGES, "p_partkey", "p_name")
    return top.select("p_partkey", F.row_number().over(Window.orderBy("p_name", "p_partkey")).cast("long").alias("n"))


# mutations


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer UNION ALL SELECT o_orderkey + 1000000, 'new', 'NONE', o_totalprice FROM orders")
def insert_defaults(s, d):
    c = parquet(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    rows = parquet(s, d, "orders").select((F.col("o_orderkey") + 1000000).alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"))
    return store.inserted(c, rows, {"c_name": "new", "c_mktsegment": "NONE"})


@query("SELECT document_id, page_number, extracted_text, 'ocr' AS extraction_method, (row_number() OVER (PARTITION BY document_id ORDER BY page_number) - 1) // 32 AS batch_id FROM (" + LINES + ")")
def insert_pages(s, d):
    empty = s.createDataFrame([], "document_id long, page_number int, extracted_text string, extraction_method string")
    rows = store.inserted(empty, lines(s, d), {"extraction_method": "ocr"})
    return pages.batches(rows, K.PAGE_BATCH, "document_id", "page_number")


@query("SELECT c_custkey, c_name, CASE WHEN n >= 20 THEN NULL WHEN n >= 10 THEN 'GOLD' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN n >= 10 THEN CAST(n AS DOUBLE) ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def patch_rows(s, d):
    n = parquet(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    changes = n.select("c_custkey", F.lit("GOLD").alias("c_mktsegment"), F.col("n").cast("double").alias("c_acctbal"), F.when(F.col("n") >= 20, F.array(F.lit("c_mktsegment"))).alias("unset"))
    return store.patched(parquet(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), changes, "c_custkey", "unset")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ready' ELSE status END AS status, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN status = 'failed' THEN 'e' END AS error FROM (SELECT doc_id, " + STATUS + " AS status FROM documents)")
def replace_rows(s, d):
    old = docs(s, d).select("doc_id", F.expr(STATUS).alias("status")).withColumn("error", F.when(F.col("status") == "failed", "e"))
    new = old.where("doc_id % 4 = 0").select("doc_id", F.lit("ready").alias("status"), F.lit("kept?").alias("error"))
    return store.replaced(old, new.union(s.createDataFrame([(-5, "ready", "x")], "doc_id long, status string, error string")), "doc_id")


@query("SELECT doc_id, status FROM (SELECT doc_id, " + STATUS + " AS status FROM documents) WHERE NOT (status = 'uploading' AND doc_id % 2 = 0)")
def delete_guarded(s, d):
    old = docs(s, d).select("doc_id", F.expr(STATUS).alias("status"))
    return store.deleted(old, old.where("doc_id % 2 = 0").select("doc_id"), "doc_id", F.col("status") == "uploading")


@query("SELECT document_id, page_number FROM (" + LINES + ") WHERE document_id % 3 <> 0")
def delete_by_document(s, d):
    gone = docs(s, d).where("doc_id % 3 = 0").select(F.col("doc_id").alias("document_id"))
    return store.cleared(lines(s, d), gone).select("document_id", "page_number")


@query("SELECT conv_id, turn + 100 AS turn, upper(role) AS role FROM conversations WHERE conv_id % 2 = 0")
def append_messages(s, d):
    c = talk(s, d)
    rows = c.where("conv_id % 2 = 0").select("conv_id", (F.col("turn") + 100).alias("turn"), F.upper("role").alias("role"))
    return store.append_checked(c.select("conv_id"), rows, "conv_id")


@query("SELECT conv_id, turn, 'data: {\"type\":\"token\",\"turn\":' || turn || ',\"role\":\"' || role || '\"}' || chr(10) || chr(10) AS event FROM conversations")
def sse_events(s, d):
    return talk(s, d).select("conv_id", "turn", store.sse(F.struct(F.lit("token").alias("type"), "turn", "role")).alias("event"))


@query("SELECT '{' || chr(10) || '  \"n_nationkey\" : ' || n_nationkey || ',' || chr(10) || '  \"n_name\" : \"' || n_name || '\"' || chr(10) || '}' AS value FROM nation")
def payload_texts(s, d):
    return payload_json(parquet(s, d, "nation").select("n_nationkey", "n_name"))


@query("SELECT doc_id AS id, 't' || doc_id AS title, " + STATUS + " AS status, CAST(n_chars AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS file_url FROM documents")
def list_projection(s, d):
    full = docs(s, d).select(F.col("doc_id").alias("id"), F.lit("o").alias("owner"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"), F.lit("long").alias("summary"), F.lit("00").alias("sha256"), F.expr(STATUS).alias("status"), F.col("n_chars").cast("long").alias("size"), F.lit(1).alias("attempt"))
    return list_items(full)


@query("SELECT doc_id, lang FROM documents")
def drop_internal(s, d):
    return without_internal(docs(s, d).select("doc_id", "lang", F.lit("x").alias("error")))


# predicates


@query("SELECT document_id, count(*) FILTER (NOT " + _blank("extracted_text") + ") AS filled, bool_and(" + _blank("extracted_text") + ") AS all_blank, bool_or(" + _blank("extracted_text") + ") AS some_blank, arg_min(extracted_text, page_number) FILTER (NOT " + _blank("extracted_text") + ") AS first_filled FROM (" + LINES + ") GROUP BY 1")
def blank_pages(s, d):
    p = F.split("text", "\n")
    filled = F.filter(p, lambda x: ~T.is_blank(x))
    return wordy(s, d).select(F.col("doc_id").alias("document_id"), F.size(filled).cast("long").alias("filled"), T.every(p, T.is_blank).alias("all_blank"), T.some(p, T.is_blank).alias("some_blank"), T.find_first(p, lambda x: ~T.is_blank(x)).alias("first_filled"))


@query("SELECT p_partkey, p_partkey % 3 = 0 OR ends_with(lower(n), '.pdf') AS pdf, contains(lower(n), 'password') OR contains(lower(n), 'encrypt') AS encrypted, substr(n, 1, 5) = '%PDF-' AS magic FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '.PDF' WHEN 1 THEN '%PDF-' || p_name WHEN 2 THEN 'No Password: ' || p_name ELSE p_name END AS n FROM part)")
def file_checks(s, d):
    n = F.expr("CASE p_partkey % 4 WHEN 0 THEN p_name || '.PDF' WHEN 1 THEN '%PDF-' || p_name WHEN 2 THEN 'No Password: ' || p_name ELSE p_name END")
    p = parquet(s, d, "part").select("p_partkey", n.alias("n"))
    mime = F.when(F.col("p_partkey") % 3 == 0, "application/pdf")
    return p.select("p_partkey", lifecycle.looks_like_pdf(F.col("n"), mime).alias("pdf"), lifecycle.encrypted(F.col("n")).alias("encrypted"), lifecycle.has_magic(F.col("n").cast("binary")).alias("magic"))


@query("SELECT count(*) FILTER (p_size < 10) AS shown, count(*) AS total, count(*) FILTER (p_size < 10) || '/' || count(*) AS label FROM part")
def count_label(s, d):
    return browse.filtered_label(parquet(s, d, "part"), F.col("p_size") < 10)


@query("SELECT p_partkey FROM part WHERE p_partkey <> 5")
def list_without_pinned(s, d):
    p = parquet(s, d, "part").select("p_partkey")
    return browse.without_pinned(p, 5, " ", "p_partkey")


# joins and lists


@query("SELECT document_id, page_number, s AS summary, 'P' || page_number AS source_id FROM (SELECT *, CASE WHEN " + _blank("extracted_text") + " THEN 'No meaningful extractable text on this page.' ELSE substr(" + _normal("extracted_text") + ", 1, 30) END AS s FROM (" + LINES + "))")
def pages_with_summaries(s, d):
    p = lines(s, d)
    cut = p.select("document_id", "page_number", F.when(T.is_blank(F.col("extracted_text")), K.EMPTY_PAGE_SUMMARY).otherwise(F.substring(T.normalize_whitespace(F.col("extracted_text")), 1, 30)).alias("summary"))
    return pages.with_summaries(p, cut).select("document_id", "page_number", "summary", browse.source_label("P", F.col("page_number")).alias("source_id"))


@query(f"""WITH c AS (SELECT doc_id, i, CASE WHEN len(w) = 0 THEN 0 ELSE len(w) END AS n, w FROM ({_CHUNKS})),
h AS (SELECT doc_id, i, CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) AS h FROM (SELECT doc_id, i, unnest(list_transform(w, lambda t: lower(t))) AS x FROM c)),
p AS (SELECT doc_id, i, h % 64 AS place, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM h GROUP BY 1, 2, 3),
s AS (SELECT doc_id, i, sqrt(sum(v * v)) AS norm FROM p GROUP BY 1, 2)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, place, round(v / norm, 9) AS value FROM p JOIN s USING (doc_id, i) WHERE v <> 0""")
def chunk_embeddings(s, d):
    """Every component that isn't zero."""
    e = providers.embedded(chunking.text_chunks(wordy(s, d), "doc_id"), width=64)
    out = e.select("doc_id", "chunk_index", F.posexplode("embedding").alias("place", "value")).where("value <> 0")
    return out.select("doc_id", "chunk_index", F.col("place").cast("long").alias("place"), F.round("value", 9).alias("value"))


@query("SELECT doc_id, 'page ' || a AS one, CASE WHEN a = b THEN 'page ' || a ELSE 'pages ' || a || '-' || b END AS many, least(greatest(doc_id - 50, 1), 100) AS page, TRY_CAST(regexp_replace(source || doc_id, '[^0-9]', '', 'g') AS INTEGER) AS number, substr(lang || source, 1, 4) AS prefix FROM (SELECT *, doc_id % 7 AS a, doc_id % 7 + doc_id % 2 AS b FROM documents)")
def page_labels(s, d):
    a, b = F.col("doc_id") % 7, F.col("doc_id") % 7 + F.col("doc_id") % 2
    return docs(s, d).select("doc_id", T.page_label(a, a).alias("one"), T.page_label(a, b).alias("many"), T.clamp_page(F.col("doc_id") - 50, F.lit(100)).alias("page"), T.digits(F.concat("source", F.col("doc_id").cast("string"))).alias("number"), T.title_prefix(F.concat("lang", "source"), 4).alias("prefix"))


_MESSAGE = "conv_id, role, text AS content, turn * 4000 AS ms"


@query(f"""WITH m AS (SELECT {_MESSAGE}, turn FROM conversations), old AS (SELECT * FROM m WHERE turn % 2 = 0),
said AS (SELECT conv_id, role, CASE WHEN role = 'assistant' THEN regexp_replace(content, '^[{WS}]+|[{WS}]+$', '', 'g') ELSE content END AS content, ms FROM old)
SELECT conv_id, role, content, ms AS created_ms, false AS pending FROM said
UNION ALL SELECT conv_id, role, content, ms + CASE WHEN role = 'assistant' THEN 1 ELSE 0 END, true FROM m p WHERE length(content) > 0 AND NOT EXISTS (SELECT 1 FROM said o WHERE o.conv_id = p.conv_id AND o.role = p.role AND trim(o.content) = trim(p.content) AND o.ms >= p.ms - 5000)""")
def merged_messages(s, d):
    c = talk(s, d).select("conv_id", "role", F.col("text").alias("content"), (F.col("turn") * 4000).alias("ms"), "turn")
    out = browse.shown_messages(c.where("turn % 2 = 0").withColumnRenamed("ms", "created_ms"), c.withColumnRenamed("ms", "submitted_ms"), K.PENDING_SLACK_MS)
    return out.withColumn("created_ms", F.col("created_ms").cast("long"))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderkey > 120) = 0 AS is_done, CAST(120 AS BIGINT) AS continue_cursor FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 120")
def record_end_cursor(s, d):
    return records.page(parquet(s, d, "orders"), [], "o_orderkey", 20, 100, 120).select("o_orderkey", "is_done", F.col("continue_cursor").cast("long"))


@query("SELECT o_orderkey, (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 20)) AS continue_cursor FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 20")
def record_continue_cursor(s, d):
    return records.page(parquet(s, d, "orders"), [], "o_orderkey", 20, 100).select("o_orderkey", "continue_cursor")


@query("SELECT doc_id FROM (SELECT doc_id, [lang, source] AS tags, doc_id % 2 = 0 AS even FROM documents) WHERE tags = ['en', 'src1'] OR even = true")
def record_value_kinds(s, d):
    t = docs(s, d).select("doc_id", F.array("lang", "source").alias("tags"), (F.col("doc_id") % 2 == 0).alias("even"))
    w = [{"field": "tags", "value": ["en", "src1"], "connector": "OR"}, {"field": "even", "value": True, "connector": "OR"}]
    return records.find_many(t, w, ["doc_id"])


# streams


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_no, replace(text, chr(10), ' ') AS line FROM conversations")
def line_framing(s, d):
    """Each conversation as one text of lines, cut into pieces of eleven characters."""
    whole = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.regexp_replace("text", "\n", " ").alias("t")))), lambda x: x["t"]), "\n"), F.lit("\nrest"))
    w = talk(s, d).groupBy("conv_id").agg(whole.alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length("w") / 11) - 1), lambda i: F.substring(F.col("w"), (i * 11 + 1).cast("int"), F.lit(11)))
    return answers.framed(w.select("conv_id", F.posexplode(cut).alias("n", "piece")), ["conv_id"], "n")


@query("WITH t AS (SELECT conv_id, turn, role, text FROM conversations), e AS (SELECT conv_id, max(turn) AS last FROM t GROUP BY 1) SELECT conv_id, CAST(0 AS BIGINT) AS seq, 'meta' AS type, 'm' || conv_id AS payload FROM e UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn), 'token', text FROM t UNION ALL SELECT conv_id, (SELECT count(*) FROM t WHERE t.conv_id = e.conv_id) + 1, CASE WHEN last % 2 = 0 THEN 'done' ELSE 'error' END, 'x' FROM e WHERE conv_id % 3 <> 0")
def event_protocol(s, d):
    t = talk(s, d)
    last = t.groupBy("conv_id").agg(F.max("turn").alias("last"))
    ends = last.where("conv_id % 3 <> 0").select("conv_id", F.when(F.col("last") % 2 == 0, "done").otherwise("error").alias("type"), F.lit("x").alias("payload"))
    return answers.protocol(t.select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("payload")), last.select("conv_id", F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("payload")), ends)


@query("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'no meta' WHEN conv_id % 3 = 1 THEN 'no end' END AS fault FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 <> 2")
def event_protocol_faults(s, d):
    p = event_protocol(s, d)
    kept = p.where("type <> 'meta' or conv_id % 3 <> 0").where("type not in ('done', 'error') or conv_id % 3 = 2")
    return answers.protocol_faults(kept)


# state


@query("SELECT doc_id, CAST(1 AS INTEGER) AS attempt, TIMESTAMP '" + NOW + "' AS run_at FROM documents WHERE doc_id % 5 = 1")
def scheduled_jobs(s, d):
    up = docs(s, d).select("doc_id", F.expr(STATUS).alias("status"), F.lit(NOW).cast("timestamp_ntz").alias("at")).where("status = 'uploaded'")
    return lifecycle.scheduled(up, "doc_id", "at")


@query(f"SELECT o_orderkey, TIMESTAMP '{NOW}' + INTERVAL 15 MINUTES AS url_until FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderdate + INTERVAL 30 MINUTES <= TIMESTAMP '{NOW}')")
def reservations_left(s, d):
    o = parquet(s, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "uploading").otherwise("uploaded"))
    now = F.lit(NOW).cast("timestamp_ntz")
    return lifecycle.remove_expired(o, "o_orderdate", now).select("o_orderkey", lifecycle.signed_until(now).alias("url_until"))


_EVENT = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'accepted' WHEN 'click' THEN 'rejected' ELSE 'expired' END"


@query(f"SELECT c_custkey AS id, CASE e WHEN 'accepted' THEN 'uploaded' ELSE CASE WHEN e IS NULL THEN 'uploading' ELSE 'removed' END END AS status, CASE WHEN e IS NULL THEN 'sign' WHEN e = 'accepted' THEN 'sign,schedule' ELSE 'sign,delete' END AS actions FROM customer LEFT JOIN (SELECT user_id, arg_min({_EVENT}, event_id) AS e FROM events GROUP BY 1) ON user_id = c_custkey")
def upload_flow(s, d):
    c = parquet(s, d, "customer").select(F.col("c_custkey").alias("id"))
    e = parquet(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.expr(_EVENT).alias("event"))
    return flows.uploads(c, e)


@query("SELECT doc_id, CASE WHEN n_chars > 0 AND n BETWEEN 1 AND 100 AND doc_id % 4 <> 0 THEN 'accepted' ELSE 'rejected' END AS event FROM (SELECT doc_id, n_chars, len(string_split(text, chr(10))) AS n FROM documents)")
def upload_completion(s, d):
    n = F.size(F.split("text", "\n"))
    return docs(s, d).select("doc_id", lifecycle.completed_upload(F.col("n_chars"), n, F.col("doc_id") % 4 != 0).alias("event"))


# texts


@query("SELECT doc_id, CASE WHEN length(n) = 0 THEN 'none' ELSE n END AS summary, regexp_replace(replace(text, chr(0), ''), '^[" + WS + "]+|[" + WS + "]+$', '', 'g') AS extracted, CASE WHEN " + _blank("text") + " THEN '[No extractable text found in chunk 3 of the PDF.]' ELSE text END AS embedding_input, sha256(text) AS sha FROM (SELECT doc_id, text, " + _normal("text") + " AS n FROM documents)")
def text_normal_forms(s, d):
    t = F.col("text")
    return wordy(s, d).select("doc_id", T.normalize_summary(t, "none").alias("summary"), T.normalize_extracted(t).alias("extracted"), T.embedding_input(t, F.lit(3)).alias("embedding_input"), F.sha2(t.cast("binary"), 256).alias("sha"))


@query("SELECT p_partkey, coalesce(nullif(substr(trim(n), 1, 80), ''), 'New conversation') AS title, coalesce(nullif(trim(regexp_replace(n, '\\.pdf$', '', 'i')), ''), 'Untitled PDF') AS document, CASE WHEN regexp_matches(u, '^gs://([^/]+)/(.+)$') THEN regexp_extract(u, '^gs://([^/]+)/(.+)$', 1) END AS bucket, CASE WHEN regexp_matches(u, '^gs://([^/]+)/(.+)$') THEN regexp_extract(u, '^gs://([^/]+)/(.+)$', 2) END AS object FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '.PDF' WHEN 1 THEN '  ' ELSE p_name END AS n, CASE p_partkey % 2 WHEN 0 THEN 'gs://b/' || p_name ELSE 'http://' || p_name END AS u FROM part)")
def titles(s, d):
    n = F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name || '.PDF' WHEN 1 THEN '  ' ELSE p_name END")
    u = T.parse_object_uri(F.expr("CASE p_partkey % 2 WHEN 0 THEN 'gs://b/' || p_name ELSE 'http://' || p_name END"))
    return parquet(s, d, "part").select("p_partkey", T.conversation_title(n).alias("title"), T.document_title(n).alias("document"), u["bucket"].alias("bucket"), u["object"].alias("object"))


@query("SELECT event_id, strftime(ts, '%b %-d, %Y, %-I:%M %p') AS label FROM events")
def timestamp_labels(s, d):
    return parquet(s, d, "events").select("event_id", T.timestamp_label(F.col("ts")).alias("label"))


@query("""SELECT doc_id, step, CASE step WHEN 'upload' THEN CASE WHEN status <> 'uploading' THEN n || ' pages · ' || CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f', floor(n / 1024.0 * 10 + 0.5) / 10) || ' KB' END ELSE 'Uploading to storage...' END
WHEN 'ocr' THEN CASE WHEN ocr THEN n || ' pages processed' WHEN status = 'failed' THEN 'OCR failed' WHEN status IN ('processing', 'uploaded') THEN 'Running OCR on document pages...' ELSE 'Waiting for upload to complete' END
ELSE CASE WHEN emb THEN n || ' pages embedded' WHEN status = 'failed' AND ocr THEN 'Embedding failed' WHEN ocr AND status = 'processing' THEN 'Embedding pages...' ELSE 'Waiting for OCR' END END AS detail
FROM (SELECT doc_id, n_chars AS n, """ + STATUS + """ AS status, doc_id % 3 = 0 AS ocr, doc_id % 6 = 0 AS emb, unnest(['upload', 'ocr', 'embedding']) AS step FROM documents)""")
def step_details(s, d):
    at = lambda n: F.when(F.col("doc_id") % n == 0, F.lit(NOW).cast("timestamp"))
    steps = browse.pipeline_steps(F.expr(STATUS), at(3), at(6), F.col("n_chars"), F.col("n_chars"), F.lit(None).cast("string"))
    return docs(s, d).select("doc_id", F.inline(steps)).select("doc_id", "step", "detail")


@query("SELECT conv_id, turn, CASE k WHEN 0 THEN 'said' WHEN 1 THEN text || chr(10) WHEN 2 THEN regexp_replace(text, '^[" + WS + "]+|[" + WS + "]+$', '', 'g') END AS shown FROM (SELECT conv_id, turn, turn % 3 AS k, text || CASE WHEN conv_id % 2 = 0 THEN ' \"' || role || '\" ' || chr(92) || ' end' ELSE '' END AS text FROM conversations)")
def shown_contents(s, d):
    """Texts with quotes and backslashes in them as well; an answer's field is escaped and cut off, other texts aren't."""
    k = F.col("turn") % 3
    t = F.concat("text", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(' "'), F.col("role"), F.lit('" \\ end'))).otherwise(F.lit("")))
    c = talk(s, d).withColumn("text", t)
    field = F.regexp_replace(F.to_json(F.struct(F.concat("text", F.lit("\n")).alias("answer"))), r"^\{|\}$", "")
    content = F.when(k == 0, F.lit(' {"answer":" said ","citations":[]}')).when(k == 1, F.concat(F.lit("x {"), field, F.lit(", "))).otherwise(F.concat(F.lit("  "), F.col("text"), F.lit(" ")))
    return c.select("conv_id", "turn", grounding.shown_content(content).alias("shown"))


@query("SELECT n_nationkey, '{\"k\":' || n_nationkey || '}' AS credentials FROM nation WHERE n_nationkey % 3 <> 2 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 3 = 2")
def decoded_credentials(s, d):
    j = F.concat(F.lit('{"k":'), F.col("n_nationkey").cast("string"), F.lit("}"))
    given = F.when(F.col("n_nationkey") % 3 == 0, j).when(F.col("n_nationkey") % 3 == 1, F.base64(j.cast("binary"))).otherwise(F.lit("?!"))
    return parquet(s, d, "nation").select("n_nationkey", T.decode_credentials(given).alias("credentials"))


@query("SELECT n_nationkey, 'm1' AS model, 'x' AS other FROM nation")
def settings(s, d):
    s.conf.set("pagewright.model", "m1")
    try:
        model, other = T.setting(s, "model", "m0"), T.setting(s, "other", "x")
    finally:
        s.conf.unset("pagewright.model")
    return parquet(s, d, "nation").select("n_nationkey", F.lit(model).alias("model"), F.lit(other).alias("other"))


# summaries, prompts, turns


@query("SELECT conv_id, turn, CASE WHEN k = 0 THEN 'What of ' || turn WHEN length(n) > 0 THEN n ELSE text END AS standalone_query, CASE WHEN k = 0 OR regexp_matches(lower(text), '(^|[^a-z0-9_])(summar(ize|y)|overview|key findings|takeaways?|main points?|what is this document about)([^a-z0-9_]|$)') THEN 'summaries' ELSE 'chunks' END AS mode FROM (SELECT conv_id, turn, turn % 4 AS k, text, " + _normal("text") + " AS n FROM (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'The key findings of ' || text WHEN 1 THEN text ELSE '  ' END AS text FROM conversations))")
def route_validation(s, d):
    """Decisions that hold and that don't; without one, all texts are routed by their words, also blank ones."""
    k = F.col("turn") % 4
    decision = F.when(k == 0, F.concat(F.lit('{"standaloneQuery":" What  of '), F.col("turn").cast("string"), F.lit('","retrievalMode":"summaries"}'))).when(k == 1, F.lit('{"standaloneQuery":7,"retrievalMode":"summaries"}')).when(k == 2, F.lit('{"standaloneQuery":"q","retrievalMode":"all"}')).otherwise(F.lit("no json"))
    said = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("The key findings of "), F.col("text"))).when(F.col("conv_id") % 3 == 1, F.col("text")).otherwise(F.lit("  "))
    r = grounding.routed(decision, F.col("text"))
    return talk(s, d).withColumn("text", said).select("conv_id", "turn", r["standalone_query"].alias("standalone_query"), r["retrieval_mode"].alias("mode"))


@query("""WITH p AS (SELECT document_id, page_number, length(extracted_text) || ' chars' AS s FROM (""" + LINES + """)), c AS (SELECT document_id, string_agg('[P' || page_number || '] page ' || page_number || chr(10) || s, chr(10) || chr(10) ORDER BY page_number) AS blocks, count(*) AS n FROM p GROUP BY 1)
SELECT document_id, n, 'Document: D' || document_id || chr(10) || chr(10) || 'Sources:' || chr(10) || 'Document summary' || chr(10) || 'sum' || chr(10) || chr(10) || blocks || chr(10) || chr(10) || 'Question: why' AS prompt FROM c""")
def summary_prompts(s, d):
    p = lines(s, d).select("document_id", "page_number", F.concat(F.length("extracted_text").cast("string"), F.lit(" chars")).alias("summary"))
    own = docs(s, d).select(F.col("doc_id").alias("document_id"), F.lit("sum").alias("summary"))
    c = grounding.summary_context(own, p)
    title = F.concat(F.lit("D"), F.col("document_id").cast("string"))
    return c.select("document_id", F.size("page_summaries").cast("long").alias("n"), grounding.prompt(title, F.col("context"), F.lit("why")).alias("prompt"))


@query("SELECT document_id, CASE WHEN bool_and(b) THEN 'No meaningful extractable text was found in this document.' ELSE string_agg(s, ' ' ORDER BY page_number) FILTER (NOT b) END AS summary FROM (SELECT document_id, page_number, " + _blank("extracted_text") + " AS b, substr(" + _normal("extracted_text") + ", 1, 10) AS s FROM (" + LINES + ")) GROUP BY 1")
def document_summary_texts(s, d):
    cut = F.substring(T.normalize_whitespace(F.col("extracted_text")), 1, 10)
    p = lines(s, d).select("document_id", "page_number", F.when(T.is_blank(F.col("extracted_text")), K.EMPTY_PAGE_SUMMARY).otherwise(cut).alias("summary"))
    return providers.document_summaries(p)


@query("SELECT doc_id, CAST(i AS INTEGER) AS shard_index, CAST(i * 100 + 1 AS INTEGER) AS first, CAST(least((i + 1) * 100, n) AS INTEGER) AS last FROM (SELECT doc_id, n_chars % 350 AS n, unnest(range(0, CAST(ceil((n_chars % 350) / 100.0) AS BIGINT))) AS i FROM documents)")
def ocr_shard_ranges(s, d):
    return docs(s, d).select("doc_id", F.posexplode(providers.page_ranges(F.col("n_chars") % 350)).alias("shard_index", "r")).select("doc_id", "shard_index", "r.first", "r.last")


@query("SELECT conv_id, turn, n AS standalone_query, array_to_string(terms, ' ') AS terms FROM (SELECT conv_id, turn, n, list_filter(l, lambda x, i: list_position(l, x) = i)[1:12] AS terms FROM (SELECT conv_id, turn, " + _normal("text") + " AS n, list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._/-]*'), lambda t: (length(t) >= 3 OR regexp_matches(t, '[0-9]')) AND t NOT IN (" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + ")) AS l FROM conversations WHERE text <> '')) WHERE length(n) > 0")
def questions_in_bulk(s, d):
    q = talk(s, d).select("conv_id", "turn", F.struct("conv_id", "turn").alias("id"), F.col("text").alias("question")).where("question <> ''")
    return flows.answers_in_bulk(q.where(T.normalize_whitespace(F.col("question")) != "")).select("id.conv_id", "id.turn", "standalone_query", "terms")


def _answer_table(s, d):
    """One document's tables, as the chat turn reads them."""
    one = docs(s, d).orderBy(F.desc("n_chars"), "doc_id").limit(1)
    p = one.select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("i", "extracted_text")).select("document_id", (F.col("i") + 1).alias("page_number"), "extracted_text")
    c = providers.embedded(chunking.page_chunks(p), width=64).withColumn("id", F.concat_ws(":", "document_id", F.col("chunk_index").cast("string")))
    doc = one.select(F.col("doc_id").cast("string").alias("id"), F.lit("o").alias("owner"), F.lit("T").alias("title"), F.lit("ready").alias("status"), F.lit("all of it").alias("summary"))
    conv = doc.select(F.lit("c").alias("id"), "owner", F.col("id").alias("document_id"))
    messages = s.createDataFrame([], "conversation_id string, role string, content string, created_at timestamp")
    pages_ = p.select("document_id", "page_number", providers.page_summary(F.col("extracted_text")).alias("summary"))
    return {"documents": doc, "pages": pages_, "chunks": c, "conversations": conv, "messages": messages}, doc.first().id


@query("""WITH x AS (SELECT doc_id, text, regexp_extract_all(text, '[^""" + WS + """]+') AS w FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1)
SELECT CAST(200 AS INTEGER) AS status, 'chunks' AS mode, 'found' AS answer, CAST(1 AS BIGINT) AS n_citations, CAST(2 AS BIGINT) AS n_messages FROM x""")
def chat_turn(s, d):
    """A whole turn over the longest document: the model cites the first word of its first source."""
    tables, document = _answer_table(s, d)

    def answer(prompt: str) -> str:
        import json

        body = prompt.split("Sources:\n", 1)[1].split("\n", 1)[1]
        return json.dumps({"answer": " found ", "citations": [{"sourceId": "S1", "quote": body.split()[0]}, {"sourceId": "S9", "quote": "x"}]})

    question = tables["chunks"].orderBy("chunk_index").first().text.split(" ")[:5]
    embed = lambda q: providers.hashed_embeddings([q], 64)[0].tolist()
    out, messages = flows.chat_turn(tables, document, "c", "o", " ".join(question), embed, lambda h, q: "broken", answer, F.lit(NOW).cast("timestamp"))
    row = [(out["status"], out["mode"], out["answer"], len(out["citations"]), messages.count())]
    return s.createDataFrame(row, "status int, mode string, answer string, n_citations long, n_messages long")
