"""The entry points: ingest documents, answer from them, and browse them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EMBEDDING_BATCH, EMPTY_PAGE_SUMMARY, LIST_DOCUMENTS, MAX_TERMS, ROUTING_TURNS, STOP_WORDS, SUMMARY_BATCH
from ..functions.providers import document_summaries, embedded, hashed_embeddings, page_summary, summarised
from ..functions.text import embedding_input, error_message, fallback_route, is_blank, keyword_terms, normalize_summary
from ..operators import browse, grounding, lifecycle, retrieval, store
from ..operators.chunking import page_chunks
from ..operators.pages import extract_pages, with_summaries
from ..storage.ledger import Ledger
from ..storage.log import release
from ..storage.postings import Index
from ..storage.snapshots import Table
from ..storage.vectors import VectorIndex

SENT = 1 << 21  # documents whose ids go to all tasks, so that no text is dealt to leave out other documents'


def query_terms(query: str) -> list[str]:
    """keyword_terms of a parameter."""
    found = re.findall(r"[a-z0-9][a-z0-9._/-]*", query.lower())
    return list(dict.fromkeys(t for t in found if (len(t) >= 3 or re.search("[0-9]", t)) and t not in STOP_WORDS))[:MAX_TERMS]


def ingest(shards: DataFrame, expected: DataFrame, width: int = 1536) -> dict[str, DataFrame]:
    """pages, chunks with vectors, and document summaries of OCR shards, by the stand-ins and without a store: each is a plan of its
    own. ingested() does it once, with any provider."""
    extracted = extract_pages(shards, expected)
    pages = with_summaries(extracted, extracted.select("document_id", "page_number", page_summary(F.col("extracted_text")).alias("summary")))
    return {"pages": pages, "chunks": embedded(page_chunks(pages), width=width), "documents": document_summaries(pages)}


class Models(NamedTuple):
    """Providers that ingestion calls: a name, and a function from a batch of texts to their answers."""

    summary_model: str
    summarise: Callable[[list[str]], list[str]]
    embedding_model: str
    embed: Callable[[list[str]], list[list[float]]]


def ingested(shards: DataFrame, expected: DataFrame, publish_to: str, models: Models, documents: DataFrame) -> dict[str, DataFrame]:
    """pages, chunks and document summaries of OCR shards, published for ``documents`` (document_id) in snapshot tables.

    Every step reads what the step before has committed, so shards are read once, and providers are asked through a ledger
    (summaries in batches of ten, vectors in batches of 64): neither another output nor another attempt asks for a text
    again. Blank pages aren't sent to a provider. A vector count or width that doesn't fit is an error. Shuffles of a step go
    before the next one begins.
    """
    spark = shards.sparkSession
    ledger = Ledger(spark, f"{publish_to}/ledger")
    tables = {n: Table(spark, f"{publish_to}/{n}") for n in ("extracted", "pages", "chunks")}
    own = documents.select("document_id").distinct()
    own = F.broadcast(own) if own.count() <= SENT else own
    mine = lambda name: tables[name].read().join(own, "document_id", "left_semi")
    tables["extracted"].publish(extract_pages(shards, expected), documents=documents)
    release(spark)
    text = F.when(~is_blank(F.col("extracted_text")), F.col("extracted_text"))
    said = ledger.answered(mine("extracted"), text, models.summary_model, models.summarise, batch=SUMMARY_BATCH, to="summary")
    summary = F.when(text.isNull(), F.lit(EMPTY_PAGE_SUMMARY)).otherwise(normalize_summary(F.col("summary"), EMPTY_PAGE_SUMMARY))
    tables["pages"].publish(said.withColumn("summary", summary), documents=documents)
    release(spark)
    chunks = page_chunks(mine("pages"))
    widths = ledger.answered(chunks, embedding_input(F.col("text"), F.col("chunk_index")), models.embedding_model, models.embed, "array<double>", EMBEDDING_BATCH, "embedding")
    tables["chunks"].publish(widths, documents=documents)
    release(spark)
    return {"pages": mine("pages"), "chunks": mine("chunks"), "documents": document_summaries(mine("pages"))}


def retrieve(texts: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], document=None) -> DataFrame:
    """Six best of texts (id, text) for a query: lexical and vector top-12, fused and reranked. With a document, both searches
    see its rows (document_id) only; the filter reaches both scans."""
    if document is not None:
        texts, vectors = (df.where(F.col("document_id") == F.lit(document)) for df in (texts, vectors))
    terms = query_terms(query)
    lexical = retrieval.lexical_top_k(texts, " ".join(terms) or query.strip())
    vector = retrieval.vector_top_k(vectors, query_vector)
    return retrieval.rerank(retrieval.fuse(lexical, vector), texts, terms)


def retrieve_indexed(texts: DataFrame, lexical: Index, vector: VectorIndex, query: str, query_vector: list[float], document=None, exact: bool = False) -> DataFrame:
    """The same from stored indexes, which a document is the key of if one is given. Of texts (id, text) only those of the
    candidates, 24 at most, are read."""
    terms = query_terms(query)
    found = lexical.top_k(" ".join(terms) or query.strip(), key=document)
    near = vector.search(query_vector, key=document, exact=exact)
    return retrieval.rerank(retrieval.fuse(found, near), texts, terms)


def chat_turn(
    tables: dict[str, DataFrame],
    document,
    conversation,
    owner,
    question: str,
    embed: Callable[[str], list[float]],
    route: Callable[[list, str], str],
    answer: Callable[[str], str],
    now: Column,
) -> tuple[dict, DataFrame | None]:
    """One question to one document: (outcome, messages to be stored). tables: documents (id, owner, title, status, summary),
    pages, chunks (id, document_id, ..., embedding), conversations (id, owner, document_id), messages.

    The request is checked in a fixed order; the question is routed with the last turns; chunks or summaries are brought
    together as sources; the model's answer is parsed, strictly or as far as it can be read; its citations are checked
    against the sources. Both messages are given back to be appended. The driver holds one question's sources: six
    chunks, or a document's summaries.
    """
    spark = tables["documents"].sparkSession
    doc = store.owned(tables["documents"], "id", document, "owner", owner).select("title", "status", "summary").first()
    conv = store.owned(tables["conversations"], "id", conversation, "owner", owner).where(F.col("document_id") == F.lit(document)).first()
    chunks = tables["chunks"].where(F.col("document_id") == F.lit(document))
    facts = {
        "authenticated": owner is not None,
        "parsed": True,
        "complete": bool(question and question.strip()),
        "owned": doc is not None,
        "ready": doc is not None and doc.status == "ready",
        "summarised": doc is not None and bool(doc.summary and doc.summary.strip()),
        "conversation": conv is not None,
        "chunked": not chunks.limit(1).isEmpty(),
    }
    checked = spark.range(1).select(lifecycle.request_status({k: F.lit(v) for k, v in facts.items()}).alias("s")).first().s
    if checked.status != 200:
        return {"status": checked.status, "reason": checked.reason}, None
    turns = store.last_n(tables["messages"].where(F.col("conversation_id") == F.lit(conversation)), ROUTING_TURNS, ["conversation_id"], "created_at")
    history = [(r.role, r.content) for r in turns.orderBy("position").select("role", "content").collect()]
    try:
        decision = route(history, question)
    except Exception:  # whatever a model does wrong, the question is routed without it
        decision = None
    picked = spark.range(1).select(grounding.routed(F.lit(decision).cast("string"), F.lit(question)).alias("r")).first().r
    if picked.retrieval_mode == "chunks":
        best = retrieve(chunks, chunks, picked.standalone_query, embed(picked.standalone_query), document)
        # six rows: held, so that searching isn't done again for each of the next steps
        sources = spark.createDataFrame(best.select("source_id", "final_rank", F.col("id").alias("chunk_id"), "text", "start_page_number", "end_page_number", "page_spans").collect(), _SOURCES)
        context = sources.withColumn("k", F.lit(1)).transform(lambda df: grounding.chunk_context(df, ["k"])).first()
    else:
        pages = tables["pages"].where(F.col("document_id") == F.lit(document))
        summary = tables["documents"].where(F.col("id") == F.lit(document)).select(F.col("id").alias("document_id"), "summary")
        context = grounding.summary_context(summary, pages).first()
        sources = pages.select(browse.source_label("P", F.col("page_number")).alias("source_id"), "page_number", "summary")
    asked = spark.range(1).select(grounding.prompt(F.lit(doc.title), F.lit(context.context if context else None).cast("string"), F.lit(question)).alias("p")).first().p
    content = answer(asked)
    raw = spark.range(1).select(grounding.parse_answer(F.lit(content), picked.retrieval_mode == "chunks").alias("a"), grounding.tolerant_answer(F.lit(content)).alias("said"))
    cited = raw.select(F.posexplode("a.citations").alias("pos", "c")).select("pos", "c.*")
    if picked.retrieval_mode == "chunks":
        valid = grounding.validated_citations(cited, sources)
    else:
        valid = grounding.summary_citations(cited, sources)
    said = raw.first().said
    if said is None:
        return {"status": 502, "reason": "no_answer"}, None
    rows = spark.createDataFrame([(0, "user", question), (1, "assistant", said)], "n int, role string, content string")
    messages = rows.select(F.lit(conversation).alias("conversation_id"), "role", "content", (now + F.make_dt_interval(secs=F.col("n") / 1000)).alias("created_at"))
    messages = store.append_checked(tables["conversations"].select(F.col("id").alias("conversation_id")), messages, "conversation_id")
    outcome = {"status": 200, "reason": "ok", "mode": picked.retrieval_mode, "query": picked.standalone_query, "answer": said}
    return outcome | {"citations": [r.asDict() for r in valid.orderBy("citation").collect()]}, messages


class Assistant(NamedTuple):
    """Providers that answer questions: a name, and a function from a batch of texts to one answer for each. route (JSON of history
    and question to a decision) may be left out."""

    embedding_model: str
    embed: Callable[[list[str]], list[list[float]]]
    answer_model: str
    answer: Callable[[list[str]], list[str]]
    route_model: str = ""
    route: Callable[[list[str]], list[str]] | None = None


def chat_turns(tables: dict[str, DataFrame], asked: DataFrame, at: str, assistant: Assistant, now: Column) -> dict[str, DataFrame]:
    """Many chat turns at once: asked (turn_id, document_id, conversation_id, owner, question), and tables as for chat_turn.

    outcomes (turn_id, status, reason, mode, query, answer): each request is checked in the fixed order, routed, given its
    sources, answered and read, as chat_turn does with one. citations (turn_id, citation, source_id, chunk_id, quote,
    start_offset, page_number, snippet). messages: both of each answered turn, to be appended.

    Every step is a join or an aggregation over all turns; the driver holds none. Providers are asked through a ledger in the
    folder ``at``; sources are written there once, since prompts and citations both read them.
    """
    spark = asked.sparkSession
    ledger, scratch = Ledger(spark, f"{at}/ledger"), f"{at}/turns/{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{scratch}/{name}")
        return spark.read.schema(df.schema).parquet(f"{scratch}/{name}")

    yes = F.lit(True)
    own = tables["documents"].select(F.col("id").alias("document_id"), "owner", "title", F.col("status").alias("state"), "summary", yes.alias("_owned"))
    talks = tables["conversations"].select(F.col("id").alias("conversation_id"), "owner", "document_id", yes.alias("_talk"))
    full = tables["chunks"].select("document_id").distinct().withColumn("_chunks", yes)
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    known = asked.join(own, ["document_id", "owner"], "left").join(talks, ["conversation_id", "owner", "document_id"], "left").join(full, "document_id", "left")
    said = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    ladder = {"authenticated": F.col("owner").isNotNull(), "parsed": yes, "complete": said("question"), "owned": has("_owned"), "ready": F.coalesce(F.col("state") == "ready", F.lit(False)), "summarised": said("summary"), "conversation": has("_talk"), "chunked": has("_chunks")}
    checked = known.withColumn("check", lifecycle.request_status(ladder)).select(*asked.columns, "title", "check.status", "check.reason")
    good = checked.where("status = 200").drop("status", "reason")

    decision = F.lit(None).cast("string")
    if assistant.route:
        last = store.last_n(tables["messages"], ROUTING_TURNS, ["conversation_id"], "created_at")
        line = F.transform(F.array_sort(F.collect_list(F.struct("position", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
        good = good.join(last.groupBy("conversation_id").agg(line.alias("history")), "conversation_id", "left")
        to_route = F.to_json(F.struct(F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")).alias("history"), "question"))
        good = ledger.answered(good, to_route, assistant.route_model, assistant.route, to="decision").drop("history")
        decision = F.col("decision")
    r = grounding.routed(decision, F.col("question"))
    turns = written(good.withColumn("r", r).select(*asked.columns, "title", F.col("r.standalone_query").alias("query"), F.col("r.retrieval_mode").alias("mode")), "turns")

    by_chunk = ledger.answered(turns.where("mode = 'chunks'"), F.col("query"), assistant.embedding_model, assistant.embed, "array<double>", EMBEDDING_BATCH, "vector")
    found = retrieval.retrieve_many(by_chunk.withColumnRenamed("turn_id", "question_id"), tables["chunks"]).withColumnRenamed("question_id", "turn_id")
    shown = tables["chunks"].select(F.col("id").alias("chunk_id"), "text", "start_page_number", "end_page_number", "page_spans")
    sources = written(found.withColumnRenamed("id", "chunk_id").join(shown, "chunk_id"), "sources")
    pages = tables["pages"].select("document_id", "page_number", "summary")
    about = turns.where("mode = 'summaries'").select("turn_id", "document_id")
    whole = grounding.summary_context(tables["documents"].select(F.col("id").alias("document_id"), "summary"), pages)
    context = grounding.chunk_context(sources, ["turn_id"]).unionByName(about.join(whole, "document_id").select("turn_id", "context"))

    text = grounding.prompt(F.col("title"), F.col("context"), F.col("question"))
    answered = ledger.answered(turns.join(context, "turn_id", "left").withColumn("prompt", text), F.col("prompt"), assistant.answer_model, assistant.answer, to="content")
    parsed = F.when(F.col("mode") == "chunks", grounding.parse_answer(F.col("content"), True)["citations"])
    named = F.when(F.col("mode") == "summaries", grounding.parse_answer(F.col("content"), False)["citations"])
    answered = written(answered.select("turn_id", "conversation_id", "document_id", "question", "mode", "query", grounding.tolerant_answer(F.col("content")).alias("answer"), parsed.alias("quoted"), named.alias("named")), "answers").where("answer is not null")
    quotes = grounding.validated_citations(answered.select("turn_id", F.posexplode("quoted").alias("pos", "c")).select("turn_id", "pos", "c.*"), sources, ["turn_id"])
    cited = answered.select("turn_id", "document_id", F.posexplode("named").alias("pos", "c")).select("turn_id", "pos", "c.source_id")
    paged = about.join(pages, "document_id").select("turn_id", browse.source_label("P", F.col("page_number")).alias("source_id"), F.col("page_number").cast("long").alias("page_number"))
    citations = quotes.unionByName(grounding.summary_citations(cited, paged, ["turn_id"]).select("turn_id", "citation", "source_id", "page_number"), allowMissingColumns=True)

    done = answered.select("turn_id", "mode", "query", "answer")
    lost = (F.col("status") == 200) & F.col("answer").isNull()
    outcomes = checked.select("turn_id", "status", "reason").join(done, "turn_id", "left")
    outcomes = outcomes.select("turn_id", F.when(lost, 502).otherwise(F.col("status")).alias("status"), F.when(lost, "no_answer").otherwise(F.col("reason")).alias("reason"), "mode", "query", "answer")
    both = F.array(F.struct(F.lit(0).alias("n"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("n"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    messages = answered.select("conversation_id", F.inline(both)).select("conversation_id", "role", "content", (now + F.make_dt_interval(secs=F.col("n") / 1000)).alias("created_at"))
    return {"outcomes": outcomes, "citations": citations, "messages": messages}


_SOURCES = "source_id string, final_rank long, chunk_id string, text string, start_page_number int, end_page_number int, page_spans array<struct<page_number:int,start_offset:int,end_offset:int>>"


def stand_ins(width: int = 1536) -> Models:
    """Providers that work offline: a first sentence, and a hashed bag of words."""
    return Models("first-sentence", summarised, f"hashed-{width}", lambda texts: hashed_embeddings(texts, width).tolist())


def ingestion_attempt(documents: DataFrame, document, attempt: int, read: Callable[[], tuple[DataFrame, DataFrame]], publish_to: str, now: Column, error_facts: Callable[[Exception], dict] | None = None, width: int = 1536, models: Models | None = None) -> dict:
    """One attempt to process a document: (status, attempt, next_at, error, pages, chunks). documents: id, status, attempt.

    It begins only with a higher attempt than the stored one and unless the document is ready. read gives OCR shards and
    expected pages (see ingested). Pages and chunks replace those of earlier attempts, each by one commit. A transient error
    (error_facts: http, code, errno) makes another attempt after 15 s, then 60 s; after three attempts, and for other errors,
    it has failed. What providers answered in a failed attempt isn't asked for again.
    """
    spark = documents.sparkSession
    row = store.point(documents, "id", document).select("status", "attempt").first()
    if row is None or row.status == "ready" or (row.attempt or 0) >= attempt:
        return {"status": "skipped", "attempt": attempt}
    try:
        ids = spark.createDataFrame([(document,)], f"document_id {dict(documents.dtypes)['id']}")
        out = ingested(*read(), publish_to, models or stand_ins(width), ids)
        return {"status": "ready", "attempt": attempt, "pages": out["pages"].count(), "chunks": out["chunks"].count(), "summary": out["documents"].first().summary}
    except Exception as e:  # every error is classified: it is retried or it is final
        facts = {"http": None, "code": None, "errno": None} | (error_facts(e) if error_facts else {})
        again = lifecycle.transient(F.lit(facts["http"]).cast("int"), F.lit(facts["code"]).cast("int"), F.lit(facts["errno"]).cast("string"), F.lit(str(e)))
        r = spark.range(1).select(lifecycle.retry(F.lit(attempt), now, again).alias("r")).first().r
        message = spark.range(1).select(error_message(F.lit(str(e))).alias("m")).first().m
        return {"status": r.status, "attempt": attempt, "next_at": r.next_at, "error": message}


def uploads(reservations: DataFrame, events: DataFrame) -> DataFrame:
    """(id, status, actions) of uploads: reservations (id, created_at) and what then happened (id, at, event; the end of an upload
    is 'accepted' or 'rejected', see completed_upload; 'failed' is an error on the way; 'expired' the reservation's
    end). The first event in time decides; what comes later finds the upload settled."""
    first = events.groupBy("id").agg(F.min_by("event", F.struct("at", "event")).alias("event"))
    out = reservations.join(first, "id", "left").withColumn("s", lifecycle.upload_step(F.lit("uploading"), F.coalesce("event", F.lit("none"))))
    acted = F.filter(F.array(F.lit("sign"), F.col("s.action")), lambda a: a != "none")
    return out.select("id", F.col("s.status").alias("status"), F.array_join(acted, ",").alias("actions"))


def answers_in_bulk(questions: DataFrame) -> DataFrame:
    """questions (id, question) with mode, standalone_query and terms: the routing without a model, for many at once."""
    r = fallback_route(F.col("question"))
    return questions.select("id", r["retrieval_mode"].alias("mode"), r["standalone_query"].alias("standalone_query"), F.array_join(keyword_terms(F.col("question")), " ").alias("terms"))


def workspace(documents: DataFrame, owner: str, query: str = "") -> DataFrame:
    """The owner's newest documents; the filter sees those only."""
    mine = store.newest(store.equal(documents, owner=owner), LIST_DOCUMENTS, "created_at")
    return browse.text_filter(mine, query, "title", "filename")
