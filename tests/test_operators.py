"""Edge cases of the operators, from their written semantics."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import providers
from pagewright.functions import text as T
from pagewright.operators import chunking, grounding, lifecycle, pages, records, retrieval, store
from pagewright.plans import flows
from pagewright.streaming.answers import AnswerExtractor, framed


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_keyword_terms(spark):
    t = lambda s: one(spark, T.keyword_terms(F.lit(s)))
    assert t("the. Q3-2024 7 ab abc the") == ["the.", "q3-2024", "7", "abc"]
    assert t("the of and") == []
    assert len(t(" ".join(f"term{i}" for i in range(20)))) == 12


def test_snippet_and_titles(spark):
    s = "x" * 150 + "quote" + "y" * 150
    assert one(spark, T.snippet(F.lit(s), F.lit(150), F.lit(155))) == "..." + "x" * 100 + "quote" + "y" * 100 + "..."
    assert one(spark, T.snippet(F.lit("quote"), F.lit(0), F.lit(5))) == "quote"
    assert one(spark, T.document_title(F.lit(" a.PDF"))) == "a"
    assert one(spark, T.document_title(F.lit(".pdf"))) == "Untitled PDF"
    assert one(spark, T.conversation_title(F.lit("  "))) == "New conversation"
    assert one(spark, T.parse_object_uri(F.lit("gs://b/c/d"))["object"]) == "c/d"
    assert one(spark, T.parse_object_uri(F.lit("http://b"))) is None
    assert one(spark, T.normalize_summary(F.lit("  "))) .startswith("No meaningful")


@pytest.mark.parametrize("n, label", [(1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1048575, "1024.0 KB"), (1048576, "1.0 MB")])
def test_file_size(spark, n, label):
    assert one(spark, T.file_size(F.lit(n))) == label


def test_decode_credentials(spark):
    import base64

    assert one(spark, T.decode_credentials(F.lit('{"a":1}'))) == '{"a":1}'
    assert one(spark, T.decode_credentials(F.lit(base64.b64encode(b'{"a":2}').decode()))) == '{"a":2}'


@pytest.mark.parametrize("n", [0, 1, 450, 451, 825, 826])
def test_chunks_cover_the_words(spark, n):
    words = [f"w{i}" for i in range(n)]
    rows = chunking.text_chunks(spark.createDataFrame([("d", " ".join(words))], "document_id string, text string")).orderBy("chunk_index").collect()
    start, want = 0, []
    while n:
        want.append(words[start : start + 450])
        if start + 450 >= n:
            break
        start += 375
    assert [r.text.split() for r in rows] == want


def test_page_chunks(spark):
    p = spark.createDataFrame([("a", 1, "one two"), ("a", 2, "  "), ("a", 3, "three"), ("b", 1, ""), ("b", 2, "")], "document_id string, page_number int, extracted_text string")
    a, b = chunking.page_chunks(p).orderBy("document_id").collect()
    assert a.text == "one two three" and [tuple(s) for s in a.page_spans] == [(1, 0, 7), (3, 8, 13)]
    assert (a.start_page_number, a.end_page_number, a.token_count) == (1, 3, 3)
    assert b.text == chunking.NO_TEXT and (b.start_page_number, b.end_page_number, b.token_count) == (1, 2, 7) and len(b.text) == 40


def test_shards(spark):
    schema = f"document_id string, shard_index int, {pages.SHARD_SCHEMA}"
    page = lambda n, a, b: {"pageNumber": n, "layout": {"textAnchor": {"textSegments": [{"startIndex": a, "endIndex": b}]}}}
    rows = [("d", 0, "first", [page(2, "", "5")]), ("d", 1, "later", [page(2, "0", "5"), page(-1, "0", "2")]), ("e", 0, "whole", [])]
    got = pages.extract_pages(spark.createDataFrame(rows, schema), spark.createDataFrame([("d", 4), ("e", 0)], "document_id string, page_count int"))
    assert sorted(map(tuple, got.collect())) == [("d", 1, ""), ("d", 2, "la"), ("d", 3, ""), ("d", 4, ""), ("e", 1, "whole")]


def test_summaries_are_required(spark):
    p = spark.createDataFrame([("d", 1, "x")], "document_id string, page_number int, extracted_text string")
    s = spark.createDataFrame([("d", 1, "s"), ("d", 1, "t")], "document_id string, page_number int, summary string")
    assert pages.with_summaries(p, s.limit(1)).first().summary == "s"
    for bad in (s, s.limit(0)):
        with pytest.raises(Exception, match="summary"):
            pages.with_summaries(p, bad).collect()


def test_citations(spark):
    text = "alpha beta gamma delta"
    chunk = spark.createDataFrame([("S1", "c", text, 1, [(1, 0, 10), (2, 11, 22)])], "source_id string, chunk_id string, text string, start_page_number int, page_spans array<struct<page_number:int,start_offset:int,end_offset:int>>")
    quotes = [("S1", " alpha  beta "), ("S2", "alpha"), ("S1", "  "), ("S1", "nope"), ("S1", "alpha beta"), ("S1", "gamma"), ("S1", "beta gamma"), ("S1", "delta"), ("S1", "alpha")]
    raw = spark.createDataFrame([(i, *q) for i, q in enumerate(quotes)], "pos int, source_id string, quote string")
    got = grounding.validated_citations(raw, chunk).orderBy("citation").collect()
    assert [(r.quote, r.page_number) for r in got] == [("alpha beta", 1), ("gamma", 2), ("beta gamma", 1), ("delta", 2)]
    assert all(text[r.start_offset : r.end_offset] == r.quote for r in got)


def test_shown_content(spark):
    f = lambda s: one(spark, grounding.shown_content(F.lit(s)))
    assert f('{"answer":" hi "}') == "hi"
    assert f('x {"answer": "a\\nb", ') == "a\nb"
    assert f(" plain ") == "plain"


def test_long_answers_take_no_stack(spark):
    body = F.repeat(F.lit('ab \\" c'), 40_000)  # 280,000 characters, a loop's turn for most of them
    cut = F.concat(F.lit('x {"answer":"'), body)
    got = spark.range(1).select(F.length(grounding.tolerant_answer(cut)).alias("a"), F.length(grounding.shown_content(F.concat(cut, F.lit('", ')))).alias("b")).first()
    assert (got.a, got.b) == (240_000, 240_000)


ANSWER = '{"answer":"a \\"q\\" \\n \\u00e9 \\\\ end","citations":[]}'


@settings(max_examples=60, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, len(ANSWER)), max_size=6))
def test_extractor_does_not_depend_on_cuts(cuts):
    x, at = AnswerExtractor(), [0, *sorted(cuts), len(ANSWER)]
    assert "".join(x.feed(ANSWER[i:j]) for i, j in zip(at, at[1:])) == 'a "q" \n u00e9 \\ end'


def test_framer(spark):
    rows = [(1, 3, "d"), (1, 0, "a\nb"), (1, 1, "c\n"), (1, 2, None), (2, 0, "x"), (2, 1, "\n\ny\n"), (3, 0, "no end")]
    got = framed(spark.createDataFrame(rows, "s long, n long, piece string"), ["s"], "n").collect()
    assert sorted((r.s, r.line_no, r.line) for r in got) == [(1, 0, "a"), (1, 1, "bc"), (2, 0, "x"), (2, 1, ""), (2, 2, "y")]


def test_fusion(spark):
    rank = lambda ids: spark.createDataFrame([(i, n + 1) for n, i in enumerate(ids)], "id long, rank long")
    got = retrieval.fuse(rank([3, 1]), rank([1, 2])).orderBy("cand_pos").collect()
    assert [r.id for r in got] == [1, 2, 3]
    assert got[0].fused == 0.65 / 61 + 0.35 / 62
    t = spark.createDataFrame([(i, "same party") for i in (1, 2, 3)], "id long, text string")
    best = retrieval.rerank(retrieval.fuse(rank([]), rank([])), t, ["art"]).collect()
    assert best == []


def test_lexical_without_terms(spark):
    t = spark.createDataFrame([(1, "a")], "id long, text string")
    assert retrieval.lexical_top_k(t, " ?! ").count() == 0


def test_store(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "z")], "id long, name string, note string")
    assert [r.name for r in store.multi_get(df, [3, 9, 1, 3]).collect()] == ["c", "a", "c"]
    change = spark.createDataFrame([(2, "B", None)], "id long, name string, note string")
    assert sorted(map(tuple, store.patched(df, change).collect()))[1] == (2, "B", None)
    assert store.deleted(df, df.where("id < 3"), guard=F.col("name") == "a").count() == 2
    with pytest.raises(Exception, match="no parent"):
        store.append_checked(df, spark.createDataFrame([(7, "m")], "id long, m string"), "id").collect()


def test_records(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "id long, s string")
    ids = lambda *w: sorted(r.id for r in records.find_many(df, list(w)).collect())
    assert ids({"field": "s", "value": None}) == [1]
    assert ids({"field": "s", "operator": "in", "value": []}) == []
    assert ids({"field": "id", "value": 1, "connector": "OR"}, {"field": "s", "value": "c", "connector": "OR"}) == [1, 3]
    p = records.page(df, [], "id", 2, 2).collect()
    assert [r.id for r in p] == [3] and p[0].is_done
    assert records.delete_many(df, [{"field": "s", "value": "b"}]).count() == 2


def test_fence(spark):
    log = [("begin", 1), ("begin", 1), ("ready", 2), ("failed", 1), ("begin", 2), ("ready", 2), ("begin", 3)]
    e = spark.createDataFrame([(1, i, k, a) for i, (k, a) in enumerate(log)], "id long, o int, k string, a int")
    assert tuple(lifecycle.fence(e, "id", "o", "k", "a").first()) == (1, "ready", 2, 4)


def test_ingest_and_retrieve(spark):
    schema = f"document_id string, shard_index int, {pages.SHARD_SCHEMA}"
    shards = spark.createDataFrame([("d", 0, "Grain prices rose. More text.", [])], schema)
    out = flows.ingest(shards, spark.createDataFrame([("d", 2)], "document_id string, page_count int"), width=32)
    assert out["documents"].first().summary == "Grain prices rose"
    c = out["chunks"].first()
    assert len(c.embedding) == 32 and c.text == "Grain prices rose. More text."
    texts = out["chunks"].selectExpr("0L as id", "text")
    best = flows.retrieve(texts, out["chunks"].selectExpr("0L as id", "embedding"), "grain prices", providers.hashed_embeddings(["grain prices"], 32)[0]).first()
    assert best.source_id == "S1" and best.hybrid_score > 0.1


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_whitespace(spark):
    t = lambda f, s: one(spark, f(F.lit(s)))
    every = T.SPACES
    assert t(T.tokens, f"{every}a{every}b c\x85d") == ["a", "b", "c\x85d"] and t(T.tokens, every) == []
    assert t(T.trim, f"{every}a b{every}") == "a b" and t(T.trim, "a \x85") == "a \x85"  # no line's end stands before the text's
    assert t(T.normalize_whitespace, f" a{every}b ") == "a b" and t(T.normalize_extracted, " \x00a\x00b \x00") == "ab"


def test_pages_are_cut_into_words_once(spark):
    p = spark.createDataFrame([(1, 2, "c\x00d \u3000e"), (1, 1, " a b"), (1, 3, " \x00 "), (2, 1, None)], "document_id long, page_number int, extracted_text string")
    plan = optimized(chunking.page_pieces(p))
    assert plan.count("translate(") == 1 and "regexp_" not in plan
    got = {r.document_id: r for r in chunking.page_chunks(p, 3, 1).where("chunk_index = 0").collect()}
    assert got[1].text == "a b cd" and [tuple(s) for s in got[1].page_spans] == [(1, 0, 3), (2, 4, 6)] and got[2].text == chunking.NO_TEXT


def test_shards_are_read_once(spark):
    page = lambda n, *at: (n, (([{"startIndex": a, "endIndex": b} for a, b in at],),))
    rows = [("d", 0, "\U0001f600bcdef", [page(7, ("1", "3px")), page(None, (None, "2"), ("4", "9")), page(0, ("5", "2"), ("-3", "1"))]), ("d", 1, " whole ", None), ("d", 2, "  ", []), ("d", 3, None, [page(2)])]
    shards = spark.createDataFrame(rows, f"document_id string, shard_index int, {pages.SHARD_SCHEMA}")
    out = pages.shard_pages(shards)
    assert optimized(out).count("LogicalRDD") == 1
    got = sorted((tuple(r.ord), r.page_number, r.extracted_text) for r in out.collect())
    assert got == [((0, 0), 7, "bc"), ((0, 1), 2, "\U0001f600bef"), ((0, 2), 3, "\U0001f600"), ((1, 0), 1, "whole"), ((3, 0), 2, "")]
    want = spark.createDataFrame([("d", 2), ("e", 1), ("f", 0), ("g", None)], "document_id string, page_count int")
    full = pages.dense(out.select("document_id", "page_number", "extracted_text").where("page_number in (2, 7) and ord.shard_index < 3"), want)
    assert optimized(full).count("LogicalRDD") == 2
    assert sorted(map(tuple, full.collect())) == [("d", n, {2: "\U0001f600bef", 7: "bc"}.get(n, "")) for n in range(1, 8)] + [("e", 1, "")]


def test_many_questions_explode_no_whole_text(spark):
    c = spark.createDataFrame([(1, 10, "Grain grain prices", [1.0, 0.0]), (1, 11, "other words", [0.0, 1.0]), (2, 20, None, [1.0, 0.0])], "document_id long, id long, text string, embedding array<double>")
    q = spark.createDataFrame([(1, 1, "grain prices?", [1.0, 0.0]), (2, 1, "the", [0.0, 1.0]), (3, 2, "grain", [1.0, 0.0])], "question_id long, document_id long, query string, vector array<double>")
    out = retrieval.retrieve_many(q, c)
    assert "Aggregate [document_id, id, dl, term" not in optimized(out).replace("#", " ") and "explode(regexp_extract_all(lower(text" not in optimized(out).replace("coalesce(text", "text")
    assert sorted((r.question_id, r.final_rank, r.id) for r in out.collect()) == [(1, 1, 10), (1, 2, 11), (2, 1, 11), (2, 2, 10), (3, 1, 20)]


def test_windows_of_citations_carry_no_texts(spark):
    """each quote's row took its source's whole text through two windows."""
    chunks = spark.createDataFrame([("d", "S1", 0, "one two one", 1, [(1, 0, 3), (2, 4, 11)])], "document_id string, source_id string, chunk_id int, text string, start_page_number int, page_spans array<struct<page_number:int,start_offset:int,end_offset:int>>")
    raw = spark.createDataFrame([("d", i, "S1", q) for i, q in enumerate(["two", "one", "two", "no"])], "document_id string, pos int, source_id string, quote string")
    out = grounding.validated_citations(raw, chunks, ["document_id"])
    seen, todo = [], [out._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Window":
            seen.append(node.output().mkString(","))
    assert len(seen) == 2 and not any("text#" in s or "page_spans#" in s for s in seen)
    assert sorted((r.citation, r.quote, r.page_number, r.snippet) for r in out.collect()) == [(1, "two", 2, "one two one"), (2, "one", 1, "one two one")]
