"""Lexical and vector top-k, rank fusion, and candidates.

The two searches are given by their outcome only (relevance order, similarity order); here they are exact: BM25 over
[a-z0-9]+ terms with k1 = 1.2 and b = 0.75, and cosine in double precision; ties by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FINAL_LIMIT, FUSION_K, KEYWORD_BONUS, LEXICAL_LIMIT, LEXICAL_WEIGHT, VECTOR_LIMIT, VECTOR_WEIGHT
from ..functions.text import keyword_terms, lexical_query

K1, B = 1.2, 0.75


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def lexical_top_k(docs: DataFrame, query: str, k: int = LEXICAL_LIMIT, id_: str = "id", text: str = "text", where: Column | None = None) -> DataFrame:
    """(id, score, rank) by BM25. A query without terms finds nothing. Texts are read once: a document's length and its counts
    of the query's terms are dealt by id, some bytes a document, and both the corpus statistics and the scores read that
    exchange. Of a text only the query's own terms are put into an array."""
    import re

    wanted = list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))
    base = docs if where is None else docs.where(where)
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+", " ")))
    words = base.select(F.col(id_).alias("id"), line.alias("s"))
    met = F.regexp_extract_all("s", F.lit(" (" + "|".join(wanted or ["-"]) + ")(?= |$)"), F.lit(1))
    words = words.select("id", (F.length("s") - F.length(F.translate("s", " ", "")) - (F.length("s") == 1).cast("int")).alias("dl"), met.alias("w"))

    def occurrences(q: str) -> Column:
        return F.size(F.filter("w", lambda t: t == q))

    tf = [occurrences(q).alias(f"tf{i}") for i, q in enumerate(wanted)]
    counted = words.select("id", "dl", *tf).repartition("id")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))
    joined = counted.join(F.broadcast(stats))  # one row
    score = bm25([F.col(f"tf{i}") for i in range(len(wanted))], [F.col(f"df{i}") for i in range(len(wanted))], F.col("dl"), F.col("n"), F.col("avgdl"))
    hit = F.lit(False)
    for i in range(len(wanted)):
        hit = hit | (F.col(f"tf{i}") > 0)
    top = joined.where(hit).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return ranked(top, F.desc("score"))


def bm25(tf: list[Column], df: list[Column], dl: Column, n: Column, avgdl: Column) -> Column:
    """The score of a document: tf and df of each of the query's terms, in their order."""
    score = F.lit(0.0)
    for f, d in zip(tf, df):
        idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * dl / avgdl))
    return score


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top_k(vectors: DataFrame, query: list[float], k: int = VECTOR_LIMIT, id_: str = "id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """(id, score, rank) by cosine to a query vector. The query is a literal; the plan is a scan with a filter, a projection
    and a distributed top-k."""
    base = vectors if where is None else vectors.where(where)
    v, q = F.col(vector), F.array(*(F.lit(float(x)) for x in query))
    norm = sum(float(x) * float(x) for x in query) ** 0.5
    own = F.sqrt(dot(v, v))
    score = F.when((own > 0) & F.lit(norm > 0), dot(q, v) / (own * F.lit(norm))).otherwise(0.0)
    top = base.where((F.size(v) == len(query))).select(F.col(id_).alias("id"), F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return ranked(top, F.desc("score"))


def ranked(top: DataFrame, *order: Column) -> DataFrame:
    """rank from 1 of rows that are k at most."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order, F.col("id"))).cast("long"))


def fuse(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """(id, rl, rv, fused, cand_pos) of two ranked lists of k rows at most. Candidates stand in vector order, then those that
    are lexical only."""
    both = vector.select("id", F.col("rank").alias("rv")).join(lexical.select("id", F.col("rank").alias("rl")), "id", "full_outer")
    score = F.coalesce(F.lit(VECTOR_WEIGHT) / (FUSION_K + F.col("rv")), F.lit(0.0)) + F.coalesce(F.lit(LEXICAL_WEIGHT) / (FUSION_K + F.col("rl")), F.lit(0.0))
    pos = F.row_number().over(Window.orderBy(F.col("rv").asc_nulls_last(), F.col("rl").asc_nulls_last())).cast("long")
    return both.select("id", "rl", "rv", score.alias("fused")).withColumn("cand_pos", pos)


def keyword_share(text: Column, wanted: list[str]) -> Column:
    """Share of terms that a text contains, as substrings; no terms: 0."""
    if not wanted:
        return F.lit(0.0)
    hits = sum((F.contains(F.lower(text), F.lit(t)).cast("int") for t in wanted), F.lit(0))
    return hits / F.lit(float(len(wanted)))


def rerank(candidates: DataFrame, texts: DataFrame, wanted: list[str], k: int = FINAL_LIMIT) -> DataFrame:
    """The k best of fused candidates (24 at most) with their texts (id, text), source labels S1.. by rank. The candidates'
    ids reach the scan of the texts as a filter."""
    rows = candidates.collect()
    candidates = candidates.sparkSession.createDataFrame(rows, candidates.schema)
    joined = texts.where(F.col("id").isin([r.id for r in rows])).join(F.broadcast(candidates), "id")
    score = F.col("fused") + keyword_share(F.col("text"), wanted) * KEYWORD_BONUS
    top = joined.withColumn("hybrid_score", score).orderBy(F.desc("hybrid_score"), "cand_pos").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("hybrid_score"), "cand_pos")).cast("long")
    return top.withColumn("final_rank", rank).withColumn("source_id", F.concat(F.lit("S"), F.col("final_rank").cast("string")))


def retrieve_many(questions: DataFrame, chunks: DataFrame, k: int = FINAL_LIMIT) -> DataFrame:
    """(question_id, source_id, final_rank, hybrid_score, id) for many questions (question_id, document_id, query, vector), each
    about the chunks (document_id, id, text, embedding) of its document: what retrieve gives for one.

    A chunk's text goes once to the terms that its document is asked for, and only those stay of it, with its length; from there
    on rows are numbers by question and chunk. Texts are read again for the candidates only, 24 of a question. What follows the
    join is dealt anew, so that Spark can split a document with very many chunks.
    """
    asked = questions.select("question_id", "document_id", F.explode(F.array_distinct(terms(lexical_query(F.col("query"))))).alias("term"))
    wanted = questions.select("document_id").distinct().join(asked.groupBy("document_id").agg(F.collect_set("term").alias("wanted")), "document_id", "left")
    words = chunks.select("document_id", "id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(wanted, "document_id").withColumn("w", terms(F.col("text")))
    met = F.array_intersect("w", F.coalesce("wanted", F.array().cast("array<string>")))
    held = words.select("document_id", "id", F.size("w").alias("dl"), F.transform(met, lambda t: F.struct(t.alias("term"), (F.size("w") - F.size(F.array_remove("w", t))).alias("tf"))).alias("met")).repartition("document_id")
    whole, same = Window.partitionBy("document_id"), Window.partitionBy("document_id", "term")
    tf = held.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("avgdl", F.avg("dl").over(whole)).select("document_id", "id", "dl", "n", "avgdl", F.inline("met"))
    hits = asked.join(tf.withColumn("df", F.count(F.lit(1)).over(same)), ["document_id", "term"])
    part = bm25([F.col("tf")], [F.col("df")], F.col("dl"), F.col("n"), F.col("avgdl"))
    lexical = hits.groupBy("question_id", "id").agg(F.round(F.sum(part), 6).alias("score"))

    v, q = F.col("embedding"), F.col("vector")
    size = F.sqrt(dot(v, v)) * F.sqrt(dot(q, q))
    cosine = F.when(size > 0, dot(q, v) / size).otherwise(0.0)
    pairs = questions.select("question_id", "document_id", "vector").join(chunks.select("document_id", "id", "embedding"), "document_id")
    vector = pairs.where(F.size(v) == F.size(q)).select("question_id", "id", F.round(cosine, 9).alias("score"))

    def best(scores: DataFrame, n: int, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "id"))
        return scores.withColumn(name, place.cast("long")).where(F.col(name) <= n).select("question_id", "id", name)

    both = best(vector, VECTOR_LIMIT, "rv").join(best(lexical, LEXICAL_LIMIT, "rl"), ["question_id", "id"], "full_outer")
    score = F.coalesce(F.lit(VECTOR_WEIGHT) / (FUSION_K + F.col("rv")), F.lit(0.0)) + F.coalesce(F.lit(LEXICAL_WEIGHT) / (FUSION_K + F.col("rl")), F.lit(0.0))
    pos = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("rv").asc_nulls_last(), F.col("rl").asc_nulls_last()))
    fused = both.select("question_id", "id", score.alias("fused"), pos.alias("cand_pos"))
    wanted = questions.select("question_id", "document_id", keyword_terms(F.col("query")).alias("wanted"))
    text = fused.join(wanted, "question_id").join(chunks.select("document_id", "id", F.lower("text").alias("text")), ["document_id", "id"])
    share = F.when(F.size("wanted") > 0, F.size(F.filter("wanted", lambda t: F.contains(F.col("text"), t))) / F.size("wanted").cast("double")).otherwise(0.0)
    ranked_ = text.withColumn("hybrid_score", F.col("fused") + share * KEYWORD_BONUS)
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("hybrid_score"), "cand_pos")).cast("long")
    top = ranked_.withColumn("final_rank", rank).where(F.col("final_rank") <= k)
    return top.select("question_id", F.concat(F.lit("S"), F.col("final_rank").cast("string")).alias("source_id"), "final_rank", "hybrid_score", "id")
