"""Every registered query that has SQL gives the same rows as DuckDB on the small tables."""

import pytest

from pagewright.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, duck, same):
    same(QUERIES[name](spark, SMALL).toPandas(), duck.execute(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_corpus_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['pagewright.llm'] = None; import __spark_entry__ as e; assert 'hybrid_retrieve' in e.queries() and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0


def rows(frame):
    return sorted(map(str, (tuple(r) for r in frame)))


def test_tolerant_answers_of_odd_texts(spark, tmp_path):
    """what trim() of SQL leaves (line ends, tabs) stays, and an answer that breaks off is cut by its characters."""
    import duckdb

    texts = ["a b.\nc.", "one\n\n", "\tq\t", "  z　xy", "a\"b\\", "\x01\x02\b\f", "\n", " ", "", None, "x"]
    said = [(i * 8 + j, 0, "user", t) for i, t in enumerate(texts) for j in range(8)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert rows(QUERIES["answer_parse_tolerant"](spark, str(tmp_path)).select("conv_id", "turn", "answer").collect()) == rows(con.execute(SQL["answer_parse_tolerant"]).fetchall())


def test_spans_of_odd_texts(spark, tmp_path):
    """a document without words has no spans, and NUL is a character of a word as in SQL."""
    import duckdb

    texts = ["", " \n\t", "\x00", "a\x00b c\n\x00 d", None, "x\n\n y", "\n".join(["w"] * 451)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["chunk_page_spans"](spark, str(tmp_path)).select("document_id", "chunk_index", "page_number", "start_offset", "end_offset")
    assert rows(got.collect()) == rows(con.execute(SQL["chunk_page_spans"]).fetchall())
