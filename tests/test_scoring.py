"""BM25 by shares: against SQL with small blocks, repeated ids, and no rows for pairs of queries and postings."""

import duckdb
import pytest

from skein.operators import fulltext, scoring, search
from skein.plans import search_queries
from tests.oracle import differences
from tests.test_skew import largest_rows


@pytest.mark.parametrize("name", ["bm25_search", "process_grouped_search"])
def test_equal_to_sql_in_small_shares(spark, tmp_path, monkeypatch, name):
    for key, value in (("BLOCK", 7), ("ROWS", 60), ("FEW", 20), ("SCORES", 40)):
        monkeypatch.setattr(scoring, key, value)
    texts = ["red Fox", "fox fox jumps", "", None, "the red the fox", "lazy dog jumps", "dog", "red red dog", "the end"] * 5
    docs = [(i if i % 11 else 3, t, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, ("fox the", "red dog dog", "absent", "the end", "")[i % 5]) for i in range(20)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    if name == "process_grouped_search":  # its SQL lists a hit once for each row of an id
        con.sql("CREATE OR REPLACE VIEW documents AS SELECT row_number() OVER () AS doc_id, text, source, n_chars FROM read_parquet('" + f"{tmp_path}/documents.parquet/*.parquet')")
        con.sql(f"COPY (SELECT * FROM documents) TO '{tmp_path}/d.parquet'")
        spark.read.parquet(f"file://{tmp_path}/d.parquet").coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/documents2.parquet")
        (tmp_path / "documents.parquet").rename(tmp_path / "old")
        (tmp_path / "documents2.parquet").rename(tmp_path / "documents.parquet")
        con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert differences(spark, con, str(tmp_path), search_queries.QUERIES[name], search_queries.SQL[name]) == ""


def test_queries_and_postings_form_no_pairs(spark):
    docs = spark.createDataFrame([(i, "the common words " + "x" * (i % 5)) for i in range(400)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, "the common words") for i in range(300)], "query_id long, query string")
    df = search.bm25(docs, queries, 2)
    assert df.count() == 600
    assert largest_rows(spark, df) <= 3 * 400 + 3 * 300 * 12


def test_postings_are_made_without_a_shuffle(spark):
    docs = spark.createDataFrame([("File", f"d{i}", ["a b", "b c b"]) for i in range(3)], "tbl string, doc string, fields array<string>")
    df = fulltext.postings(docs, stems=False)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.term, tuple(r.tfs), r.len) for r in df.collect()} == {("", (1, 1), 5), ("a", (1, 0), 5), ("b", (1, 2), 5), ("c", (0, 1), 5)}
