"""Queries over stored state: snapshots that are refreshed, stored full-text indexes, stored neighbour tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import ann, fulltext
from skein.operators.fulltext import TextIndex
from skein.sources.graph import Tables
from skein.sources.snapshots import SnapshotStore
from skein.sources.staging import new_folder
from skein.streaming import events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- snapshots ------------------------------------------------------------------------------------------------------


def _refreshed(t: Tables) -> SnapshotStore:
    """Documents by id in two versions: French ones changed in the second, Spanish ones gone, copies under new ids added."""
    docs = t.documents.select("doc_id", "lang", "source", F.md5("text").alias("content"))
    store = SnapshotStore(t.spark, new_folder(t.spark, "documents"), ("doc_id",), buckets=32)
    store.write(docs)
    changed = docs.where("lang = 'fr'").withColumn("content", F.md5("content"))
    added = docs.where("lang = 'de' AND doc_id % 5 = 0").withColumn("doc_id", -F.col("doc_id") - 1)
    store.refresh(changed.unionByName(added), docs.where("lang = 'es'").select("doc_id"))
    return store


@query("""SELECT doc_id, lang, source, CASE WHEN lang = 'fr' THEN md5(md5(text)) ELSE md5(text) END AS content FROM documents WHERE lang <> 'es'
UNION ALL SELECT -doc_id - 1, lang, source, md5(text) FROM documents WHERE lang = 'de' AND doc_id % 5 = 0""")
def refreshed_documents(t: Tables) -> DataFrame:
    """A table of documents after a refresh was applied to its first snapshot."""
    return _refreshed(t).read()


@query("""SELECT CASE lang WHEN 'fr' THEN 'changed' ELSE 'removed' END AS kind, doc_id FROM documents WHERE lang IN ('fr', 'es')
UNION ALL SELECT 'added', -doc_id - 1 FROM documents WHERE lang = 'de' AND doc_id % 5 = 0""")
def snapshot_changes(t: Tables) -> DataFrame:
    """What differs between the two snapshots, read back from their files."""
    return _refreshed(t).changed(1, 2)


# --- full-text index ------------------------------------------------------------------------------------------------


def _indexed(t: Tables) -> DataFrame:
    """Documents, pages, parts, turns and benchmark items as the five tables of an index."""
    turn = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    out = fulltext.documents("File", t.documents, "doc_id", ("source", "text"))
    out = out.unionByName(fulltext.documents("Function", t.pages, "page_id", ("url", "html")))
    out = out.unionByName(fulltext.documents("Class", t.part, "p_partkey", ("p_name", "p_type")))
    out = out.unionByName(fulltext.documents("Method", t.conversations.withColumn("id", turn), "id", ("role", "text")))
    return out.unionByName(fulltext.documents("Interface", t.benchmark, "item_id", ("text",)))


def _search(t: Tables, stems: bool, **options) -> DataFrame:
    index = TextIndex(t.spark, new_folder(t.spark, "index"), buckets=32, stems=stems).build(_indexed(t))
    return index.search(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 5, **options)


_INDEXED = """d AS (SELECT 'File' AS tbl, doc_id::VARCHAR AS doc, [source, text] AS f FROM documents UNION ALL SELECT 'Function', page_id::VARCHAR, [url, html] FROM pages UNION ALL SELECT 'Class', p_partkey::VARCHAR, [p_name, p_type] FROM part
  UNION ALL SELECT 'Method', conv_id || ':' || turn, [role, text] FROM conversations UNION ALL SELECT 'Interface', item_id::VARCHAR, [text] FROM benchmark),
x AS MATERIALIZED (SELECT tbl, doc, list_concat(regexp_extract_all(lower(coalesce(f[1], '')), '[a-z0-9]+'), regexp_extract_all(lower(coalesce(f[2], '')), '[a-z0-9]+')) AS w FROM d),
tf AS MATERIALIZED (SELECT tbl, doc, term, count(*) AS tf FROM (SELECT tbl, doc, unnest(w) AS term FROM x) GROUP BY 1, 2, 3), len AS (SELECT tbl, doc, len(w) AS len FROM x),
st AS (SELECT tbl, count(*) AS n, avg(len) AS mean FROM len GROUP BY 1), df AS (SELECT tbl, term, count(*) AS df FROM tf GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
part AS (SELECT query_id, tbl, doc, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS s FROM q JOIN tf USING (term) JOIN df USING (tbl, term) JOIN len USING (tbl, doc) JOIN st USING (tbl)),
best AS (SELECT query_id, tbl, doc, score, row_number() OVER (PARTITION BY query_id, tbl ORDER BY score DESC, doc)::INT AS rank FROM (SELECT query_id, tbl, doc, round(sum(s), 6) AS score FROM part GROUP BY 1, 2, 3))"""


@query(f"WITH {_INDEXED} SELECT query_id, tbl, doc, score, rank FROM best WHERE rank <= 5")
def indexed_search(t: Tables) -> DataFrame:
    """The five best of each of five indexed tables for every benchmark text, any word matching, words as they are."""
    return _search(t, False)


@query()
def stemmed_search(t: Tables) -> DataFrame:
    """The same by Porter stems."""
    return _search(t, True)


# --- neighbour tables -----------------------------------------------------------------------------------------------


def _vectors(t: Tables) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select(F.col("vec_id").alias("id"), v.alias("vector"), F.xxhash64("embedding").alias("hash"))


def _neighbours(t: Tables, exact: bool = False) -> ann.NeighbourStore:
    return ann.NeighbourStore(t.spark, new_folder(t.spark, "neighbours"), buckets=32).build(_vectors(t), exact=exact)


#: All pairs.
_NEIGHBOURS = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score FROM v a JOIN v b ON a.id <> b.id),
n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst)::INT AS rank FROM s QUALIFY rank <= 16)"""


@query(f"WITH {_NEIGHBOURS} SELECT src, dst, score, rank FROM n")
def neighbour_table(t: Tables) -> DataFrame:
    """The sixteen nearest others of every vector, made, persisted and read back."""
    return _neighbours(t, exact=True).load().select("src", "dst", "score", "rank")


@query(f"WITH {_NEIGHBOURS} SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY rank)::INT AS rank FROM n WHERE src % 10 <> 3 AND dst % 10 <> 3")
def fresh_neighbours(t: Tables) -> DataFrame:
    """The same once every tenth vector has changed: edges at these are stale, the ranks of the others close up."""
    now = _vectors(t).withColumn("hash", F.when(F.col("id") % 10 == 3, F.lit(0)).otherwise(F.col("hash")))
    return _neighbours(t, exact=True).load(now).select("src", "dst", "score", "rank")


@query()
def frontier_search(t: Tables) -> DataFrame:
    """Walks over the neighbour table from every hundredth vector itself: ten hits each."""
    store, rows = _neighbours(t), _vectors(t)
    q = t.embeddings.where("vec_id % 100 = 0")
    seeds = q.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("pos"), F.col("vec_id").alias("id"))
    queries = q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found, told = ann.frontier_search(queries, seeds, lambda sources: store.load(sources=sources), rows.select("id", "vector", F.lit(False).alias("stale")))
    return found.join(told, "query_id").select("query_id", "id", F.round("score", 6).alias("score"), "rank", "visited", "truncated", "reason")


# --- events ---------------------------------------------------------------------------------------------------------


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS changes, count(*) FILTER (event_type = 'error') AS errors, max(ts) AS latest FROM events GROUP BY user_id""")
def event_store_projection(t: Tables) -> DataFrame:
    """The projection of a store that events were appended to in four epochs, one of them twice."""
    rows = t.events.select("user_id", "event_id", "ts", "event_type")
    return events.in_epochs(rows, 4).projection().select("user_id", "status", "changes", "errors", "latest")
