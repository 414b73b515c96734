"""Queries of composite analyzers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import analysis, hierarchy, joins, packing, rank, search, textops, traversal
from skein.plans.graph_queries import FLOW_STEPS, _top_sources, whole_graph
from skein.plans.search_queries import VEC
from skein.plans.state_queries import MRO_SQL, class_methods, class_parents
from skein.sources import graph as G
from skein.sources.graph import FOLLOWS_SQL, Tables

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


def _r(c, n: int = 6):
    return F.round(c, n)


@query("""WITH h AS (SELECT o_orderkey AS hunk, o_orderkey AS s, o_orderkey + o_custkey % 7 AS e FROM orders WHERE o_totalprice > 400000), y AS (SELECT c_custkey AS symbol, c_custkey * 10 AS s, c_custkey * 10 + 9 AS e FROM customer)
SELECT symbol, count(*) AS hunks, CASE WHEN count(*) >= 3 THEN 'high' WHEN count(*) = 2 THEN 'medium' ELSE 'low' END AS risk FROM h JOIN y ON h.s <= y.e AND h.e >= y.s GROUP BY symbol""")
def detect_changes(t: Tables) -> DataFrame:
    """Symbols whose line spans changed hunks overlap, by how many."""
    k = F.col("o_orderkey")
    h = t.orders.where("o_totalprice > 400000").select(k.alias("start"), (k + F.col("o_custkey") % 7).alias("end"))
    c = F.col("c_custkey")
    y = t.customer.select(c.alias("symbol"), (c * 10).alias("start2"), (c * 10 + 9).alias("end2"))
    n = joins.interval_overlap(h, y, [], 10).groupBy("symbol").agg(F.count("*").alias("hunks"))
    return n.withColumn("risk", F.when(F.col("hunks") >= 3, "high").when(F.col("hunks") == 2, "medium").otherwise("low"))


@query("""WITH i AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40), t AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)
SELECT p_partkey AS requirement, CASE WHEN i.l_partkey IS NOT NULL AND t.l_partkey IS NOT NULL THEN 'implemented' WHEN i.l_partkey IS NOT NULL THEN 'untested' WHEN t.l_partkey IS NOT NULL THEN 'test-only' ELSE 'missing' END AS status
FROM part LEFT JOIN i ON i.l_partkey = p_partkey LEFT JOIN t ON t.l_partkey = p_partkey""")
def requirements_trace(t: Tables) -> DataFrame:
    """Whether each requirement has an implementation and a test."""
    l = t.lineitem.where("l_quantity > 40")
    n = l.groupBy("l_partkey").agg(F.max(F.col("l_returnflag") == "A").alias("i"), F.max(F.col("l_returnflag") == "R").alias("x"))
    j = t.part.select(F.col("p_partkey").alias("requirement")).join(n, F.col("requirement") == F.col("l_partkey"), "left").na.fill(False, ["i", "x"])
    return j.select("requirement", F.when(F.col("i") & F.col("x"), "implemented").when(F.col("i"), "untested").when(F.col("x"), "test-only").otherwise("missing").alias("status"))


@query("""SELECT o_orderkey AS plan, count(*) AS open_items FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_linestatus = 'O' GROUP BY 1""")
def cross_doc_drift(t: Tables) -> DataFrame:
    """Plans marked finished whose records are still open."""
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("plan"))
    open_ = t.lineitem.where("l_linestatus = 'O'").select("l_orderkey")
    return open_.join(done, F.col("l_orderkey") == F.col("plan")).groupBy("plan").agg(F.count("*").alias("open_items"))


RESIDUE = [("query", "[?]"), ("fragment", "#"), ("numbered", "/[0-9]+([?#]|$)"), ("mobile", "://m[.]")]


@query(" UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS urls, min(page_id) AS first_page FROM pages WHERE regexp_matches(url, '{p}') HAVING count(*) > 0" for n, p in RESIDUE))
def build_residue(t: Tables) -> DataFrame:
    """Residue patterns over all URLs."""
    hits = F.array_compact(F.array(*[F.when(F.col("url").rlike(p), F.lit(n)) for n, p in RESIDUE]))
    return t.pages.select("page_id", F.explode(hits).alias("rule")).groupBy("rule").agg(F.count("*").alias("urls"), F.min("page_id").alias("first_page"))


@query("""SELECT c_custkey AS target, o_orderkey AS evidence, rank FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM customer JOIN orders ON o_custkey = c_custkey) WHERE rank <= 3""")
def evidence_pack(t: Tables) -> DataFrame:
    """The three heaviest pieces of evidence per target."""
    w = W.partitionBy("target").orderBy(F.desc("o_totalprice"), "evidence")
    j = t.orders.select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("evidence"), "o_totalprice").join(t.customer, F.col("target") == F.col("c_custkey"), "left_semi")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("target", "evidence", "rank")


@query(f"""WITH {FOLLOWS_SQL}, p AS (SELECT 'Part:' || p_partkey AS id, p_brand FROM part) SELECT a.p_brand AS module, sum(weight) FILTER (a.p_brand = b.p_brand)::BIGINT AS intra, sum(weight) FILTER (a.p_brand <> b.p_brand)::BIGINT AS inter, count(DISTINCT b.p_brand) AS peers
FROM follows JOIN p a ON a.id = src JOIN p b ON b.id = dst GROUP BY 1""")
def module_call_edges(t: Tables) -> DataFrame:
    """Calls inside a module and to others, and how many others."""
    p = t.part.select(G.tag("Part", "p_partkey").alias("id"), "p_brand")
    j = G.follows(t).join(p.withColumnsRenamed({"id": "src", "p_brand": "a"}), "src").join(p.withColumnsRenamed({"id": "dst", "p_brand": "b"}), "dst")
    same = F.col("a") == F.col("b")
    return j.groupBy(F.col("a").alias("module")).agg(F.sum(F.when(same, F.col("weight"))).alias("intra"), F.sum(F.when(~same, F.col("weight"))).alias("inter"), F.count_distinct("b").alias("peers"))


@query("""WITH q AS (SELECT p_name AS query, min(p_brand) AS hint, min(p_type) AS kind FROM part GROUP BY 1), c AS (SELECT query, p_partkey AS key, round(0.5 + 0.4 * (p_brand = hint)::INT + 0.2 * (p_type = kind)::INT, 6)::DOUBLE AS score FROM q JOIN part ON p_name = query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS r, lead(score) OVER (PARTITION BY query ORDER BY score DESC, key) AS nxt FROM c)
SELECT query, key, score, CASE WHEN score >= 0.95 AND coalesce(score - nxt, 1) > 0.09 THEN 'ok' ELSE 'ambiguous' END AS status FROM r WHERE r = 1""")
def symbol_resolution(t: Tables) -> DataFrame:
    """Names resolved by hints of file and kind, accepted only with a clear lead."""
    q = t.part.groupBy(F.col("p_name").alias("query")).agg(F.min("p_brand").alias("hint"), F.min("p_type").alias("kind"))
    score = _r(F.lit(0.5) + 0.4 * (F.col("p_brand") == F.col("hint")).cast("int") + 0.2 * (F.col("p_type") == F.col("kind")).cast("int"))
    c = t.part.join(q, F.col("p_name") == F.col("query")).select("query", F.col("p_partkey").alias("key"), score.alias("score"))
    return analysis.resolve(c, "query", "score", "key")


@query(FLOW_STEPS + """, own AS (SELECT DISTINCT path FROM kept), cut AS (SELECT DISTINCT list_slice(path, a, b) AS path FROM (SELECT path, unnest(generate_series(1, len(path))) AS a FROM own) x, generate_series(1, 6) g(b) WHERE b >= a AND b <= len(path) AND b - a + 1 < len(path))
SELECT array_to_string(path, '>') AS path FROM own WHERE path NOT IN (SELECT path FROM cut)""")
def maximal_flows(t: Tables) -> DataFrame:
    """Flows that are no part of a longer one."""
    s = G.strong(t)
    entries = s.select(F.col("src").alias("id")).distinct().join(s.select(F.col("dst").alias("id")), "id", "left_anti")
    return analysis.maximal_paths(traversal.flows(s, entries, 4, 6, 3, 12)).select(F.array_join("path", ">").alias("path"))


whole_graph(maximal_flows, QUERIES, SQL)


@query(f"WITH {MRO_SQL} SELECT u.id AS child, u.method AS method, arg_min(u.owner, u.pos) AS parent FROM spots u JOIN spots o ON o.id = u.id AND o.method = u.method AND o.pos = 1 WHERE u.pos > 1 GROUP BY 1, 2")
def method_overrides(t: Tables) -> DataFrame:
    """Which inherited method each own method overrides."""
    return analysis.overrides(hierarchy.linearise(class_parents(t)), class_methods(t))


@query("""WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE lang <> 'fr'), b AS (SELECT doc_id, md5(CASE WHEN lang = 'de' THEN lower(text) ELSE text END) AS h FROM documents WHERE lang <> 'es')
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.h IS NULL THEN 'add' WHEN b.h IS NULL THEN 'delete' WHEN a.h = b.h THEN 'keep' ELSE 'replace' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def incremental_refresh(t: Tables) -> DataFrame:
    """What a refresh between two snapshots has to do, by content hashes."""
    d = t.documents
    old = d.where("lang <> 'fr'").select("doc_id", F.md5("text").alias("h"))
    new = d.where("lang <> 'es'").select("doc_id", F.md5(F.when(F.col("lang") == "de", F.lower("text")).otherwise(F.col("text"))).alias("h"))
    return analysis.refresh_plan(old, new, "doc_id", "h")


@query("""SELECT 'text' AS strategy, count(*) AS groups, sum(n)::BIGINT AS members FROM (SELECT count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1) UNION ALL SELECT 'folded', count(*), sum(n)::BIGINT FROM (SELECT count(*) AS n FROM documents GROUP BY md5(lower(trim(text))) HAVING count(*) > 1)
UNION ALL SELECT 'first-line', count(*), sum(n)::BIGINT FROM (SELECT count(*) AS n FROM documents GROUP BY split_part(text, chr(10), 1) HAVING count(*) > 1) UNION ALL SELECT 'source-size', count(*), sum(n)::BIGINT FROM (SELECT count(*) AS n FROM documents GROUP BY source, n_chars HAVING count(*) > 1)
UNION ALL SELECT 'lang-size', count(*), sum(n)::BIGINT FROM (SELECT count(*) AS n FROM documents GROUP BY lang, n_chars HAVING count(*) > 1)""")
def dedupe_strategies(t: Tables) -> DataFrame:
    """Groups that each of five fingerprints finds."""
    d = t.documents
    keys = {"text": [F.md5("text")], "folded": [F.md5(F.lower(F.trim("text")))], "first-line": [F.md5(F.substring_index("text", "\n", 1))], "source-size": [F.col("source"), F.col("n_chars")], "lang-size": [F.col("lang"), F.col("n_chars")]}
    prints = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), F.concat_ws("\x1f", *[c.cast("string") for c in v]).alias("print")) for k, v in keys.items()]))
    g = d.select(prints.alias("p")).groupBy("p.strategy", "p.print").agg(F.count("*").alias("n")).where("n > 1")
    return g.groupBy("strategy").agg(F.count("*").alias("groups"), F.sum("n").alias("members"))


@query("""WITH c AS (SELECT 'error-share' AS "check", count(*) FILTER (event_type = 'error') / count(*) AS value, 0.25::DOUBLE AS allowed FROM events UNION ALL SELECT 'max-value', max(value), 40.0::DOUBLE FROM events UNION ALL SELECT 'users', count(DISTINCT user_id)::DOUBLE, 100000.0::DOUBLE FROM events)
SELECT "check", round(value, 6) AS value, allowed, CASE WHEN round(value, 6) <= allowed THEN 'pass' ELSE 'fail' END AS status FROM c""")
def threshold_checks(t: Tables) -> DataFrame:
    """Aggregates against thresholds."""
    e = [("error-share", F.count_if(F.col("event_type") == "error") / F.count("*"), 0.25), ("max-value", F.max("value"), 40.0), ("users", F.count_distinct("user_id"), 100000.0)]
    return analysis.check_rows(t.events, e)


@query("""SELECT 'line-order' AS rule, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'line-part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'order-customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'label-document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def ontology_validation(t: Tables) -> DataFrame:
    """References to things that don't exist."""
    parts = [analysis.dangling(t.lineitem, "l_orderkey", t.orders, "o_orderkey", "line-order"), analysis.dangling(t.lineitem, "l_partkey", t.part, "p_partkey", "line-part"), analysis.dangling(t.orders, "o_custkey", t.customer, "c_custkey", "order-customer"), analysis.dangling(t.labels, "doc_id", t.documents, "doc_id", "label-document")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH s AS (SELECT DISTINCT term AS symbol FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) WHERE length(term) >= 9), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS symbol, CASE WHEN contains(line, '|') THEN 0.3 ELSE 0.4 END::DOUBLE AS confidence FROM l) SELECT doc_id, symbol, max(confidence) AS confidence FROM m WHERE symbol IN (SELECT symbol FROM s) GROUP BY 1, 2""")
def symbol_mentions(t: Tables) -> DataFrame:
    """Known names in texts: weaker inside tables, the best per document and name."""
    known = t.benchmark.select(F.explode(search.tokens("text")).alias("symbol")).where(F.length("symbol") >= 9).distinct()
    l = textops.lines(t.documents, "doc_id", "text")
    m = l.select("doc_id", F.explode(F.array_distinct(search.tokens("line"))).alias("symbol"), F.when(F.col("line").contains("|"), 0.3).otherwise(0.4).alias("confidence"))
    return m.join(known, "symbol", "left_semi").groupBy("doc_id", "symbol").agg(F.max("confidence").alias("confidence"))


@query("""SELECT source, count(*) AS docs, count(DISTINCT lang) AS langs, round(avg(n_chars), 6) AS mean_chars, count(quality) AS labelled, round(coalesce(avg(quality), 0), 6) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def knowledge_report(t: Tables) -> DataFrame:
    """What is known per source."""
    j = t.documents.join(t.labels, "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("docs"), F.count_distinct("lang").alias("langs"), _r(F.avg("n_chars")).alias("mean_chars"), F.count("quality").alias("labelled"), _r(F.coalesce(F.avg("quality"), F.lit(0.0))).alias("good"))


@query("""WITH local AS (SELECT s_suppkey AS s, s_nationkey AS n FROM supplier WHERE s_acctbal < 0), bridge AS (SELECT DISTINCT s, c_custkey AS c FROM local JOIN customer ON c_nationkey = n), remote AS (SELECT s, c, o_orderkey FROM bridge JOIN orders ON o_custkey = c)
SELECT l.s AS origin, count(DISTINCT b.c) AS neighbours, count(DISTINCT o_orderkey) AS remote FROM local l LEFT JOIN bridge b ON b.s = l.s LEFT JOIN remote r ON r.s = b.s AND r.c = b.c GROUP BY 1""")
def cross_impact(t: Tables) -> DataFrame:
    """From local origins over contracts to what depends on the neighbours."""
    local = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("origin"), F.col("s_nationkey").alias("n"))
    orders = t.orders.groupBy(F.col("o_custkey").alias("c")).agg(F.count("*").alias("m"))
    bridge = t.customer.select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n")).join(orders, "c", "left").groupBy("n").agg(F.count("*").alias("neighbours"), F.coalesce(F.sum("m"), F.lit(0)).alias("remote"))
    return local.join(bridge, "n", "left").na.fill(0, ["neighbours", "remote"]).select("origin", "neighbours", "remote")


@query(f"""WITH {VEC} SELECT query_id, id AS neighbour, (rank - 1)::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM vr WHERE id <> query_id * 100) WHERE k <= 16""".replace("(rank - 1)::INT AS rank", "k::INT AS rank"))
def ann_neighbours(t: Tables) -> DataFrame:
    """Sixteen nearest others of every hundredth vector, as edges."""
    q = t.embeddings.where("vec_id % 100 = 0").select(F.expr("vec_id DIV 100").alias("query_id"), "embedding")
    near = search.vector_search(t.embeddings, q, 17, 0.85).where(F.col("id") != F.col("query_id") * 100)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= 16").select("query_id", F.col("id").alias("neighbour"), "rank", "score")


@query()
def repository_map(t: Tables) -> DataFrame:
    """Parts ranked from three focus parts and packed under a budget by their size."""
    f = G.follows(t)
    score = rank.pagerank(f, iterations=6, tolerance=0, seeds=_top_sources(f, 3), dangling=False, stop_when_no_seeds=True)
    items = score.orderBy(F.desc("score"), "id").limit(200)
    own = t.part.select(G.tag("Part", "p_partkey").alias("id"), F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("cost"))
    return packing.pack_budget(items.join(own, "id").select(F.lit("map").alias("grp"), F.col("key").alias("id"), "cost", "score"), 1000)


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/+$', '') AS path FROM pages) SELECT page_id, path FROM p WHERE NOT (regexp_matches(path, '^[^/]*[.]example[.]com/.*$') OR regexp_matches(path, '^[^/]*/(en|de)/[^/]*$'))""")
def scope_guard(t: Tables) -> DataFrame:
    """Changed paths outside the allowed globs."""
    p = t.pages.select("page_id", F.regexp_replace(F.regexp_extract("url", r"^https?://([^?#]*)", 1), "/+$", "").alias("path"))
    inside = F.col("path").rlike(joins.glob_to_regex("*.example.com/**")) | F.col("path").rlike(joins.glob_to_regex("*/{en,de}/*"))
    return p.where(~inside)
