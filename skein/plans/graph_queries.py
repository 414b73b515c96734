"""Queries of graph operators over the relational fixtures, with DuckDB SQL for each that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import components, rank, traversal
from skein.sources import graph as G
from skein.sources.graph import EDGES_SQL, FOLLOWS_SQL, NODES_SQL, STRONG_SQL, Tables
from skein.sources.staging import stage

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


def whole_graph(f, queries: dict, sql: dict[str, str], slow: bool = False) -> None:
    """Registers ``f`` once more as ``<name>_whole``: on all part-to-part edges, not only those seen twice.

    Its SQL is the one of ``f`` without the filter; ``slow`` gives none, as it would list all pairs of nodes.
    """
    name = f"{f.__name__}_whole"
    queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir, least_weight=1))
    queries[name].__doc__ = f"{f.__doc__} Here with all edges, also those seen once."
    if not slow:
        sql[name] = sql[f.__name__].replace(" WHERE weight >= 2", "")


def _keys(edges: DataFrame, *more: F.Column) -> DataFrame:
    """Part-to-part edges by the parts' keys, which take less room than their ids."""
    return edges.select(*(F.substring_index(c, ":", -1).cast("long").alias(c) for c in ("src", "dst")), *more)


def _r(c, n: int = 6):
    return F.round(c, n)


# --- scans and one-hop expansions -----------------------------------------------------------------------------------


@query(f"WITH {EDGES_SQL} SELECT label, count(*) AS n FROM nodes GROUP BY label")
def node_label_counts(t: Tables) -> DataFrame:
    """Nodes per label."""
    return G.nodes(t).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL} SELECT type, count(*) AS n, sum(weight)::BIGINT AS weight FROM edges GROUP BY type")
def edge_type_counts(t: Tables) -> DataFrame:
    """Edges and their weight per type."""
    return G.edges(t).groupBy("type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query(f"""WITH {EDGES_SQL} SELECT a.name AS src_name, b.name AS dst_name, e.type AS type, e.weight AS weight
FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.type IN ('USES', 'CONTAINS') AND b.label <> 'Customer'""")
def edge_expand(t: Tables) -> DataFrame:
    """One-hop expansion: edges with the names of both ends."""
    e = G.edges(t).where(F.col("type").isin("USES", "CONTAINS"))
    a = G.nodes(t).select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    b = G.nodes(t).where("label <> 'Customer'").select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    return e.join(a, "src").join(b, "dst").select("src_name", "dst_name", "type", "weight")


@query(f"""WITH {EDGES_SQL} SELECT n.id AS id, count(e.dst) AS out_degree FROM nodes n LEFT JOIN edges e ON e.src = n.id GROUP BY n.id""")
def optional_match_degree(t: Tables) -> DataFrame:
    """Optional match: out-degree of every node, 0 where it has no edge."""
    deg = G.edges(t).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    return G.nodes(t).select("id").join(deg, "id", "left").na.fill(0, ["out_degree"])


@query(f"""WITH {EDGES_SQL}, both_ways AS (SELECT src AS id, dst AS other FROM edges UNION SELECT dst, src FROM edges)
SELECT id, count(*) AS neighbours FROM both_ways GROUP BY id""")
def undirected_neighbours(t: Tables) -> DataFrame:
    """Distinct neighbours in either direction."""
    return traversal.undirected(G.edges(t)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("neighbours"))


@query("""SELECT a.s_suppkey AS supplier, b.s_suppkey AS sibling FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey""")
def siblings(t: Tables) -> DataFrame:
    """Two hops through a shared group: suppliers of one nation."""
    s = t.supplier.select("s_suppkey", "s_nationkey")
    return s.select(F.col("s_suppkey").alias("supplier"), "s_nationkey").join(s.select(F.col("s_suppkey").alias("sibling"), "s_nationkey"), "s_nationkey").where("supplier <> sibling").select("supplier", "sibling")


@query(f"""WITH {STRONG_SQL} SELECT e1.src AS a, e1.dst AS b, e2.dst AS c, e4.dst AS d FROM strong e1 JOIN follows e2 ON e2.src = e1.src AND e2.dst <> e1.dst
JOIN strong e4 ON e4.src = e1.dst JOIN follows e3 ON e3.src = e2.dst AND e3.dst = e4.dst WHERE e4.dst <> e1.src""")
def diamond_pattern(t: Tables) -> DataFrame:
    """Four edges a-b, a-c, b-d, c-d, the side over b seen at least twice."""
    f = G.follows(t)
    found = traversal.diamonds(_keys(f, (F.col("weight") >= t.least_weight).alias("strong")))
    return found.select(*(G.tag("Part", k).alias(k) for k in ("a", "b", "c", "d")))



@query(f"""WITH {STRONG_SQL}, ids AS (SELECT src AS id FROM strong GROUP BY src HAVING count(*) >= 2)
SELECT src, dst, weight FROM follows WHERE src IN (SELECT id FROM ids)""")
def id_list_semi_join(t: Tables) -> DataFrame:
    """Edges whose source is in a list of ids, as a semi join."""
    ids = G.strong(t).groupBy("src").agg(F.count("*").alias("n")).where("n >= 2").select("src")
    return G.follows(t).join(ids, "src", "left_semi").select("src", "dst", "weight")


@query("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""")
def parts_never_ordered(t: Tables) -> DataFrame:
    """Anti join: nodes without an incoming edge."""
    return t.part.select("p_partkey").join(t.lineitem, F.col("p_partkey") == F.col("l_partkey"), "left_anti")


HALVES = f"""WITH {FOLLOWS_SQL.replace('follows AS', 'unused AS')}, cut AS (SELECT median(epoch_us(o_orderdate)) AS m FROM orders),
lines AS (SELECT l_orderkey, l_partkey, l_linenumber, epoch_us(o_orderdate) <= m AS early FROM lineitem JOIN orders ON l_orderkey = o_orderkey, cut),
pairs AS (SELECT DISTINCT early, l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lines),
old AS (SELECT a, b FROM pairs WHERE early AND b IS NOT NULL), new AS (SELECT a, b FROM pairs WHERE NOT early AND b IS NOT NULL)"""


@query(HALVES + """ SELECT 'added' AS change, count(*) AS n FROM (SELECT * FROM new EXCEPT SELECT * FROM old)
UNION ALL SELECT 'removed', count(*) FROM (SELECT * FROM old EXCEPT SELECT * FROM new)
UNION ALL SELECT 'kept', count(*) FROM (SELECT * FROM old INTERSECT SELECT * FROM new)""")
def graph_diff(t: Tables) -> DataFrame:
    """Edges added, removed and kept between a snapshot (the earlier half of the orders) and the rest."""
    o = t.orders.select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    cut = o.agg(F.expr("percentile(us, 0.5)").alias("m"))
    lines = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).crossJoin(F.broadcast(cut))  # one row
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = lines.select((F.col("us") <= F.col("m")).alias("early"), F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b")).where("b IS NOT NULL")
    sides = pairs.groupBy("a", "b").agg(F.max("early").alias("old"), F.max(~F.col("early")).alias("new"))
    kind = F.when(F.col("old") & F.col("new"), "kept").when(F.col("new"), "added").otherwise("removed")
    got = sides.groupBy(kind.alias("change")).agg(F.count("*").alias("n"))
    names = t.spark.createDataFrame([("added",), ("removed",), ("kept",)], "change string")
    return names.join(got, "change", "left").na.fill(0, ["n"])


# --- traversals -------------------------------------------------------------------------------------------------------

SEED = "seed AS (SELECT src AS id FROM follows GROUP BY src ORDER BY sum(weight) DESC, src LIMIT 1)"


def _top_sources(edges: DataFrame, n: int) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "id").limit(n).select("id")


@query(f"""WITH RECURSIVE {FOLLOWS_SQL}, {SEED}, walk AS (SELECT id, 0 AS depth FROM seed
UNION SELECT f.dst, depth + 1 FROM walk JOIN follows f ON f.src = walk.id WHERE depth < 3)
SELECT id, min(depth)::INT AS depth FROM walk GROUP BY id""")
def impact_downstream(t: Tables) -> DataFrame:
    """First-seen depth of everything within three hops of the busiest part."""
    f = G.follows(t)
    seeds = _top_sources(f, 1).select(F.lit(0).alias("seed"), "id")
    return traversal.bfs(f, seeds, 3).select("id", "depth")


@query(f"""WITH RECURSIVE {STRONG_SQL}, {SEED.replace('follows', 'strong')}, walk AS (SELECT id FROM seed UNION SELECT s.dst FROM walk JOIN strong s ON s.src = walk.id) SELECT id FROM walk""")
def reachability_closure(t: Tables) -> DataFrame:
    """Everything reachable along edges seen twice, from the busiest source of such."""
    s = G.strong(t)
    return traversal.reachable(s, _top_sources(s, 1))


BATCH = f"""WITH RECURSIVE {FOLLOWS_SQL}, {SEED.replace('LIMIT 1', 'LIMIT 5')}, walk AS (SELECT id AS seed, id, 0 AS depth FROM seed
UNION SELECT seed, f.src, depth + 1 FROM walk JOIN follows f ON f.dst = walk.id WHERE depth < 1), reached AS (SELECT seed, id, min(depth) AS depth FROM walk GROUP BY 1, 2)"""


@query(BATCH + """ SELECT seed, count(*) FILTER (depth = 1) AS direct, count(*) AS total, count(DISTINCT p_brand) AS modules,
CASE WHEN count(*) FILTER (depth = 1) >= 30 OR count(DISTINCT p_brand) >= 5 OR count(*) >= 200 THEN 'CRITICAL'
WHEN count(*) FILTER (depth = 1) >= 15 OR count(DISTINCT p_brand) >= 3 OR count(*) >= 100 THEN 'HIGH'
WHEN count(*) FILTER (depth = 1) >= 5 OR count(*) >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk
FROM reached LEFT JOIN part ON id = 'Part:' || p_partkey WHERE depth > 0 GROUP BY seed""")
def impact_risk(t: Tables) -> DataFrame:
    """Upstream impact of the five busiest parts with risk classes."""
    f = G.follows(t)
    seeds = _top_sources(f, 5).select(F.col("id").alias("seed"), "id")
    reached = traversal.bfs(traversal.reversed_edges(f), seeds, 1)
    return traversal.impact_summary(reached, G.nodes(t).where("label = 'Part'").select("id", "grp"))


@query(BATCH + " SELECT id, count(DISTINCT seed) AS hits, min(depth)::INT AS depth FROM reached WHERE depth > 0 GROUP BY id HAVING count(DISTINCT seed) > 1")
def impact_batch_shared(t: Tables) -> DataFrame:
    """Nodes that more than one of several seeds reach."""
    f = G.follows(t)
    seeds = _top_sources(f, 5).select(F.col("id").alias("seed"), "id")
    reached = traversal.bfs(traversal.reversed_edges(f), seeds, 1).where("depth > 0")
    return reached.groupBy("id").agg(F.count_distinct("seed").alias("hits"), F.min("depth").alias("depth")).where("hits > 1")


def _upstream_whole(t: Tables) -> DataFrame:
    f = G.follows(t)
    seeds = _top_sources(f, 5).select(F.col("id").alias("seed"), "id")
    return traversal.bfs(traversal.reversed_edges(f), seeds, 3)


@query()
def impact_risk_whole(t: Tables) -> DataFrame:
    """Upstream impact of the five busiest parts within three hops, with risk classes; ``impact_risk`` stops at one hop."""
    return traversal.impact_summary(_upstream_whole(t), G.nodes(t).where("label = 'Part'").select("id", "grp"))


@query()
def impact_batch_shared_whole(t: Tables) -> DataFrame:
    """Nodes that more than one of several seeds reach within three hops; ``impact_batch_shared`` stops at one hop."""
    reached = _upstream_whole(t).where("depth > 0")
    return reached.groupBy("id").agg(F.count_distinct("seed").alias("hits"), F.min("depth").alias("depth")).where("hits > 1")


PATHS = f"""WITH RECURSIVE {FOLLOWS_SQL}, {SEED}, cut AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM follows) WHERE r <= 10),
walk AS (SELECT id, 0 AS depth FROM seed UNION SELECT c.dst, depth + 1 FROM walk JOIN cut c ON c.src = walk.id WHERE depth < 3),
reached AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


@query(PATHS + """ SELECT b.id AS id, b.depth::INT AS depth, round(max(c.weight / b.depth), 6) AS score FROM reached a JOIN cut c ON c.src = a.id
JOIN reached b ON b.id = c.dst AND b.depth = a.depth + 1 GROUP BY b.id, b.depth""")
def graph_path_scores(t: Tables) -> DataFrame:
    """Ranked paths from one node: ten heaviest edges per node, weight over depth."""
    f = G.follows(t)
    seeds = _top_sources(f, 1).select(F.lit(0).alias("seed"), "id")
    return traversal.strongest_paths(f, seeds, 3, 10).select("id", F.col("depth").cast("int").alias("depth"), _r("score").alias("score"))


@query()
def graph_path_scores_whole(t: Tables) -> DataFrame:
    """Ranked paths from one node over all edges within four hops; ``graph_path_scores`` follows ten a node, three hops."""
    f = G.follows(t)
    seeds = _top_sources(f, 1).select(F.lit(0).alias("seed"), "id")
    return traversal.strongest_paths(f, seeds, 4).select("id", F.col("depth").cast("int").alias("depth"), _r("score").alias("score"))


@query(f"""WITH {FOLLOWS_SQL}, {SEED}, one AS (SELECT dst AS id, min(1.0 / weight) AS distance FROM follows WHERE src IN (SELECT id FROM seed) GROUP BY dst),
two AS (SELECT f.dst AS id, min(distance + 1.0 / f.weight) AS distance FROM one JOIN follows f ON f.src = one.id GROUP BY f.dst)
SELECT id, round(min(distance), 6) AS distance, round(1 / min(distance), 6) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE id NOT IN (SELECT id FROM seed) GROUP BY id""")
def traversal_rank(t: Tables) -> DataFrame:
    """Score 1 / distance of nodes within two weighted hops of the seed."""
    f = G.follows(t)
    d = traversal.relaxed_distances(f, _top_sources(f, 1), 2)
    return d.select("id", _r("distance").alias("distance"), _r(1 / F.col("distance")).alias("score"))


@query(f"""WITH {STRONG_SQL}, both_ways AS (SELECT src, dst FROM strong WHERE src <> dst UNION SELECT dst, src FROM strong WHERE src <> dst),
two AS (SELECT a.src AS id, b.dst AS other FROM both_ways a JOIN both_ways b ON b.src = a.dst UNION SELECT src, dst FROM both_ways)
SELECT id, count(*) FILTER (other <> id) AS within_two FROM two GROUP BY id""")
def neighbourhood_two_hops(t: Tables) -> DataFrame:
    """How many other nodes are within two undirected hops."""
    return traversal.within_two(_keys(G.strong(t))).select(G.tag("Part", "id").alias("id"), "within_two")


CLOSURE = f"""WITH RECURSIVE {STRONG_SQL}, reach AS (SELECT src AS a, dst AS b FROM strong WHERE src <> dst UNION SELECT r.a, s.dst FROM reach r JOIN strong s ON s.src = r.b WHERE s.src <> s.dst),
ids AS (SELECT src AS id FROM strong UNION SELECT dst FROM strong)"""


@query(CLOSURE + """ SELECT id, least(id, coalesce((SELECT min(x.b) FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a WHERE x.a = ids.id), id)) AS scc FROM ids""")
def strongly_connected(t: Tables) -> DataFrame:
    """Strongly connected components of the edges seen twice."""
    found = stage(traversal.strong_components(_keys(G.strong(t))).select(G.tag("Part", "id").alias("id"), "scc"), "scc")
    names = found.groupBy("scc").agg(F.min("id").alias("name"))  # ids are compared as strings
    return found.join(names, "scc").select("id", F.col("name").alias("scc"))


@query(CLOSURE + """, loops AS (SELECT DISTINCT src AS id FROM strong WHERE src = dst), mutual AS (SELECT DISTINCT x.a AS id FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a UNION SELECT id FROM loops)
SELECT count(DISTINCT CASE WHEN id NOT IN (SELECT id FROM loops) OR id IN (SELECT x.a FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a) THEN least(id, (SELECT min(x.b) FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a WHERE x.a = mutual.id)) END) AS cycles,
(SELECT count(*) FROM loops) AS self_loops, count(*) AS nodes_on_cycles FROM mutual""")
def cycle_summary(t: Tables) -> DataFrame:
    """Cyclic components of two nodes and more, self loops, and nodes on either."""
    s = stage(_keys(G.strong(t)), "strong")
    scc = stage(traversal.strong_components(s), "scc")
    big = scc.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1")
    loops = s.where("src = dst").select(F.col("src").alias("id")).distinct()
    on = scc.join(big, "scc", "left_semi").select("id").unionByName(loops).distinct()
    return big.agg(F.count("*").alias("cycles")).crossJoin(loops.agg(F.count("*").alias("self_loops"))).crossJoin(on.agg(F.count("*").alias("nodes_on_cycles")))  # single rows


@query(CLOSURE + """, bad AS (SELECT DISTINCT x.a AS id FROM reach x WHERE x.a = x.b UNION SELECT src FROM strong WHERE src = dst),
behind AS (SELECT id FROM bad UNION SELECT b FROM reach WHERE a IN (SELECT id FROM bad)),
ok AS (SELECT id FROM ids WHERE id NOT IN (SELECT id FROM behind)),
steps AS (SELECT id, 0 AS level FROM ok WHERE id NOT IN (SELECT dst FROM strong) UNION SELECT s.dst, level + 1 FROM steps JOIN strong s ON s.src = steps.id WHERE s.dst IN (SELECT id FROM ok)),
done AS (SELECT id, max(level) AS level FROM steps GROUP BY id)
SELECT id, level::INT AS level FROM done UNION ALL SELECT id, (SELECT coalesce(max(level) + 1, 0) FROM done)::INT FROM behind""")
def topological_levels(t: Tables) -> DataFrame:
    """Kahn levels of the edges seen twice, with cycles as the last level."""
    return traversal.topological_levels(G.strong(t)).select("id", F.col("level").cast("int").alias("level"))


@query(f"""WITH RECURSIVE {STRONG_SQL}, both_ways AS (SELECT src, dst FROM strong UNION SELECT dst, src FROM strong),
reach AS (SELECT src AS a, dst AS b FROM both_ways UNION SELECT r.a, e.dst FROM reach r JOIN both_ways e ON e.src = r.b)
SELECT a AS id, min(b) AS component FROM (SELECT a, b FROM reach UNION SELECT a, a FROM reach) GROUP BY a""")
def connected_components(t: Tables) -> DataFrame:
    """Weakly connected components of the edges seen twice."""
    got = components.connected_components(G.strong(t))
    loops = G.strong(t).select(F.col("src").alias("id")).distinct().join(got, "id", "left_anti").withColumn("component", F.col("id"))
    return got.unionByName(loops)


FLOW_STEPS = f"""WITH RECURSIVE {STRONG_SQL}, steps AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM strong WHERE src <> dst) WHERE r <= 4),
walk AS (SELECT src AS entry, [src] AS path FROM (SELECT DISTINCT src FROM strong) WHERE src NOT IN (SELECT dst FROM strong)
UNION ALL SELECT entry, list_append(path, s.dst) FROM walk JOIN steps s ON s.src = path[-1] WHERE len(path) < 6 AND NOT list_contains(path, s.dst)),
ended AS (SELECT * FROM walk w WHERE len(path) = 6 OR NOT EXISTS (SELECT 1 FROM steps s WHERE s.src = w.path[-1] AND NOT list_contains(w.path, s.dst))),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY len(path) DESC, path) AS r FROM ended WHERE len(path) >= 3) WHERE r <= 12)"""


@query(FLOW_STEPS + """ SELECT entry, path[-1] AS terminal, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY path[1], path[-1] ORDER BY len(path) DESC, path) AS q FROM kept) WHERE q = 1""")
def execution_flows(t: Tables) -> DataFrame:
    """Flows from parts that nothing precedes; of flows with equal ends the longest."""
    s = G.strong(t)
    entries = s.select(F.col("src").alias("id")).distinct().join(s.select(F.col("dst").alias("id")), "id", "left_anti")
    p = traversal.longest_per_pair(traversal.flows(s, entries, 4, 6, 3, 12))
    return p.select("entry", F.element_at("path", -1).alias("terminal"), F.array_join("path", ">").alias("path"))


@query(FLOW_STEPS + """, named AS (SELECT entry || '>' || array_to_string(path, '>') AS flow, unnest(path) AS id, generate_subscripts(path, 1) AS step FROM kept)
SELECT flow, id, step::INT AS step FROM named""")
def flow_steps(t: Tables) -> DataFrame:
    """STEP edges: the 1-based position of every node in every flow."""
    s = G.strong(t)
    entries = s.select(F.col("src").alias("id")).distinct().join(s.select(F.col("dst").alias("id")), "id", "left_anti")
    p = traversal.flows(s, entries, 4, 6, 3, 12)
    return p.select(F.concat_ws(">", "entry", F.array_join("path", ">")).alias("flow"), F.posexplode("path").alias("pos", "id")).select("flow", "id", (F.col("pos") + 1).alias("step"))


# --- ranks ------------------------------------------------------------------------------------------------------------


def _pagerank_sql(head: str, edges: str, iterations: int, restart: str, dangling: bool) -> str:
    """Unrolled iterations; the last one is rounded."""
    out = [f"{head}, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {edges}), v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)",
           "deg AS MATERIALIZED (SELECT src, count(*) AS d FROM e GROUP BY src)", f"p AS MATERIALIZED ({restart})", "it0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS s FROM v)"]
    for i in range(iterations):
        lost = f"(SELECT coalesce(sum(s), 0) FROM it{i} WHERE id NOT IN (SELECT src FROM deg))" if dangling else "0"
        out.append(f"it{i + 1} AS MATERIALIZED (SELECT v.id AS id, (0.15 + 0.85 * {lost}) * p.p + 0.85 * coalesce(g.x, 0) AS s FROM v JOIN p ON p.id = v.id "
                   f"LEFT JOIN (SELECT e.dst AS id, sum(it{i}.s / deg.d) AS x FROM e JOIN it{i} ON it{i}.id = e.src JOIN deg ON deg.src = e.src GROUP BY e.dst) g ON g.id = v.id)")
    return "WITH " + ", ".join(out) + f" SELECT id, round(s, 8) AS score FROM it{iterations}"


@query(_pagerank_sql(STRONG_SQL, "strong", 8, "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS p FROM v", True))
def pagerank_global(t: Tables) -> DataFrame:
    """PageRank with dangling mass redistributed, eight iterations."""
    return rank.pagerank(G.strong(t), iterations=8, tolerance=0).select("id", _r("score", 8).alias("score"))


@query(_pagerank_sql(f"{FOLLOWS_SQL}, {SEED.replace('LIMIT 1', 'LIMIT 3')}", "follows", 5, "SELECT id, CASE WHEN id IN (SELECT id FROM seed) THEN 1.0::DOUBLE / 3 ELSE 0 END AS p FROM v", False))
def pagerank_personalised(t: Tables) -> DataFrame:
    """Personalised PageRank from three seeds over all part-to-part edges, five iterations, dangling mass lost."""
    f = G.follows(t)
    return rank.pagerank(f, iterations=5, tolerance=0, seeds=_top_sources(f, 3), dangling=False, stop_when_no_seeds=True).select("id", _r("score", 8).alias("score"))


def _walk_sql(iterations: int) -> str:
    out = [f"{STRONG_SQL}, {SEED.replace('follows', 'strong').replace('LIMIT 1', 'LIMIT 3')}", "tot AS MATERIALIZED (SELECT src, sum(weight) AS t FROM strong GROUP BY src)",
           "v AS MATERIALIZED (SELECT src AS id FROM strong UNION SELECT dst FROM strong)", "it0 AS (SELECT id, CASE WHEN id IN (SELECT id FROM seed) THEN 1.0::DOUBLE / 3 ELSE 0 END AS s FROM v)"]
    for i in range(iterations):
        out.append(f"it{i + 1} AS MATERIALIZED (SELECT v.id, 0.15 * it0.s + 0.85 * coalesce(g.x, 0) AS s FROM v JOIN it0 ON it0.id = v.id LEFT JOIN (SELECT id, sum(x) AS x FROM ("
                   f"SELECT k.dst AS id, it{i}.s * k.weight / tot.t AS x FROM strong k JOIN tot ON tot.src = k.src JOIN it{i} ON it{i}.id = k.src "
                   f"UNION ALL SELECT id, s FROM it{i} WHERE id NOT IN (SELECT src FROM tot)) GROUP BY id) g ON g.id = v.id)")
    return "WITH " + ", ".join(out) + f" SELECT id, round(s, 6) AS score FROM it{iterations}"


@query(_walk_sql(6))
def document_walk(t: Tables) -> DataFrame:
    """Weighted random walk with restart; ends keep their mass."""
    s = G.strong(t)
    return rank.weighted_walk(s, _top_sources(s, 3), iterations=6).select("id", _r("score").alias("score"))


def _labels_sql(rounds: int) -> str:
    out = [f"{STRONG_SQL}, b AS MATERIALIZED (SELECT src, dst FROM strong WHERE src <> dst UNION SELECT dst, src FROM strong WHERE src <> dst)", "l0 AS (SELECT DISTINCT src AS id, src AS c FROM b)"]
    for i in range(rounds):
        out.append(f"l{i + 1} AS MATERIALIZED (SELECT id, c FROM (SELECT b.src AS id, l.c AS c, row_number() OVER (PARTITION BY b.src ORDER BY count(*) DESC, l.c) AS r FROM b JOIN l{i} l ON l.id = b.dst GROUP BY b.src, l.c) WHERE r = 1)")
    return "WITH " + ", ".join(out)


@query(_labels_sql(3) + " SELECT id, c AS community FROM l3")
def communities(t: Tables) -> DataFrame:
    """Three rounds of deterministic label propagation."""
    return rank.label_propagation(G.strong(t), 3)


@query(_labels_sql(3) + """ SELECT m.c AS community, count(DISTINCT m.id) AS members, round(coalesce(avg(CASE WHEN n.c = m.c THEN 1.0 ELSE 0.0 END), 1.0), 6) AS cohesion
FROM l3 m LEFT JOIN b ON b.src = m.id LEFT JOIN l3 n ON n.id = b.dst GROUP BY m.c""")
def community_cohesion(t: Tables) -> DataFrame:
    """Members and cohesion of each community."""
    ids, s = rank.numbered(G.strong(t))
    out = rank.cohesion(s, rank.label_propagation(s, 3)).withColumnRenamed("community", "n").join(ids, "n")
    return out.select(F.col("id").alias("community"), "members", _r("cohesion").alias("cohesion"))


@query(_labels_sql(3) + """, per AS (SELECT m.c AS c, count(*) AS d, count(*) FILTER (n.c = m.c) AS i FROM b JOIN l3 m ON m.id = b.src JOIN l3 n ON n.id = b.dst GROUP BY m.c)
SELECT round(sum(i / (SELECT sum(d) FROM per) - pow(d / (SELECT sum(d) FROM per), 2)), 6) AS modularity FROM per""")
def community_modularity(t: Tables) -> DataFrame:
    """Modularity of the communities."""
    s = rank.numbered(G.strong(t))[1]
    return rank.modularity(s, rank.label_propagation(s, 3)).select(_r("modularity").alias("modularity"))


@query(f"""WITH {FOLLOWS_SQL}, o AS (SELECT src AS id, count(DISTINCT dst) AS callees FROM follows GROUP BY src), i AS (SELECT dst AS id, count(DISTINCT src) AS callers FROM follows GROUP BY dst),
b AS (SELECT coalesce(o.id, i.id) AS id, coalesce(callees, 0) AS callees, coalesce(callers, 0) AS callers FROM o FULL JOIN i ON o.id = i.id)
SELECT b.id AS id, callees, callers, round(callees / (callers + 1) * CASE WHEN p_name LIKE 'red %' THEN 1.5 WHEN p_name LIKE '% bolt' THEN 0.3 ELSE 1.0 END, 6) AS score FROM b JOIN part ON b.id = 'Part:' || p_partkey""")
def entry_point_scores(t: Tables) -> DataFrame:
    """Callees over callers, raised or lowered by name patterns."""
    boost = F.when(F.col("name").startswith("red "), 1.5).when(F.col("name").endswith(" bolt"), 0.3).otherwise(1.0)
    boosts = G.nodes(t).where("label = 'Part'").select("id", boost.alias("boost"))
    return rank.entry_points(G.follows(t), boosts).select("id", "callees", "callers", _r("score").alias("score"))


# --- reports ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {EDGES_SQL}, i AS (SELECT dst AS id, count(DISTINCT src) AS inn FROM edges GROUP BY dst), o AS (SELECT src AS id, count(DISTINCT dst) AS outt FROM edges GROUP BY src),
span AS (SELECT e.dst AS id, count(DISTINCT n.grp) AS span FROM edges e JOIN nodes n ON n.id = e.src GROUP BY e.dst)
SELECT n.id AS id, n.label AS label, coalesce(inn, 0) AS in_degree, coalesce(outt, 0) AS out_degree, coalesce(span, 0) AS span, coalesce(inn, 0) + coalesce(outt, 0) + 3 * greatest(coalesce(span, 0) - 1, 0) AS score
FROM nodes n LEFT JOIN i USING (id) LEFT JOIN o USING (id) LEFT JOIN span USING (id) WHERE coalesce(inn, 0) + coalesce(outt, 0) > 0 ORDER BY score DESC, id LIMIT 25""")
def hub_report(t: Tables) -> DataFrame:
    """The 25 top hubs: distinct in- and out-neighbours, and three points for each further group that reaches in."""
    e, n = stage(G.edges(t).select("src", "dst").distinct(), "hub-edges"), G.nodes(t)
    inn = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    span = e.join(n.select(F.col("id").alias("src"), "grp"), "src").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("grp").alias("span"))
    all_ = n.select("id", "label").join(inn, "id", "left").join(out, "id", "left").join(span, "id", "left").na.fill(0, ["in_degree", "out_degree", "span"])
    score = F.col("in_degree") + F.col("out_degree") + 3 * F.greatest(F.col("span") - 1, F.lit(0))
    return all_.where("in_degree + out_degree > 0").withColumn("score", score).orderBy(F.desc("score"), "id").limit(25)


@query(f"""WITH {STRONG_SQL}, p AS (SELECT 'Part:' || p_partkey AS id, p_brand, p_type FROM part), d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM strong UNION ALL SELECT dst FROM strong) GROUP BY id),
s AS (SELECT e.src, e.dst, 4 * (a.p_brand <> b.p_brand)::INT + 2 * (a.p_type <> b.p_type)::INT + 3 * (da.n > 2 OR db.n > 2)::INT AS score
FROM strong e JOIN p a ON a.id = e.src JOIN p b ON b.id = e.dst JOIN d da ON da.id = e.src JOIN d db ON db.id = e.dst)
SELECT src, dst, score::INT AS score FROM s WHERE score > 0 ORDER BY score DESC, src, dst LIMIT 50""")
def surprising_connections(t: Tables) -> DataFrame:
    """Edges across brands (4), types (2) or at busy nodes (3): the 50 most surprising."""
    s = G.strong(t).select("src", "dst")
    p = t.part.select(G.tag("Part", "p_partkey").alias("id"), "p_brand", "p_type")
    d = s.select(F.col("src").alias("id")).unionByName(s.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
    x = p.join(d, "id")
    a = x.select(F.col("id").alias("src"), F.struct("p_brand", "p_type", "n").alias("a"))
    b = x.select(F.col("id").alias("dst"), F.struct("p_brand", "p_type", "n").alias("b"))
    score = 4 * (F.col("a.p_brand") != F.col("b.p_brand")).cast("int") + 2 * (F.col("a.p_type") != F.col("b.p_type")).cast("int") + 3 * ((F.col("a.n") > 2) | (F.col("b.n") > 2)).cast("int")
    return s.join(a, "src").join(b, "dst").select("src", "dst", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "src", "dst").limit(50)


@query("""WITH trade AS (SELECT c_nationkey AS a, s_nationkey AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
big AS (SELECT a, b FROM trade GROUP BY a, b HAVING count(*) * 25 * 25 > (SELECT count(*) FROM trade)),
e AS (SELECT a AS n, count(DISTINCT b) AS ce FROM big WHERE a <> b GROUP BY a), i AS (SELECT b AS n, count(DISTINCT a) AS ca FROM big WHERE a <> b GROUP BY b)
SELECT n_name AS name, coalesce(ca, 0) AS afferent, coalesce(ce, 0) AS efferent, round(CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) = 0 THEN 0 ELSE coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) END, 6) AS instability
FROM nation LEFT JOIN e ON e.n = n_nationkey LEFT JOIN i ON i.n = n_nationkey""")
def coupling_matrix(t: Tables) -> DataFrame:
    """Afferent and efferent coupling between nations whose trade is above the mean, and their instability."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey").join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("b")), F.col("l_suppkey") == F.col("s_suppkey"))
    own = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", F.col("c_nationkey").alias("a")), F.col("o_custkey") == F.col("c_custkey"))
    n = lines.join(own, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("a", "b").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    big = n.crossJoin(F.broadcast(total)).where("n * 625 > t AND a <> b")  # one row
    ce = big.groupBy(F.col("a").alias("k")).agg(F.count("*").alias("efferent"))
    ca = big.groupBy(F.col("b").alias("k")).agg(F.count("*").alias("afferent"))
    j = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).join(ca, "k", "left").join(ce, "k", "left").na.fill(0, ["afferent", "efferent"])
    both = F.col("afferent") + F.col("efferent")
    return j.select("name", "afferent", "efferent", _r(F.when(both == 0, 0.0).otherwise(F.col("efferent") / both)).alias("instability"))


@query(f"""WITH {EDGES_SQL} SELECT n.id AS id, (SELECT count(*) FROM edges e WHERE e.dst = n.id) AS callers, (SELECT count(*) FROM edges e WHERE e.src = n.id) AS callees,
(SELECT count(DISTINCT m.id) - 1 FROM nodes m WHERE m.grp = n.grp) AS group_peers FROM nodes n WHERE n.label = 'Supplier'""")
def context_view(t: Tables) -> DataFrame:
    """360-degree counts of every supplier: callers, callees, peers of its group."""
    e, n = G.edges(t), G.nodes(t)
    callers = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    callees = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    peers = n.groupBy("grp").agg((F.count_distinct("id") - 1).alias("group_peers"))
    return n.where("label = 'Supplier'").select("id", "grp").join(callers, "id", "left").join(callees, "id", "left").join(peers, "grp").na.fill(0, ["callers", "callees"]).select("id", "callers", "callees", "group_peers")


@query("""WITH last AS (SELECT max(o_orderdate) AS m FROM orders), use AS (SELECT l_partkey, count(*) AS n, max(o_orderdate) AS latest FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey)
SELECT p_partkey, CASE WHEN coalesce(n, 0) > 30 THEN 'DO-NOT-DELETE' WHEN latest >= (SELECT m FROM last) - INTERVAL 30 DAY THEN 'CAUTION' ELSE 'DELETE-SAFE' END AS verdict FROM part LEFT JOIN use ON l_partkey = p_partkey""")
def can_delete(t: Tables) -> DataFrame:
    """Verdict per part: much used, used lately, or safe to delete."""
    o = t.orders.select("o_orderkey", "o_orderdate")
    use = t.lineitem.select("l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))
    last = o.agg(F.max("o_orderdate").alias("m"))
    j = t.part.select("p_partkey").join(use, F.col("p_partkey") == F.col("l_partkey"), "left").crossJoin(F.broadcast(last))  # one row
    verdict = F.when(F.col("n") > 30, "DO-NOT-DELETE").when(F.col("latest") >= F.col("m") - F.expr("INTERVAL 30 DAY"), "CAUTION").otherwise("DELETE-SAFE")
    return j.select("p_partkey", verdict.alias("verdict"))


@query(f"""WITH {STRONG_SQL}, rel AS (SELECT src AS id, dst AS other, 'callee' AS how FROM strong WHERE src <> dst UNION SELECT dst, src, 'caller' FROM strong WHERE src <> dst)
SELECT id, other, string_agg(how, ',' ORDER BY how) AS how FROM rel GROUP BY id, other""")
def find_related(t: Tables) -> DataFrame:
    """Related nodes with the ways they are related."""
    s = G.strong(t).where("src <> dst")
    rel = s.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("callee").alias("how")).unionByName(s.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("caller").alias("how"))).distinct()
    return rel.groupBy("id", "other").agg(F.array_join(F.sort_array(F.collect_list("how")), ",").alias("how"))


DEAD = f"""WITH RECURSIVE {FOLLOWS_SQL}, big AS (SELECT 'Part:' || p_partkey AS id FROM part WHERE p_size >= 45), red AS (SELECT 'Part:' || p_partkey AS id FROM part WHERE p_type = 'PROMO'),
twice AS (SELECT * FROM follows WHERE weight >= 2), r1 AS (SELECT id FROM big UNION SELECT t.dst FROM r1 JOIN twice t ON t.src = r1.id), r2 AS (SELECT id FROM red UNION SELECT t.dst FROM r2 JOIN twice t ON t.src = r2.id)"""


@query(DEAD + """ SELECT 'Part:' || p_partkey AS id, CASE WHEN 'Part:' || p_partkey IN (SELECT id FROM r1) AND 'Part:' || p_partkey IN (SELECT id FROM r2) THEN 'live' WHEN 'Part:' || p_partkey IN (SELECT id FROM r1) THEN 'entry-only'
WHEN 'Part:' || p_partkey IN (SELECT id FROM r2) THEN 'test-only' WHEN 'Part:' || p_partkey IN (SELECT dst FROM twice) THEN 'referenced' ELSE 'dead' END AS bucket FROM part""")
def dead_code(t: Tables) -> DataFrame:
    """Buckets by what reaches a part: entries, tests, both, only dead parts, nothing."""
    s = G.strong(t)
    p = t.part.select(G.tag("Part", "p_partkey").alias("id"), "p_size", "p_type")
    a = traversal.reachable(s, p.where("p_size >= 45").select("id")).withColumn("a", F.lit(True))
    b = traversal.reachable(s, p.where("p_type = 'PROMO'").select("id")).withColumn("b", F.lit(True))
    c = s.select(F.col("dst").alias("id")).distinct().withColumn("c", F.lit(True))
    j = p.select("id").join(a, "id", "left").join(b, "id", "left").join(c, "id", "left").na.fill(False)
    return j.select("id", F.when(F.col("a") & F.col("b"), "live").when(F.col("a"), "entry-only").when(F.col("b"), "test-only").when(F.col("c"), "referenced").otherwise("dead").alias("bucket"))


@query(f"""WITH RECURSIVE {NODES_SQL}, up AS (SELECT id, grp AS ancestor, 1 AS depth FROM nodes WHERE label IN ('Supplier', 'Nation', 'Region') UNION ALL SELECT up.id, n.grp, depth + 1 FROM up JOIN nodes n ON n.id = up.ancestor)
SELECT id, ancestor, depth::INT AS depth FROM up""")
def ancestors(t: Tables) -> DataFrame:
    """All ancestors of suppliers, nations and regions with their distance."""
    n = G.nodes(t)
    parent = n.where("label <> 'Part'").select(F.col("id").alias("src"), F.col("grp").alias("dst"))
    seeds = n.where(F.col("label").isin("Supplier", "Nation", "Region")).select(F.col("id").alias("seed"), "id")
    return traversal.bfs(parent, seeds, 8).where("depth > 0").select(F.col("seed").alias("id"), F.col("id").alias("ancestor"), F.col("depth").cast("int").alias("depth"))


for _f in (diamond_pattern, dead_code, find_related, reachability_closure, neighbourhood_two_hops, execution_flows, flow_steps, pagerank_global, document_walk, communities, community_cohesion, community_modularity, surprising_connections):
    whole_graph(_f, QUERIES, SQL)
for _f in (connected_components, strongly_connected, cycle_summary, topological_levels):
    whole_graph(_f, QUERIES, SQL, slow=True)


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return QUERIES[name](spark, sf_dir)
