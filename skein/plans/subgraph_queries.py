"""Bounded subgraphs around nations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import subgraph
from skein.sources import graph as G
from skein.sources.graph import EDGES_SQL, Tables

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


_AROUND = f"""WITH {EDGES_SQL}, e AS MATERIALIZED (SELECT DISTINCT src, dst, type FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)), b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
h0 AS (SELECT id AS ctx, id, 0 AS hop FROM nodes WHERE label = 'Nation'), h1 AS (SELECT ctx, id, hop FROM h0 UNION ALL SELECT DISTINCT ctx, dst, 1 FROM h0 JOIN b ON b.src = h0.id WHERE dst <> ctx),
near AS MATERIALIZED (SELECT ctx, id, hop FROM h1 UNION ALL SELECT DISTINCT h1.ctx, dst, 2 FROM h1 JOIN b ON b.src = h1.id AND h1.hop = 1 WHERE NOT EXISTS (SELECT 1 FROM h1 k WHERE k.ctx = h1.ctx AND k.id = dst)),
shown AS MATERIALIZED (SELECT near.*, label, row_number() OVER (PARTITION BY ctx ORDER BY hop, near.id)::INT AS place FROM near JOIN nodes ON nodes.id = near.id QUALIFY place <= 128),
inn AS MATERIALIZED (SELECT a.ctx AS ctx, e.src AS src, e.dst AS dst, e.type AS type, s.id IS NOT NULL AND d.id IS NOT NULL AS whole FROM near a JOIN e ON e.src = a.id JOIN near z ON z.ctx = a.ctx AND z.id = e.dst LEFT JOIN shown s ON s.ctx = a.ctx AND s.id = e.src LEFT JOIN shown d ON d.ctx = a.ctx AND d.id = e.dst),
linked AS MATERIALIZED (SELECT ctx, src, dst, type, row_number() OVER (PARTITION BY ctx ORDER BY src, type, dst)::INT AS place FROM inn WHERE whole QUALIFY place <= 256)"""


def _around(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = G.nodes(t)
    seeds = nodes.where("label = 'Nation'").select(F.col("id").alias("ctx"), "id")
    return subgraph.subgraphs(seeds, nodes, G.edges(t), hops=2)


@query(_AROUND + """, n AS (SELECT ctx, count(*) AS nodes FROM near GROUP BY 1), m AS (SELECT ctx, count(*) AS edges, count(*) FILTER (whole) AS closed FROM inn GROUP BY 1)
SELECT ctx, nodes, edges, least(nodes, 128) AS shown_nodes, least(closed, 256) AS shown_edges, nodes - least(nodes, 128) AS cut_nodes, closed - least(closed, 256) AS cut_edges, edges - closed AS open_edges FROM n JOIN m USING (ctx)""")
def subgraph_counts(t: Tables) -> DataFrame:
    """What is shown of, and left out of, the two hops around every nation."""
    return _around(t)[2]


@query(_AROUND + " SELECT ctx, src, dst, type, place FROM linked")
def subgraph_edges(t: Tables) -> DataFrame:
    """The edges shown of the two hops around every nation."""
    return _around(t)[1].select("ctx", "src", "dst", "type", "place")


@query(_AROUND + """, x AS (SELECT l.*, s.label AS sl, d.label AS dl FROM linked l JOIN shown s ON s.ctx = l.ctx AND s.id = l.src JOIN shown d ON d.ctx = l.ctx AND d.id = l.dst),
p AS (SELECT ctx, string_agg(DISTINCT sl || ' -' || type || '-> ' || dl, chr(10) ORDER BY sl || ' -' || type || '-> ' || dl) AS shape, string_agg(sl || ':' || src || ' ' || type || ' ' || dl || ':' || dst, chr(10) ORDER BY place) AS triples FROM x GROUP BY ctx)
SELECT ctx, shape[:4096] AS shape, triples[:4096] AS triples, length(shape) > 4096 OR length(triples) > 4096 AS text_cut FROM p""")
def subgraph_manifest(t: Tables) -> DataFrame:
    """The schema and the triples of those subgraphs as text."""
    shown, linked, _ = _around(t)
    return subgraph.manifest(shown, linked)
