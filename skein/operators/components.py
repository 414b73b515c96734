"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skein.sources.staging import discard, stage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, component``: the smallest id reachable over undirected ``edges`` (src, dst), for ids that have an edge.

    Each round hooks every vertex's larger neighbours to its smallest one, then its smaller ones to that; the edges turn
    into stars around the smallest ids in about log(n) rounds, whatever the diameter. A round is one staged job of
    aggregations and joins on vertices, which also observes whether anything changed: no neighbourhood is ever gathered,
    and a hub's rows can be split by the skew join. Self loops and repeated edges don't matter; null ends are ignored.

    """
    return smallest_ends(stars(edges, max_rounds))


def stars(edges: DataFrame, max_rounds: int = 60, rounds: int | None = None) -> DataFrame:
    """``u, v``: the edges after the rounds of ``connected_components``, each from a larger to a smaller id. They connect what
    ``edges`` connect.

    ``rounds`` ends early: an id may then have several smaller ends, so who goes on from here needs all of these edges;
    the smallest end alone loses links.
    """
    u, v = F.greatest("src", "dst"), F.least("src", "dst")
    clean = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    now = clean.select(u.alias("u"), v.alias("v")).where("u > v").distinct()
    if rounds is None:
        now = stage(now, "edges", broadcast=False)
    mark = None
    for _ in range(max_rounds if rounds is None else rounds):
        both = now.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e"))
        both = both.select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u > v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done = Observation()
        made = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        made = made.observe(done, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        was, now = now, stage(made, "stars", broadcast=False)
        discard(was)
        seen = done.get
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    else:
        if rounds is None:
            raise RuntimeError("components did not settle")
    return now


def smallest_ends(edges: DataFrame) -> DataFrame:
    """``id, component`` of ``stars``: an id is named by its smallest end. After all rounds that is the smallest id of its
    component, before it is some id of it, and ids of one component may have different ones."""
    ends = F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component")), F.struct(F.col("v").alias("id"), F.col("v").alias("component")))
    return edges.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.min("e.component").alias("component"))
