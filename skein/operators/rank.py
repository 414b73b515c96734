"""Iterative ranks and communities on graphs: PageRank in three variants, label propagation, cohesion, entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.sources.staging import stage


def _vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 30, tolerance: float = 1e-7, seeds: DataFrame | None = None, dangling: bool = True, stop_when_no_seeds: bool = False) -> DataFrame:
    """``id, score`` over the distinct ``src, dst`` edges.

    With ``dangling`` the mass of nodes without out-edges returns by the restart vector; without, it is lost. The restart
    vector is uniform on ``seeds``, or on all nodes without seeds; with ``stop_when_no_seeds`` an empty seed set restarts
    nowhere. Iterations end early once the L1 change is at most ``tolerance``. Per iteration: one join of scores with
    edges that are hashed by source, one aggregation by target.
    """
    e = stage(edges.select("src", "dst").distinct(), "pr-edges")
    n = _vertices(e).count()
    if not n:
        return e.select(F.col("src").alias("id"), F.lit(0.0).alias("score")).limit(0)
    out = e.groupBy("src").agg(F.count("*").alias("deg"))
    base = _vertices(e).join(out, F.col("id") == F.col("src"), "left").select("id", "deg")
    k = seeds.select("id").distinct().join(base, "id", "left_semi").count() if seeds is not None else 0
    if k:
        mark = seeds.select("id").distinct().withColumn("s", F.lit(1))
        base = base.join(mark, "id", "left").withColumn("p", F.when(F.col("s").isNotNull(), F.lit(1.0 / k)).otherwise(0.0)).drop("s")
    else:
        base = base.withColumn("p", F.lit(0.0 if stop_when_no_seeds else 1.0 / n))
    base = stage(base, "pr-nodes")
    links = stage(e.join(out, "src"), "pr-links")
    score = stage(base.select("id", F.lit(1.0 / n).alias("score")), "pr0")
    for i in range(1, iterations + 1):
        lost = 0.0
        if dangling:
            lost = score.join(base.where("deg IS NULL"), "id").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        got = links.join(score, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("score") / F.col("deg")).alias("got"))
        new = base.join(got, base["id"] == got["dst"], "left").select("id", (F.lit(1.0 - damping + damping * lost) * F.col("p") + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("score"))
        new = stage(new, f"pr{i}")
        if tolerance > 0:
            change = new.alias("a").join(score.alias("b"), "id").agg(F.sum(F.abs(F.col("a.score") - F.col("b.score")))).first()[0]
        score = new
        if tolerance > 0 and change <= tolerance:
            break
    return score


def weighted_walk(edges: DataFrame, seeds: DataFrame, restart: float = 0.15, iterations: int = 12) -> DataFrame:
    """``id, score``: random walk with restart along weighted edges; a node without out-edges keeps its mass."""
    w = edges.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("w"))
    total = w.groupBy("src").agg(F.sum("w").alias("t"))
    links = stage(w.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")), "walk")
    base = _vertices(w).unionByName(seeds.select("id")).distinct()
    k = seeds.select("id").distinct().count()
    mark = seeds.select("id").distinct().withColumn("s", F.lit(1.0 / max(1, k)))
    base = stage(base.join(mark, "id", "left").withColumn("s", F.coalesce("s", F.lit(0.0))).join(total.select(F.col("src").alias("id"), "t"), "id", "left"), "walk-nodes")
    score = base.select("id", F.col("s").alias("score"))
    for i in range(iterations):
        moved = links.join(score, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), (F.col("p") * F.col("score")).alias("x"))
        kept = score.join(base.where("t IS NULL"), "id").select("id", F.col("score").alias("x"))
        got = moved.unionByName(kept).groupBy("id").agg(F.sum("x").alias("x"))
        score = stage(base.join(got, "id", "left").select("id", (F.col("s") * restart + F.coalesce("x", F.lit(0.0)) * (1 - restart)).alias("score")), f"walk{i}")
    return score


def number_ids(ids: DataFrame) -> DataFrame:
    """``id, n``: different ids numbered from 0 in their order."""
    at = F.monotonically_increasing_id()
    placed = stage(ids.orderBy("id").select("id", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "placed")
    before = F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = placed.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each partition
    return stage(placed.join(parts, "part").select("id", (F.col("before") + F.col("at")).alias("n")), "ids")


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, n`` and ``src, dst``: the ids of all edges but loops numbered from 0 in their order, and the undirected simple
    graph in numbers, the smaller end first. The numbers are cheap to shuffle and to sort, and depend on the ids alone."""
    pairs = stage(_pairs(edges), "pairs")
    ids = number_ids(_vertices(pairs))
    mark = lambda c: ids.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"))
    return ids, stage(pairs.join(mark("src"), "src").join(mark("dst"), "dst").select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst")), "numbered")


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def label_propagation(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """``id, community``: each round a node takes its neighbours' most frequent label, ties the smallest; own labels first.

    Ids that are no whole numbers are numbered for the rounds. In the first round every label is there once, so the smallest
    neighbour wins without a vote.
    """
    if edges.schema["src"].dataType != T.LongType() or edges.schema["dst"].dataType != T.LongType():
        ids, pairs = numbered(edges)
        name = lambda c, as_: ids.select(F.col("n").alias(c), F.col("id").alias(as_))
        return label_propagation(pairs, rounds).withColumnsRenamed({"id": "a", "community": "b"}).join(name("a", "id"), "a").join(name("b", "community"), "b").select("id", "community")
    pairs = _pairs(edges)
    both = stage(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "lp")
    if not rounds:
        return _vertices(both).withColumn("community", F.col("id"))
    label = stage(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("community")), "lp0")
    for i in range(1, rounds):
        votes = both.join(label, F.col("dst") == F.col("id")).groupBy("src", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("m"), "community")).alias("b"))
        label = stage(best.select(F.col("src").alias("id"), F.col("b.community").alias("community")), f"lp{i}")
    return label


def neighbour_relations(edges: DataFrame, members: DataFrame, how: str = "left") -> DataFrame:
    """``community, degree, inside``: how many relations to neighbours the members have, and how many to other members of
    theirs. Each pair is joined with the communities of its two ends once and counts for both; with ``how`` "inner", only
    pairs of two members count."""
    a = members.select(F.col("id").alias("src"), F.col("community").alias("ca"), F.lit(True).alias("has_a"))
    b = members.select(F.col("id").alias("dst"), F.col("community").alias("cb"), F.lit(True).alias("has_b"))
    met = _pairs(edges).join(a, "src", how).join(b, "dst", how)
    ends = F.array(F.struct(F.col("has_a").alias("has"), F.col("ca").alias("community")), F.struct(F.col("has_b").alias("has"), F.col("cb").alias("community")))
    ends = met.select((F.col("ca") == F.col("cb")).alias("alike"), F.explode(ends).alias("e")).where("e.has")
    return ends.groupBy("e.community").agg(F.count("*").alias("degree"), F.count_if("alike").alias("inside"))


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``community, members, cohesion``: share of the neighbour relations of members that stay inside; 1 without any."""
    inner = neighbour_relations(edges, members).select("community", (F.col("inside") / F.col("degree")).alias("cohesion"))
    size = members.groupBy("community").agg(F.count("*").alias("members"))
    return size.join(inner, "community", "left").select("community", "members", F.coalesce("cohesion", F.lit(1.0)).alias("cohesion"))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row ``modularity`` of a partition of the undirected simple graph; ends without a community don't count."""
    per = neighbour_relations(edges, members, "inner")
    m = per.agg(F.sum("degree").alias("m2"))
    return per.crossJoin(F.broadcast(m)).agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), 2)).alias("modularity"))  # one row on the right


def entry_points(edges: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """``id, callees, callers, score``: callees / (callers + 1), times an optional ``boost`` per id; 0 without callees."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("callees"))
    inn = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"))
    both = out.join(inn, "id", "full_outer").na.fill(0, ["callees", "callers"])
    factor = F.lit(1.0)
    if boosts is not None:
        both = both.join(boosts, "id", "left")
        factor = F.coalesce("boost", F.lit(1.0))
    return both.select("id", "callees", "callers", (F.col("callees") / (F.col("callers") + 1) * factor).alias("score"))
