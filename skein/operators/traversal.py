"""Breadth-first traversals: reachability, impact, ranked paths, execution flows, topological levels, SCC."""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import blocks
from skein.operators.rank import number_ids
from skein.sources.staging import stage

#: Rounds run often: a broadcast in each of them would pass through the driver.
stage_round = functools.partial(stage, broadcast=False)


def reversed_edges(edges: DataFrame) -> DataFrame:
    """The same rows with ``src`` and ``dst`` exchanged."""
    other = {"src": "dst", "dst": "src"}
    return edges.select(*(F.col(c).alias(other.get(c, c)) for c in edges.columns))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of ``src, dst``, without self loops and repeats."""
    e = edges.select("src", "dst")
    return e.unionByName(reversed_edges(e).select("src", "dst")).where("src <> dst").distinct()


#: Pairs that one job forms at least, and how many for each edge, so that its shuffle files stay in proportion to
#: the input and the edges are read a number of times that doesn't grow with it.
PAIRS, PAIRS_AN_EDGE = 100_000_000, 8


def _in_shares(edges: DataFrame, pairs: DataFrame) -> int:
    """In how many jobs to form the ``pairs`` (one number) of staged ``edges``."""
    n = pairs.head()[0]
    return 1 if n <= PAIRS else math.ceil(n / max(PAIRS, PAIRS_AN_EDGE * edges.count()))


def within_two(edges: DataFrame) -> DataFrame:
    """``id, within_two``: how many other nodes each node of ``edges`` (src, dst) reaches in one or two undirected hops.

    Weak components of bounded size are counted in one task each, larger ones by joins.
    """
    small, large = blocks.split(edges.select("src", "dst").where("src <> dst"))
    found = stage(blocks.in_blocks(small, blocks.two_hops, "id long, within_two long"), "within-two", broadcast=False)
    return found if large is None else found.unionByName(_within_two_joined(large))


def _within_two_joined(edges: DataFrame) -> DataFrame:
    """``within_two`` by joins. Pairs are the sum of squared degrees. They are formed for one share of the nodes after another;
    what a job shuffled is dropped when its counts are staged."""
    e = stage(undirected(edges), "both-ways")
    shares = _in_shares(e, e.groupBy("src").agg(F.count("*").cast("double").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0))))
    done = None
    steps = e.select(F.col("src").alias("m"), F.col("dst").alias("other"))
    for k in range(shares):
        own = e.where(F.pmod(F.xxhash64("src"), F.lit(shares)) == k).select(F.col("src").alias("id"), F.col("dst").alias("m"))
        both = own.join(steps, "m").select("id", "other").unionByName(own.withColumnRenamed("m", "other"))
        both = both.repartition("id").distinct()
        part = stage(both.groupBy("id").agg(F.count_if(F.col("id") != F.col("other")).alias("within_two")), "within-two", broadcast=False)
        done = part if done is None else done.unionByName(part)
    return done


def diamonds(edges: DataFrame) -> DataFrame:
    """``a, b, c, d`` of ``edges`` (src, dst, strong; different, whole numbers): a-b, b-d, a-c, c-d with b <> c and a <> d, the two
    over b strong.

    Weak components of bounded size are searched in one task each. In larger ones, paths of two edges that have both ends
    in common are joined, for one share of the first ends after another; what a job shuffled is dropped when it is staged.
    """
    small, large = blocks.split(edges)
    done = stage(blocks.in_blocks(small, blocks.diamonds, "a long, b long, c long, d long"), "diamonds", broadcast=False)
    if large is None:
        return done
    s = large.where("strong").select("src", "dst")
    out = large.groupBy("src").agg(F.count("*").cast("double").alias("n"))
    shares = _in_shares(large, large.select(F.col("dst").alias("src")).join(out, "src").agg(F.coalesce(F.sum("n"), F.lit(0.0))))
    for k in range(shares):
        own = F.pmod(F.xxhash64("src"), F.lit(shares)) == k
        # no row is formed that isn't a diamond, but for b = c
        b = s.where(own).toDF("a", "b").join(s.toDF("b", "d"), "b").where("a <> d")
        c = large.where(own).select("src", "dst").toDF("a", "c").join(large.select("src", "dst").toDF("c", "d"), "c").where("a <> d")
        done = done.unionByName(stage(b.join(c, ["a", "d"]).where("b <> c").select("a", "b", "c", "d"), "diamonds", broadcast=False))
    return done


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, frontier_cap: int | None = None) -> DataFrame:
    """``seed, id, depth``: first depth at which each id is reached from each seed; seeds are at depth 0.

    ``seeds`` has ``seed, id``. One join of the frontier with the edges and one anti join with what was seen per level.
    The edges are staged once where levels will read them again, and every level is staged; what was seen is gathered in
    one table every eight levels, so plans don't grow with depth. Without ``max_depth`` it goes on until nothing is new.
    A frontier cap keeps the smallest ids per seed and level; it is off unless given.
    """
    steps = edges.select("src", "dst").distinct()
    if max_depth != 1:
        steps = stage_round(steps, "bfs-edges")
    seen = stage_round(seeds.select("seed", "id", F.lit(0).alias("depth")).distinct(), "bfs0")
    frontier = seen
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        new = frontier.select("seed", "id").join(steps, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct()
        new = new.join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        if frontier_cap is not None:
            new = new.withColumn("r", F.row_number().over(W.partitionBy("seed").orderBy("id"))).where(F.col("r") <= frontier_cap).drop("r")
        frontier = stage_round(new.withColumn("depth", F.lit(depth)), f"bfs{depth}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = stage_round(seen, "bfs-seen")
    return seen


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``id``: everything reachable from the ids in ``seeds``, these included, over any number of hops."""
    return bfs(edges, seeds.select(F.lit(0).alias("seed"), "id")).select("id")


def risk_level(direct: Column, processes: Column, modules: Column, total: Column) -> Column:
    """Impact class by fixed thresholds on direct, process, module and total counts."""
    return (
        F.when((direct >= 30) | (processes >= 5) | (modules >= 5) | (total >= 200), "CRITICAL")
        .when((direct >= 15) | (processes >= 3) | (modules >= 3) | (total >= 100), "HIGH")
        .when((direct >= 5) | (total >= 30), "MEDIUM")
        .otherwise("LOW")
    )


def impact_summary(reached: DataFrame, groups: DataFrame) -> DataFrame:
    """Per seed: direct and total ids reached, groups (``id, grp``) touched, and the risk class."""
    rows = reached.where("depth > 0").join(groups, "id", "left")
    per = rows.groupBy("seed").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("total"), F.count_distinct("grp").alias("modules"))
    return per.withColumn("risk", risk_level(F.col("direct"), F.lit(0), F.col("modules"), F.col("total")))


def strongest_paths(edges: DataFrame, seeds: DataFrame, max_depth: int = 4, per_node: int | None = None) -> DataFrame:
    """``seed, id, depth, score``: hop distance and edge weight over depth of the best edge at that distance.

    ``edges`` has ``src, dst, weight``; each node follows all of its edges, or its ``per_node`` heaviest if that is given.
    """
    cut = edges
    if per_node is not None:
        best = W.partitionBy("src").orderBy(F.desc("weight"), "dst")
        cut = edges.withColumn("r", F.row_number().over(best)).where(F.col("r") <= per_node)
    cut = stage(cut.select("src", "dst", "weight"), "paths")
    reached = bfs(cut, seeds, max_depth)
    back = reached.select("seed", F.col("id").alias("src"), (F.col("depth") + 1).alias("depth"))
    hits = back.join(cut, "src").select("seed", F.col("dst").alias("id"), "depth", "weight")
    scored = hits.join(reached.where("depth > 0"), ["seed", "id", "depth"])
    return scored.groupBy("seed", "id", "depth").agg(F.max(F.col("weight") / F.col("depth")).alias("score"))


def relaxed_distances(edges: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """``id, distance, depth``: least sum of 1 / weight over paths of at most ``max_depth`` edges from any seed.

    Bounded relaxation: per round each id keeps its least distance so far. Seeds are left out of the result.
    """
    start = seeds.select("id").distinct()
    dist = stage(start.select("id", F.lit(0.0).alias("distance"), F.lit(0).alias("depth")), "relax0")
    for k in range(1, max_depth + 1):
        step = dist.where(F.col("depth") == k - 1).join(edges, F.col("id") == F.col("src"))
        step = step.select(F.col("dst").alias("id"), (F.col("distance") + 1.0 / F.col("weight")).alias("distance"), F.lit(k).alias("depth"))
        dist = stage(dist.unionByName(step).groupBy("id").agg(F.min(F.struct("distance", "depth")).alias("m")).select("id", "m.distance", "m.depth"), f"relax{k}")
    return dist.join(start, "id", "left_anti")


def flows(edges: DataFrame, entries: DataFrame, branching: int = 4, max_depth: int = 10, min_steps: int = 3, per_entry: int = 12) -> DataFrame:
    """``entry, path``: paths without repeats from each entry along each node's first ``branching`` edges.

    ``edges`` has ``src, dst, weight``; the first edges are the heaviest, ties by ``dst``. A path ends where no new step
    is left or at ``max_depth`` nodes. Of each entry's paths of at least ``min_steps`` nodes the longest ``per_entry``
    stay, ties by the path itself.
    """
    best = W.partitionBy("src").orderBy(F.desc("weight"), "dst")
    steps = stage(edges.where("src <> dst").withColumn("r", F.row_number().over(best)).where(F.col("r") <= branching).select("src", "dst"), "steps")
    open_ = entries.select(F.col("id").alias("entry"), F.array("id").alias("path"))
    done = None
    for k in range(1, max_depth):
        ext = open_.join(steps, F.element_at("path", -1) == F.col("src"), "left").where("dst IS NULL OR NOT array_contains(path, dst)")
        grown = stage(ext.where("dst IS NOT NULL").select("entry", F.concat("path", F.array("dst")).alias("path")), f"flow{k}")
        tips = grown.select("entry", F.slice("path", 1, k).alias("path")).distinct()
        ended = open_.join(tips, ["entry", "path"], "left_anti")
        done = ended if done is None else done.unionByName(ended)
        open_ = grown
        if grown.isEmpty():
            break
    done = done.unionByName(open_) if done is not None else open_
    rank = W.partitionBy("entry").orderBy(F.desc(F.size("path")), "path")
    return done.where(F.size("path") >= min_steps).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= per_entry).drop("r")


def longest_per_pair(paths: DataFrame) -> DataFrame:
    """Of paths with the same first and last node, the longest; ties by the path."""
    w = W.partitionBy(F.element_at("path", 1), F.element_at("path", -1)).orderBy(F.desc(F.size("path")), "path")
    return paths.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def topological_levels(edges: DataFrame) -> DataFrame:
    """``id, level``: rounds in which nodes lose their last unresolved dependency (``src`` before ``dst``).

    Nodes on or behind a cycle never do; they get the level behind the last one.
    """
    e = edges.where("src <> dst").select("src", "dst").distinct()
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct()
    left = stage_round(edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct(), "topo")
    rest = stage_round(e, "topo-edges")
    done, level = None, 0
    while True:
        ready = left.join(rest.select(F.col("dst").alias("id")), "id", "left_anti").join(loops, "id", "left_anti")
        ready = stage_round(ready.withColumn("level", F.lit(level)), f"level{level}")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        if level % 16 == 15:
            done = stage_round(done, "levels")
        left = stage_round(left.join(ready, "id", "left_anti"), "left")
        rest = stage_round(rest.join(ready, rest["src"] == ready["id"], "left_anti"), "rest")
        level += 1
    tail = left.withColumn("level", F.lit(level))
    return tail if done is None else done.unionByName(tail)


def strong_components(edges: DataFrame) -> DataFrame:
    """``id, scc``: strongly connected components, named by their smallest id. Nodes without a cycle are their own.

    Weak components of bounded size are searched in one task each (``blocks``), larger ones by colours in rounds of joins.
    Ids that are no whole numbers are numbered for that.
    """
    if edges.schema["src"].dataType != T.LongType() or edges.schema["dst"].dataType != T.LongType():
        e = stage_round(edges.select("src", "dst").distinct(), "named")
        ids = number_ids(e.select(F.explode(F.array("src", "dst")).alias("id")).where("id IS NOT NULL").distinct())
        name = lambda n, c: ids.select(F.col("n").alias(n), F.col("id").alias(c))
        found = strong_components(e.join(name("a", "src"), "src").join(name("b", "dst"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))
        found = found.toDF("a", "b").join(name("a", "id"), "a").join(name("b", "scc"), "b").select("id", "scc")
    else:
        small, large = blocks.split(edges.where("src <> dst").select("src", "dst"))
        found = stage_round(blocks.in_blocks(small, blocks.strong, "id long, scc long"), "strong")
        found = found if large is None else found.unionByName(_by_colours(large))
    all_nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return all_nodes.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("scc")).unionByName(found)


def _by_colours(edges: DataFrame) -> DataFrame:
    """``strong_components`` in rounds of joins.

    Forward-backward colouring: each node takes the smallest id that reaches it; nodes that reach their colour's root
    inside the colour form its component and leave. Nodes without an edge in or out are trimmed first in every round.
    """
    rest = stage_round(edges.where("src <> dst").select("src", "dst").distinct(), "scc")
    all_nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    found = None
    while True:  # every round finds the component of each colour's root, so rounds end
        while True:  # trim
            size = rest.count()
            inner = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            rest = stage_round(inner.join(inner.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "trim")
            if rest.count() == size:
                break
        if rest.isEmpty():
            break
        color = rest.select(F.col("src").alias("id")).unionByName(rest.select(F.col("dst").alias("id"))).distinct().withColumn("c", F.col("id"))
        color = stage_round(color, "color")
        while True:
            came = rest.join(color, rest["src"] == color["id"]).select(F.col("dst").alias("id"), "c")
            new = stage_round(color.unionByName(came).groupBy("id").agg(F.min("c").alias("c")), "color")
            moved = new.join(color, ["id", "c"], "left_anti").isEmpty()
            color = new
            if moved:
                break
        a = color.withColumnsRenamed({"id": "src", "c": "cs"})
        b = color.withColumnsRenamed({"id": "dst", "c": "cd"})
        inside = stage_round(rest.join(a, "src").join(b, "dst").where("cs = cd").select("src", "dst"), "inside")
        roots = color.where("id = c").select(F.col("c").alias("seed"), "id")
        got = bfs(reversed_edges(inside), roots).select("id", F.col("seed").alias("scc"))
        got = stage_round(got, "got")
        found = got if found is None else found.unionByName(got)
        gone = got.select("id")
        rest = stage_round(rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "rest")
    own = all_nodes.select("id", F.col("id").alias("scc"))
    if found is None:
        return own
    return own.join(found.select("id"), "id", "left_anti").unionByName(found)
