"""Neighbourhoods as bounded subgraphs with the schema they show and a count of what was left out, for many seeds at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.sources.staging import stage

#: How much of a subgraph is shown.
MAX_NODES, MAX_EDGES, MAX_TEXT = 128, 256, 4096

_MASK = "shiftleft(1L, bit)"
_BITS = "filter(sequence(0, 63), i -> shiftright(bits, i) & 1L = 1L)"


def _slots(contexts: DataFrame) -> DataFrame:
    """``ctx, block, bit``: a place of its own for each of the distinct contexts, numbered in parts of about 1,024."""
    part = F.pmod(F.xxhash64("ctx"), F.lit(contexts.count() // 1024 + 1))
    number = F.row_number().over(W.partitionBy("part").orderBy("ctx")) - 1
    at = contexts.withColumn("part", part).withColumn("number", number)
    return at.select("ctx", (F.col("part") * (1 << 31) + F.floor(F.col("number") / 64)).alias("block"), (F.col("number") % 64).alias("bit"))


def _per_slot(x: DataFrame) -> DataFrame:
    """``block, bit, n``: in how many rows of ``x`` (block, bits) the bit is set."""
    alike = x.groupBy("block", "bits").agg(F.count("*").alias("n"))
    return alike.select("block", F.explode(F.expr(_BITS)).alias("bit"), "n").groupBy("block", "bit").agg(F.sum("n").alias("n"))


def subgraphs(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 1, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes, the edges and the counts of what is within ``hops`` of the seeds (ctx, id), edges taken both ways.

    ``nodes`` has id, label; ``edges`` src, dst, type. First: ``ctx, id, label, hop, place``, the nearest first, then by id, at
    most ``max_nodes`` of a ctx. Second: ``ctx, src, dst, type, place``, the edges between shown nodes by src, type and dst, at
    most ``max_edges``; so no end is missing. Third, for every ctx with a node: ``nodes, edges`` as observed, ``shown_nodes,
    shown_edges, cut_nodes``, ``cut_edges`` (over the bound) and ``open_edges`` (an end wasn't shown). Ids that are no node,
    and edges with such an end, aren't there; repeated nodes and edges count once, of repeated ids the smallest label.

    Contexts are numbered and travel 64 to a long, so a node near many of them is a row for each 64, and so is an edge; a node
    is a row of a context only in the first hop that fills its bound, and those before it.
    """
    known = nodes.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.min("label").alias("label"))
    e = stage(edges.select("src", "dst", "type").where("src IS NOT NULL AND dst IS NOT NULL AND type IS NOT NULL").distinct(), "edges")
    first = stage(seeds.select("ctx", "id").where("ctx IS NOT NULL").distinct().join(known.select("id"), "id", "left_semi").select("ctx", "id"), "seeds")
    slots = stage(_slots(first.select("ctx").distinct()), "slots")
    near = [stage(first.join(slots, "ctx").groupBy("block", "id").agg(F.bit_or(F.expr(_MASK)).alias("bits")), "near")]
    for _ in range(hops):
        last = near[-1]
        step = last.join(e.select(F.col("src").alias("id"), F.col("dst").alias("next")), "id").unionByName(last.join(e.select(F.col("dst").alias("id"), F.col("src").alias("next")), "id"))
        step = step.select("block", F.col("next").alias("id"), F.col("bits").alias("new"), F.lit(0).cast("long").alias("old"))
        for x in near:
            step = step.unionByName(x.select("block", "id", F.lit(0).cast("long").alias("new"), F.col("bits").alias("old")))
        step = step.groupBy("block", "id").agg(F.bit_or("new").bitwiseAND(F.bitwise_not(F.bit_or("old"))).alias("bits")).where("bits <> 0")
        near.append(stage(step.join(known.select("id"), "id", "left_semi").select("block", "id", "bits"), "near"))
    sizes = stage(reduce(DataFrame.unionByName, [_per_slot(x).withColumn("hop", F.lit(h)) for h, x in enumerate(near)]), "sizes")
    rows = []
    for h, x in enumerate(near):
        if h:
            open_ = sizes.where(F.col("hop") < h).groupBy("block", "bit").agg(F.sum("n").alias("n")).where(F.col("n") < max_nodes).groupBy("block").agg(F.bit_or(F.expr(_MASK)).alias("open"))
            x = x.join(open_, "block").withColumn("bits", F.col("bits").bitwiseAND(F.col("open"))).where("bits <> 0")
        rows.append(x.select("block", F.explode(F.expr(_BITS)).alias("bit"), "id", F.lit(h).alias("hop")))
    place = F.row_number().over(W.partitionBy("block", "bit").orderBy("hop", "id"))
    shown = reduce(DataFrame.unionByName, rows).withColumn("place", place).where(F.col("place") <= max_nodes)
    shown = stage(shown.join(slots, ["block", "bit"]).join(known, "id").select("ctx", "id", "label", "hop", "place"), "shown")
    ids, own = shown.select("id").distinct(), lambda c: shown.select("ctx", F.col("id").alias(c))
    closed = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    closed = stage(closed.join(own("src"), "src").join(own("dst"), ["ctx", "dst"]).select("ctx", "src", "dst", "type"), "closed")
    place = F.row_number().over(W.partitionBy("ctx").orderBy("src", "type", "dst"))
    linked = closed.withColumn("place", place).where(F.col("place") <= max_edges)
    all_ = reduce(DataFrame.unionByName, near).groupBy("block", "id").agg(F.bit_or("bits").alias("bits"))
    a, b = all_.select("block", F.col("id").alias("src"), F.col("bits").alias("a")), all_.select("block", F.col("id").alias("dst"), F.col("bits").alias("b"))
    inner = e.join(a, "src").join(b, ["dst", "block"]).select("block", F.col("a").bitwiseAND(F.col("b")).alias("bits")).where("bits <> 0")
    told = sizes.groupBy("block", "bit").agg(F.sum("n").alias("nodes")).join(_per_slot(inner).withColumnRenamed("n", "edges"), ["block", "bit"], "left").join(slots, ["block", "bit"])
    told = told.join(closed.groupBy("ctx").agg(F.count("*").alias("closed")), "ctx", "left").na.fill(0, ["edges", "closed"])
    shown_nodes, shown_edges = F.least("nodes", F.lit(max_nodes)), F.least("closed", F.lit(max_edges))
    counts = told.select(
        "ctx", "nodes", "edges", shown_nodes.cast("long").alias("shown_nodes"), shown_edges.cast("long").alias("shown_edges"), (F.col("nodes") - shown_nodes).cast("long").alias("cut_nodes"),
        (F.col("closed") - shown_edges).cast("long").alias("cut_edges"), (F.col("edges") - F.col("closed")).cast("long").alias("open_edges"),
    )
    return shown, linked, counts


def manifest(shown: DataFrame, linked: DataFrame, max_text: int = MAX_TEXT) -> DataFrame:
    """``ctx, shape, triples, text_cut``: the kinds of edges of each subgraph as ``Label -TYPE-> Label`` lines, its edges as
    ``Label:id TYPE Label:id`` lines in their order, each up to ``max_text`` characters, and whether one was longer."""
    label = lambda c: shown.select("ctx", F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    x = linked.join(label("src"), ["ctx", "src"]).join(label("dst"), ["ctx", "dst"])
    kind = F.concat("src_label", F.lit(" -"), "type", F.lit("-> "), "dst_label")
    line = F.concat("src_label", F.lit(":"), "src", F.lit(" "), "type", F.lit(" "), "dst_label", F.lit(":"), "dst")
    per = x.groupBy("ctx").agg(F.array_join(F.array_sort(F.collect_set(kind)), "\n").alias("shape"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda s: s["line"]), "\n").alias("triples"))  # bounded lists
    out = shown.select("ctx").distinct().join(per, "ctx", "left").na.fill("", ["shape", "triples"])
    cut = (F.length("shape") > max_text) | (F.length("triples") > max_text)
    return out.select("ctx", F.substring("shape", 1, max_text).alias("shape"), F.substring("triples", 1, max_text).alias("triples"), cut.alias("text_cut"))
