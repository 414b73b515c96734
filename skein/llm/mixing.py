"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight. A source whose share exceeds its maximum epochs is clamped there and the
excess is shared again among the others by weight, until none is above. Whole repetitions take every document; the
fractional repetition takes documents in the order of a seeded hash until the target is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import names_aside, stage

WORD = r"[^\x20\x09-\x0D]+"
DEFAULT_WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: str | Column = "text") -> Column:
    """Number of words of a text; null counts 0."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = DEFAULT_WEIGHTS) -> DataFrame:
    """Adds ``weight``: the given weights in turn to the sources by code point, null last. One row per source comes in."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int") + 1))


def water_fill(sources: DataFrame, budget_share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Adds ``target`` to rows of ``source, source_size, weight``.

    Each round is one small aggregation over the sources: the level is what is left of the budget after the clamped
    sources, per unit of weight of the others; sources whose share at that level exceeds their cap are clamped. Clamping
    only raises the level, so rounds end once none is added. Sources of size 0 get 0. Nothing is gathered but two sums.
    """
    rows = stage(sources.withColumn("cap", F.col("source_size") * F.lit(max_epochs)), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        caps, weight, n = rows.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count_if(over)).first()
        if n == clamped or not weight:
            break
        clamped = n
        level = max(level, (total * budget_share - caps) / weight)
    share = F.col("weight") * F.lit(level)
    return rows.withColumn("target", F.least(F.col("cap"), share if weight else F.col("cap")).cast("double")).drop("cap")


def mix(docs: DataFrame, weights: tuple[float, ...] = DEFAULT_WEIGHTS, budget_share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, bins: int = 4096, size: Column | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``: how often the mix takes each row of ``docs``.

    ``copies`` is the whole repetitions of its source plus one for documents in the fractional repetition. That one goes
    by the order of a seeded hash of id and size. Prefix sums over ``bins`` hash ranges per source find the range in which
    the target falls; only that range is put in order, row by row, so a source that holds most rows needs no task that
    sees more than a ``bins``-th of it. A row is taken there if the sum so far stays within the target; the first that
    passes it is taken if that brings the sum closer. Reruns agree; repeated rows are told apart by nothing and may swap.
    Null sources form one source. Null ids are allowed. Other columns are dropped.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (word_count() if size is None else size).alias("size"))
    h = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("size"), F.lit(seed))
    rows = stage(own.withColumn("h", h).withColumn("bin", F.pmod(F.col("h"), F.lit(bins)).cast("int")), "sizes")
    by_bin = stage(rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    sources = cyclic_weights(by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights)
    plan = water_fill(sources, budget_share, max_epochs)
    size0 = F.greatest(F.col("source_size"), F.lit(1))
    plan = plan.withColumn("whole", F.floor(F.col("target") / size0).cast("long")).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    # bins of a source: at most `bins` rows in a window
    sums = by_bin.withColumn("below", F.sum("bin_size").over(W.partitionBy("source").orderBy("bin")) - F.col("bin_size"))
    places = sums.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select(
        F.col("b.source").alias("source"), "bin", "source_size", "target", "whole", (F.col("part") - F.col("below")).alias("room"), "bin_size"
    )
    joined = rows.alias("r").join(places.alias("q"), F.col("r.source").eqNullSafe(F.col("q.source")) & (F.col("r.bin") == F.col("q.bin"))).select(
        "doc_id", F.col("r.source").alias("source"), "size", "h", F.col("r.bin").alias("bin"), "source_size", "target", "whole", "room", "bin_size"
    )
    at_edge = (F.col("room") > 0) & (F.col("room") < F.col("bin_size"))
    clear = joined.where(~at_edge).withColumn("extra", ((F.col("room") >= F.col("bin_size")) & (F.col("room") > 0)).cast("int"))
    order = W.partitionBy("source", "bin").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    edge = joined.where(at_edge).withColumn("upto", F.sum("size").over(order))
    over, under = F.col("upto") - F.col("room"), F.col("room") - (F.col("upto") - F.col("size"))
    edge = edge.withColumn("extra", F.when(over <= 0, 1).when(under < 0, 0).when(over < under, 1).otherwise(0)).drop("upto")
    out = clear.unionByName(edge)
    copies = F.col("whole") + F.col("extra")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "h")


@names_aside("doc_id", "text", "source")
def take_mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as ``mix`` takes it. All columns are kept, whatever their names.

    Rows that repeat id, size and source are dealt what is taken of them in turn, so no target is exceeded by rounding.
    Null sources are one source, null and empty texts are taken by whole repetitions, no rows give no rows.
    """
    names = docs.columns
    free = lambda base: next(x for x in (f"{base}{k}" for k in ("", *range(len(names) + 1))) if x.lower() not in {c.lower() for c in names})
    key, size, source, at, n = (free(f"__mix_{x}") for x in ("id", "size", "source", "at", "n"))
    taken = mix(docs, **params).select("doc_id", "size", "source", "copies")
    own = [F.col("doc_id").cast("long").alias(key), word_count().alias(size), F.col("source").cast("string").alias(source)]
    base = docs.select(*(F.col(f"`{c}`") for c in names), *own)
    # rows that repeat id, size and source share what the mix takes of them: the rest of the division goes to the first
    one = taken.groupBy("doc_id", "size", "source").agg(F.sum("copies").alias("c"), F.count("*").alias("rows"))
    one = one.where("c > 0")
    match = F.col(key).eqNullSafe(F.col("doc_id_")) & (F.col(size) == F.col("size_")) & F.col(source).eqNullSafe(F.col("source_"))
    renamed = one.select(F.col("doc_id").alias("doc_id_"), F.col("size").alias("size_"), F.col("source").alias("source_"), F.col("c").alias(n), F.col("rows").alias(at))
    alone = base.join(renamed.where(F.col(at) == 1), match).withColumn(n, F.col(n).cast("int"))
    several = base.join(renamed.where(F.col(at) > 1), match)
    turn = F.row_number().over(W.partitionBy(key, size, source).orderBy(F.xxhash64("text")))
    several = several.withColumn("turn_", turn).withColumn(n, (F.floor(F.col(n) / F.col(at)) + (F.col("turn_") <= F.col(n) % F.col(at)).cast("int")).cast("int"))
    kept = [*(F.col(f"`{c}`") for c in names), F.col(n)]
    both = alone.select(*kept).unionByName(several.select(*kept))
    return both.withColumn(key, F.explode(F.array_repeat(F.lit(True), F.col(n)))).select(*(F.col(f"`{c}`") for c in names))
