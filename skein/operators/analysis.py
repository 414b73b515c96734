"""Composite analyzers: scored resolution, flow reduction, overrides, validation, refresh plans, repository maps."""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCEPT, GAP = 0.95, 0.09  # a resolution must score this much, and lead by more than this


def resolve(candidates: DataFrame, query: str, score: str, key: str) -> DataFrame:
    """``query, key, score, status``: the best candidate of each query; ``ok`` if it scores enough and leads clearly, else
    ``ambiguous``. A sole candidate leads. Ties go to the smaller key."""
    w = W.partitionBy(query).orderBy(F.desc(score), key)
    top = candidates.withColumn("__r", F.row_number().over(w)).withColumn("__next", F.lead(score).over(w)).where("__r = 1")
    clear = (F.col(score) >= ACCEPT) & (F.coalesce(F.col(score) - F.col("__next"), F.lit(1.0)) > GAP)
    return top.select(query, key, score, F.when(clear, "ok").otherwise("ambiguous").alias("status"))


def maximal_paths(paths: DataFrame) -> DataFrame:
    """Paths that are no contiguous part of a longer one. Parts are found by equality: each path offers all of its own."""
    p = paths.select("path").distinct()
    k = F.size("path")
    every = F.flatten(F.transform(F.sequence(F.lit(1), k), lambda a: F.transform(F.sequence(F.lit(1), k - a + 1), lambda m: F.slice("path", a, m))))
    parts = p.select(k.alias("n"), F.explode(every).alias("part"))
    inner = parts.where(F.size("part") < F.col("n")).select(F.col("part").alias("path")).distinct()
    return p.join(inner, "path", "left_anti")


def overrides(orders: DataFrame, methods: DataFrame) -> DataFrame:
    """``child, method, parent``: the next class in the child's order that has a method of the child's own."""
    spots = orders.where("mro IS NOT NULL").select("id", F.posexplode("mro").alias("pos", "owner")).join(methods, "owner")
    own = spots.where("pos = 0").select(F.col("id"), "method")
    up = spots.where("pos > 0").join(own, ["id", "method"])
    return up.groupBy("id", "method").agg(F.min_by("owner", "pos").alias("parent")).select(F.col("id").alias("child"), "method", "parent")


def refresh_plan(old: DataFrame, new: DataFrame, key: str, content_hash: str) -> DataFrame:
    """``key, action``: add, replace, keep or delete, by the content hashes of two snapshots."""
    j = old.select(key, F.col(content_hash).alias("__a")).join(new.select(key, F.col(content_hash).alias("__b")), key, "full_outer")
    action = F.when(F.col("__a").isNull(), "add").when(F.col("__b").isNull(), "delete").when(F.col("__a") == F.col("__b"), "keep").otherwise("replace")
    return j.select(key, action.alias("action"))


def check_rows(df: DataFrame, checks: list[tuple[str, Column, float]]) -> DataFrame:
    """``check, value, allowed, status`` of aggregates against thresholds, all from one pass."""
    one = df.agg(*[v.cast("double").alias(f"c{i}") for i, (_, v, _) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.round(F.coalesce(F.col(f"c{i}"), F.lit(0.0)), 6).alias("value"), F.lit(float(m)).alias("allowed")) for i, (n, _, m) in enumerate(checks)])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("status", F.when(F.col("value") <= F.col("allowed"), "pass").otherwise("fail"))


def dangling(rows: DataFrame, column: str, ids: DataFrame, id_col: str, name: str) -> DataFrame:
    """``rule, violations``: references to ids that don't exist; null references count."""
    miss = rows.join(ids.select(F.col(id_col).alias("__id")).distinct(), F.col(column) == F.col("__id"), "left_anti")
    return miss.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")


class ResultCache:
    """Results by key with a time to live; the oldest go first when it is full."""

    def __init__(self, ttl: float = 600.0, size: int = 256, clock=time.monotonic):
        self.ttl, self.size, self.clock = ttl, size, clock
        self.held: OrderedDict = OrderedDict()

    def get(self, key, version=None) -> tuple[str, object]:
        """``hit``, ``miss``, ``stale`` (another version) or ``expired``, and the value of a hit."""
        if key not in self.held:
            return "miss", None
        at, ver, value = self.held[key]
        if self.clock() - at > self.ttl:
            del self.held[key]
            return "expired", None
        return ("hit", value) if ver == version else ("stale", None)

    def put(self, key, value, version=None) -> None:
        self.held.pop(key, None)
        self.held[key] = (self.clock(), version, value)
        while len(self.held) > self.size:
            self.held.popitem(last=False)
