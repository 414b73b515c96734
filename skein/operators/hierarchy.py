"""Class hierarchies: C3 linearisation and method lookup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.staging import stage


def merge_c3(name: str, parents: list[str], orders: list[list[str]]) -> list[str] | None:
    """The C3 order of a class from its parents and their orders; None if these are inconsistent."""
    lines = [list(x) for x in orders] + [list(parents)]
    out = [name]
    while any(lines):
        heads = (x[0] for x in lines if x)
        head = next((h for h in heads if not any(h in x[1:] for x in lines)), None)
        if head is None:
            return None
        out.append(head)
        lines = [x[1:] if x and x[0] == head else x for x in lines]
    return out


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        made = [None if any(o is None for o in orders) else merge_c3(i, list(names), orders) for i, names, orders in zip(pdf["id"], pdf["names"], pdf["orders"], strict=True)]
        yield pd.DataFrame({"id": pdf["id"], "mro": made})


def linearise(parents: DataFrame) -> DataFrame:
    """``id, mro`` from rows ``child, parent, pos``; null where the order is inconsistent, cyclic, or that of a parent is.

    The hierarchy is worked through level by level: a class is merged once the orders of all its parents are known. A row
    holds one class with its parents, so neither a common root nor a large hierarchy gathers in a task.
    """
    rows = stage(parents.select("child", "parent", "pos").distinct(), "parents")
    ids = rows.select(F.col("child").alias("id")).unionByName(rows.select(F.col("parent").alias("id"))).distinct()
    done = stage(ids.join(rows.select(F.col("child").alias("id")), "id", "left_anti").select("id", F.array("id").alias("mro")), "roots")
    left = rows
    while True:
        known = left.join(done.select(F.col("id").alias("parent"), "mro", F.lit(1).alias("known")), "parent", "left")
        whole = known.groupBy("child").agg(F.count("*").alias("n"), F.count("known").alias("k"), F.sort_array(F.collect_list(F.struct("pos", "parent", "mro"))).alias("p"))
        ready = whole.where("n = k").select(F.col("child").alias("id"), F.col("p.parent").alias("names"), F.col("p.mro").alias("orders"))
        new = stage(ready.mapInPandas(_merge, "id string, mro array<string>"), "mro")
        if new.isEmpty():
            break
        done = stage(done.unionByName(new), "orders")
        left = stage(left.join(new.select(F.col("id").alias("child")), "child", "left_anti"), "left")
    rest = left.select(F.col("child").alias("id")).distinct()
    return done.unionByName(rest.select("id", F.lit(None).cast("array<string>").alias("mro")))


def lookup(mro: DataFrame, methods: DataFrame) -> DataFrame:
    """``id, method, owner``: the first class in each order that has the method."""
    spots = mro.where("mro IS NOT NULL").select("id", F.posexplode("mro").alias("pos", "owner"))
    return spots.join(methods, "owner").groupBy("id", "method").agg(F.min_by("owner", "pos").alias("owner"))
