"""Graphs by their components: those of bounded size lie in blocks, each the work of one task, whatever else there is.

What depends on a component alone (strong components, hops, cycles, communities) needs no rounds of joins then: a block holds
all edges of its components. Components that are larger come back for the methods that spread one over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.components import connected_components
from skein.sources.staging import discard, stage

BLOCK = 1_000_000  # edges of a component that goes into a block
WORK = 1 << 27  # its sum of squared degrees, so that no task forms more pairs
CHUNK = 500_000  # edges that are joined before others meet them


def roots(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of ``n`` places is connected with."""
    least = np.arange(n)
    while len(src):
        a, b = least[src], least[dst]
        apart = a != b
        src, dst, a, b = src[apart], dst[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        was = None
        while was is None or (least != was).any():
            was, least = least, least[least]
    return least


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each id of some edges and the smallest that these connect it with."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1)]
        ids, place = np.unique(np.concatenate(ends), return_inverse=True)
        src, dst = place.reshape(2, -1)
        least = roots(src, dst, len(ids))
        apart = least != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[apart]), pa.array(ids[least[apart]])], ["src", "dst"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= CHUNK:
            yield joined(held)
            held, n = [], 0
    if n:
        yield joined(held)


def split(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``edges`` (src, dst, whole numbers, and more columns) of components of bounded size with a ``block`` each, and those of
    larger ones, if there are any. A block holds whole components. Ids with no edge but to themselves may be left out."""
    given = stage(edges, "split", broadcast=False)
    square = F.sum(F.col("n").cast("double") * F.col("n")).alias("work")
    # edges of near ids lie together: most of their degrees are summed, and most edges joined, before others meet them
    edges = given if given.count() <= BLOCK else stage(given.repartitionByRange("src"), "near", broadcast=False)
    degree = stage(edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n")), "degree", broadcast=False)
    ends, work = degree.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(square, F.lit(0.0))).first()
    if ends <= 2 * BLOCK and work <= WORK:
        return edges.withColumn("block", F.lit(0).cast("long")), None
    if edges is not given:
        discard(given)
    of = stage(connected_components(edges.select("src", "dst").where("src <> dst").mapInArrow(_forest, "src long, dst long")), "components", broadcast=False)
    sizes = stage(degree.join(of, "id").groupBy("component").agg(F.sum("n").alias("n"), square), "sizes", broadcast=False)
    discard(degree)
    fits, light = (F.col("n") <= 2 * BLOCK) & (F.col("work") <= WORK), F.col("n") <= BLOCK // 2
    some = sizes.agg(F.coalesce(F.sum(F.when(light, F.col("n"))), F.lit(0)), F.count_if(~fits)).first()
    shares = max(1, math.ceil(some[0] / max(1, BLOCK // 2)))
    block = F.when(fits, F.when(light, -1 - F.pmod(F.xxhash64("component"), F.lit(shares))).otherwise(F.col("component")))
    home = of.join(sizes.select("component", block.alias("block")), "component").select(F.col("id").alias("src"), "block")
    placed = edges.join(home, "src").select(*edges.columns, "block")
    if not some[1]:
        return placed, None
    placed = stage(placed, "placed", broadcast=False)
    discard(edges, sizes)
    return placed.where("block IS NOT NULL"), placed.where("block IS NULL").drop("block")


def in_blocks(edges: DataFrame, answer: Callable[..., Iterator[tuple[np.ndarray, ...]]], schema: str) -> DataFrame:
    """The columns that ``answer`` makes, a piece at a time, of the columns of each block's edges."""
    columns = [c for c in edges.columns if c != "block"]
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def made(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for out in answer(*(np.concatenate(x) for x in zip(*held, strict=True))):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            block = batch.column("block").to_numpy()
            edge = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b == a:
                    continue
                if held and block[a] != key:
                    yield from made(held)
                    held = []
                key = block[a]
                held.append([batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in columns])
        if held:
            yield from made(held)

    return edges.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def numbered(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids, and both ends as places among them."""
    ids, place = np.unique(np.r_[src, dst], return_inverse=True)
    src, dst = place.reshape(2, -1)
    return ids, src, dst


def strong(src: np.ndarray, dst: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each id and the smallest one of its strong component, by Tarjan's method without recursion."""
    ids, src, dst = numbered(src, dst)
    n = len(ids)
    at = np.searchsorted(np.sort(src), np.arange(n + 1))
    next_, end, to = at[:-1].tolist(), at[1:].tolist(), dst[np.argsort(src, kind="stable")].tolist()
    seen, low, of, open_, t = [0] * n, [0] * n, [-1] * n, [], 0
    for root in range(n):
        if seen[root]:
            continue
        t += 1
        seen[root] = low[root] = t
        open_.append(root)
        path = [root]
        while path:
            v = path[-1]
            i = next_[v]
            if i < end[v]:
                next_[v] = i + 1
                w = to[i]
                if not seen[w]:
                    t += 1
                    seen[w] = low[w] = t
                    open_.append(w)
                    path.append(w)
                elif of[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
                continue
            path.pop()
            if low[v] == seen[v]:
                w = -1
                while w != v:
                    w = open_.pop()
                    of[w] = v
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
    of = np.array(of, np.int64)
    least = np.arange(n)
    np.minimum.at(least, of, np.arange(n))
    yield ids, ids[least[of]]


def _lists(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of edges by ``src``, and where the edges of each of ``n`` places begin and end in it."""
    order = np.lexsort((dst, src))
    at = np.searchsorted(src[order], np.arange(n + 1))
    return order, at[:-1], at[1:]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, in a row."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _shares(count: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of ``count`` of about ``most`` in all, of one place at least."""
    total, a = np.cumsum(count), 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield slice(a, b)
        a = b


PIECE = 2_000_000  # rows that a task makes at a time


def two_hops(src: np.ndarray, dst: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each id and how many others it reaches in one or two undirected hops."""
    ids, src, dst = numbered(src, dst)
    n = len(ids)
    both = np.unique(np.r_[src * n + dst, dst * n + src])
    src, dst = both // n, both % n
    at = np.searchsorted(src, np.arange(n + 1)).tolist()
    out, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    near = [dst[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    for i, own in enumerate(near):
        seen = np.concatenate([own, *(near[j] for j in own.tolist())])
        turn = np.arange(len(seen))
        last[seen] = turn
        out[i] = np.count_nonzero(last[seen] == turn) - (len(own) > 0)  # an id is its neighbours' neighbour
    yield ids, out


def diamonds(src: np.ndarray, dst: np.ndarray, strong: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``a, b, c, d`` of edges a-b, b-d, a-c, c-d with b <> c and a <> d, those over b being ``strong``. Edges are different."""
    ids, src, dst = numbered(src, dst)
    n = len(ids)
    order, begin, end = _lists(src, dst, n)
    src, dst, strong = src[order], dst[order], strong[order]
    for s in _shares(np.bincount(src, (end - begin)[dst], n).astype(np.int64), PIECE):
        first = np.arange(begin[s.start], end[s.stop - 1])
        more = (end - begin)[dst[first]]
        second = _ranges(begin[dst[first]], more)
        first = np.repeat(first, more)
        use = dst[second] != src[first]
        first, second = first[use], second[use]
        key = src[first] * n + dst[second]
        order = np.argsort(key, kind="stable")
        key, first, second = key[order], first[order], second[order]
        left = np.searchsorted(key, key)
        size = np.searchsorted(key, key, side="right") - left
        go = np.flatnonzero((size > 1) & strong[first] & strong[second])
        for t in _shares(size[go], PIECE):
            x = go[t]
            y = _ranges(left[x], size[x])
            x = np.repeat(x, size[x])
            x, y = x[dst[first[x]] != dst[first[y]]], y[dst[first[x]] != dst[first[y]]]
            yield ids[src[first[x]]], ids[dst[first[x]]], ids[dst[first[y]]], ids[dst[second[x]]]
