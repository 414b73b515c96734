"""The best documents of every query by BM25 over shared terms: share by share, in tasks of bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries of a block, postings of a share at most and at least, scores and summands worked through at a time.
BLOCK, ROWS, FEW, SCORES = 1024, 1 << 20, 1 << 15, 1 << 21
PLACES = 6
ASKS, POSTS = ("query_id", "idf", "mean"), ("doc", "tf", "len")


def _ranks(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each value among the distinct ones in order, and these."""
    coded = col.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(order)


class _Best:
    """The best documents so far of each query, by rounded score and then place."""

    def __init__(self, queries: int, top: int):
        self.top, self.least = top, np.zeros(queries)
        self.qi, self.di, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, s: np.ndarray, there: np.ndarray, first: int) -> None:
        """Scores (query, document) of the documents from ``first`` on, all behind those met before."""
        s = np.where(there, np.floor(s * 10.0**PLACES + 0.5) / 10.0**PLACES, -1.0)
        floor = self.least
        if s.shape[1] > self.top:
            floor = np.maximum(floor, np.partition(s, -self.top, axis=1)[:, -self.top])
        qi, di = np.nonzero(s >= floor[:, None])
        qi, di, score = np.r_[self.qi, qi], np.r_[self.di, di + first], np.r_[self.score, s[qi, di]]
        order = np.lexsort((di, -score, qi))
        qi, di, score = qi[order], di[order], score[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        last = place == self.top - 1
        self.least[qi[last]] = score[last]
        keep = place < self.top
        self.qi, self.di, self.score = qi[keep], di[keep], score[keep]


def _share(asks: pa.Table, posts: pa.Table, top: int, every: bool, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """The best documents of a share for each query of a block."""
    asks, posts = asks.combine_chunks(), posts.combine_chunks()
    one = lambda t, c: t[c].chunk(0)
    named = one(asks, "query_id").dictionary_encode(null_encoding="encode")
    q, terms = named.indices.to_numpy(zero_copy_only=False).astype(np.int64), one(asks, "term").dictionary_encode()
    t, n = terms.indices.to_numpy(zero_copy_only=False), len(named.dictionary)
    idf = np.zeros(len(terms.dictionary))
    idf[t] = one(asks, "idf").to_numpy()
    order = np.argsort(t, kind="stable")
    ask, many = q[order], np.bincount(t, minlength=len(idf))
    begin = np.cumsum(many) - many
    wanted = np.bincount(q, minlength=n)
    at = pc.index_in(one(posts, "term"), value_set=terms.dictionary)
    posts, at = posts.filter(at.is_valid()).combine_chunks(), at.drop_null().to_numpy().astype(np.int64)
    if not len(at):
        return
    doc, docs = _ranks(one(posts, "doc"))
    tf, mean = one(posts, "tf").to_numpy(), max(one(asks, "mean")[0].as_py(), 1e-9)
    part = idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * one(posts, "len").to_numpy() / mean))
    order = np.argsort(doc, kind="stable")
    doc, at, part = doc[order], at[order], part[order]
    edge = np.searchsorted(doc, np.arange(len(docs) + 1))
    sums = np.r_[0, np.cumsum(many[at])][edge]  # summands before each document
    best, x = _Best(n, top), 0
    while x < len(docs):
        y = max(x + 1, min(x + SCORES // n, int(np.searchsorted(sums, sums[x] + SCORES, side="right")) - 1))
        some, width = slice(edge[x], edge[y]), y - x
        times = many[at[some]]
        who = ask[np.repeat(begin[at[some]] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
        cell = who * width + np.repeat(doc[some] - x, times)
        s = np.bincount(cell, np.repeat(part[some], times), n * width).reshape(n, width)
        if every:
            best.meet(s, np.bincount(cell, minlength=n * width).reshape(n, width) == wanted[:, None], x)
        else:
            best.meet(s, s > 0, x)
        x = y
    if len(best.qi):
        tbl = one(posts, "tbl").take(pa.array(np.zeros(len(best.qi), np.int64)))
        yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(best.qi)), tbl, docs.take(pa.array(best.di)), pa.array(best.score)], ["query_id", "tbl", "doc", "score"])


def _solve(top: int, every: bool, k1: float, b: float):
    """The best of each group; a group's queries come before its postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if all(held):
                asks, posts = (pa.Table.from_batches(h) for h in held)
                yield from _share(asks, posts, top, every, k1, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            part, kind = (batch.column(c).to_numpy() for c in ("part", "kind"))
            tbl = batch.column("tbl").dictionary_encode().indices.to_numpy()
            new = (part[1:] != part[:-1]) | (kind[1:] != kind[:-1]) | (tbl[1:] != tbl[:-1])
            starts = np.flatnonzero(np.r_[True, new])
            for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
                own = (batch.column("tbl")[x].as_py(), int(part[x]))
                if own != key:
                    yield from done()
                    key, held = own, ([], [])
                piece = batch.slice(x, y - x).select(["tbl", "term", *(POSTS if kind[x] else ASKS)])
                if kind[x] and not held[0]:
                    continue  # nobody asks
                held[int(kind[x])].append(piece)
        yield from done()

    return run


def best_documents(asks: DataFrame, posts: DataFrame, top: int, every: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, tbl, doc, score, rank``: the ``top`` documents of each table for every query, by the sum of their terms' BM25.

    ``asks`` has tbl, query_id, term, idf and the table's mean length; ``posts`` tbl, doc, term, tf, len, a row for a document
    and term. ``every`` wants all terms of a query that has them in ``asks``. Scores are rounded to six places before ranking,
    ties go to the smaller document. Rows without a document take no part.

    Postings are dealt to shares by document and queries lie in blocks, so a document meets a block in one task, which sums
    up a few documents at a time and keeps the best of each query: its memory grows with neither side, pairs of queries and
    postings are never shuffled, and a common term is in all shares.
    """
    spark = posts.sparkSession
    blocks = max(1, -(-asks.select("query_id").distinct().count() // BLOCK))
    posts = posts.where("doc IS NOT NULL AND tf > 0")
    n, tasks = posts.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, -(-n // ROWS), min(-(-n // FEW), -(-3 * tasks // blocks)))
    kinds = {c: d.schema[c].dataType for d, cs in ((asks, ("query_id", "idf", "mean")), (posts, ("doc",))) for c in cs} | {"tf": "double", "len": "double"}
    none = lambda cs: [F.lit(None).cast(kinds[c]).alias(c) for c in cs]
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) * shares
    x = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("part", F.col("part") + block)
    x = x.select("tbl", "part", F.lit(0).alias("kind"), "term", *ASKS, *none(POSTS))
    y = posts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.col("part") * shares + F.pmod(F.xxhash64("doc"), F.lit(shares)))
    y = y.select("tbl", "part", F.lit(1).alias("kind"), "term", *none(ASKS), "doc", F.col("tf").cast("double").alias("tf"), F.col("len").cast("double").alias("len"))
    dealt = x.unionByName(y).repartition(max(1, min(tasks, blocks * shares)), "tbl", "part").sortWithinPartitions("tbl", "part", "kind")
    found = dealt.mapInArrow(_solve(top, every, k1, b), f"query_id {kinds['query_id'].simpleString()}, tbl string, doc {kinds['doc'].simpleString()}, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "tbl").orderBy(F.desc("score"), "doc"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)
