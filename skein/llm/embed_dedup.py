"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Normalised vectors are projected on random directions, shifted and quantised; a table's bucket is the tuple of a few such
numbers. Vectors that share a bucket of any table are compared exactly, each pair in the first table where it meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stage
from skein.operators.components import connected_components

TABLES, PROJECTIONS, WIDTH, SEED = 16, 10, 2.0, 11
BLOCK = 1024


def bucket_keys(x: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """Bucket of every row of ``x`` (unit vectors) in every table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a = rng.standard_normal((x.shape[1], tables * projections))
    b = rng.uniform(0, width, tables * projections)
    cells = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, projections)
    mult = rng.integers(1, 1 << 62, projections, dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        return (cells * mult).sum(axis=2)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dim = np.asarray(batch.column("dim"))
        vectors = batch.column("vector")
        for d in np.unique(dim).tolist():
            at = pa.array(np.flatnonzero(dim == d))
            part = batch.take(at)
            x = np.asarray(part.column("vector").flatten()).reshape(-1, d)
            keys = bucket_keys(x / np.linalg.norm(x, axis=1, keepdims=True))
            col = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), TABLES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, col], [*part.schema.names, "keys"])
        del vectors


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of n vertices over edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links among the rows of whole cells: ``id, links, root`` for each row that has one."""
    pdf = pdf.reset_index(drop=True)
    group = pdf.groupby(["label", "dim", "t", "bucket", "i", "j"], sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(group, kind="stable")
    pdf, group = pdf.iloc[order], group[order]
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    ids, mult, t = pdf["id"].to_numpy(), pdf["copies"].to_numpy(), pdf["t"].to_numpy()
    side, own_i, own_j = pdf["side"].to_numpy(), pdf["i"].to_numpy(), pdf["j"].to_numpy()
    vectors, keys = pdf["vector"].to_list(), np.stack(pdf["keys"].to_list())
    left, right = [], []

    def links(p: np.ndarray, q: np.ndarray, x: np.ndarray, at: int) -> None:
        # pairs of one cell: within a diagonal cell each once, else across its two sides
        ok = (own_i[p] == own_j[p]) | (side[p] != side[q])
        tt = int(t[p[0]]) if len(p) else 0
        for e in range(tt):  # met in an earlier table: counted there
            ok &= keys[p, e] != keys[q, e]
        p, q = p[ok], q[ok]
        for c in range(0, len(p), 200_000):
            a, b = p[c : c + 200_000], q[c : c + 200_000]
            near = np.einsum("ij,ij->i", x[a - at], x[b - at]) >= threshold
            left.append(a[near])
            right.append(b[near])

    small = size <= 64
    for s, n in zip(start.tolist(), size.tolist(), strict=True):
        if n < 2:
            continue
        x = np.array(vectors[s : s + n], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if n <= 64:
            p, q = np.triu_indices(n, 1)
            links(p + s, q + s, x, s)
            continue
        for r in range(0, n, 256):  # the Gram matrix in strips
            near = x[r : r + 256] @ x.T >= threshold - 1e-9
            p, q = np.nonzero(near)
            m = p + r < q
            if m.any():
                links(p[m] + r + s, q[m] + s, x, s)
    del small
    a = np.concatenate(left) if left else np.zeros(0, np.int64)
    b = np.concatenate(right) if right else np.zeros(0, np.int64)
    if not len(a):
        return pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
    n_links = np.bincount(a, weights=mult[b], minlength=len(ids)) + np.bincount(b, weights=mult[a], minlength=len(ids))
    some = np.flatnonzero(n_links)
    return pd.DataFrame({"id": ids[some], "links": n_links[some].astype(np.int64), "root": ids[_roots(len(ids), a, b)[some]]})


def _cells(threshold: float):
    columns = ["label", "dim", "t", "bucket", "i", "j"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in frames:
            if pdf.empty:
                continue
            last = pdf[columns].iloc[-1]
            same = (pdf[columns] == last).all(axis=1).to_numpy()
            k = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last, maybe open, cell begins
            if k:
                yield _compare(pd.concat([*held, pdf.iloc[:k]]), threshold)
                held = [pdf.iloc[k:]]
            else:
                held.append(pdf)
        if held:
            yield _compare(pd.concat(held), threshold)

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding, label``.

    Vectors link when their labels are equal and not null and their cosine, in doubles, is at least ``threshold``.
    Vectors that are null, empty, zero or hold null or non-finite numbers, and those without a label, link with nothing;
    vectors of different lengths never link. Equal vectors collapse first and count as links of one another. Buckets
    over ``block`` rows are split in blocks, and every pair of blocks is a cell of its own, so nothing is capped. A pair
    is found if it meets in one of the tables: about 0.97 of pairs at the threshold, nearly all beyond 0.95. Rows that
    repeat a vec_id count as vectors of their own.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & some, F.lit(False))
    base = rows.where(good)
    # equal vectors: one representative, found by two hashes of the numbers
    same = ["label", "h1", "h2"]
    hashed = base.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), F.reverse("vector")))
    reps = stage(hashed.groupBy(*same).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")).withColumn("dim", F.size("vector")), "vectors")
    keyed = reps.select("id", "label", "copies", "dim", "vector").mapInArrow(_hash, "id long, label " + dict(rows.dtypes)["label"] + ", copies long, dim int, vector array<double>, keys array<long>")
    keyed = stage(keyed.withColumn("vector", F.col("vector").cast("array<double>")), "keyed")
    spots = keyed.select("id", "label", "dim", F.posexplode("keys").alias("t", "bucket"))
    sizes = spots.groupBy("label", "dim", "t", "bucket").agg(F.count("*").alias("m")).where("m > 1")
    met = keyed.select("*", F.posexplode("keys").alias("t", "bucket")).join(sizes, ["label", "dim", "t", "bucket"])
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    met = met.drop("own", "other", "m")
    cell = ["label", "dim", "t", "bucket", "i", "j"]
    dealt = met.repartition(*cell).sortWithinPartitions(*cell)
    found = stage(dealt.mapInPandas(_cells(threshold), "id long, links long, root long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    ids = reps.select(*same, "id", "copies").join(counts, "id", "left").join(comps, "id", "left")
    ids = ids.select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = hashed.select("vec_id", *same).join(ids, same).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
