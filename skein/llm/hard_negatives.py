"""Hard negatives of anchors, by exact inner products of integer vectors behind a principal-component bound.

Vectors are turned into the axes of their second moments, so that a few leading components carry most of an inner product.
The products of leading components are summed block by block; what the others can add is at most the product of the lengths
of the two remainders, plus a slack for rounding. Pairs that can't enter a list are dropped early, the rest are verified by
products of the integers.

Rows are dealt to groups of one label and of bounded size, and every block of anchors visits the groups that matter to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import stage

GROUP_NUMBERS = 500_000  # components of the rows of a group
ANCHORS = 128  # that are compared at once
ROWS = 2048
LIMIT = float(1 << 62)  # squared lengths under it have inner products in a long
FAR = (1 << 62) + 1


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``id, label, dim, q`` of the rows that take part: ``q`` are the components times ``scale``, rounded down.

    Out are rows without label, id or vector, with a null or non-finite component, with no component, or so long that inner
    products leave the range of a long (squared length 2^62 or more). Rows of one id count once: the one of the smallest
    label and vector.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("x") > 0))
    length = F.aggregate("x", F.lit(0.0), lambda a, x: a + x * scale * x * scale + F.abs(x) * 2 * scale + 1)
    rows = rows.where(length < LIMIT).withColumn("q", F.transform("x", lambda x: F.floor(x * scale).cast("long")))
    return rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("v")).select("id", "v.label", F.size("v.q").alias("dim"), "v.q")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for d in np.unique(dims).tolist():
            x = np.asarray(batch.column("q").filter(pa.array(dims == d)).flatten()).astype(np.float64).reshape(-1, d)
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, m in sums.items():
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(m[i, j])], ["dim", "i", "j", "m"])


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """An orthogonal matrix for each number of components: the eigenvectors of the second moments of all rows, largest
    first. Its size is the square of that number, whatever the number of rows."""
    sums = vectors.select("dim", "q").mapInArrow(_moments, "dim long, i long, j long, m double").groupBy("dim", "i", "j").agg(F.sum("m").alias("m"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():
        m = out.setdefault(r.dim, np.zeros((r.dim, r.dim)))
        m[r.i, r.j] = m[r.j, r.i] = r.m
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in out.items()}


class Turned:
    """Integer vectors, turned, with the length of what is left behind each block of leading components."""

    def __init__(self, q: np.ndarray, rotation: np.ndarray):
        self.q = q
        x = q.astype(np.float64)
        self.y = x @ rotation
        d = q.shape[1]
        self.edges = sorted({min(d, e) for e in (max(4, d // 8), max(8, d // 3), d)})
        tail = np.cumsum((self.y**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = [np.sqrt(tail[:, e]) if e < d else np.zeros(len(q)) for e in self.edges]
        self.length = np.sqrt((x**2).sum(axis=1))


def survivors(rows: Turned, at: slice, anchors: Turned, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a row and an anchor whose score may be in ``low .. high`` of the anchor, with their exact scores."""
    y = rows.y[at]
    # over the rounding of turned products and remainders: many times their error bound
    slack = np.outer(rows.length[at], anchors.length) * (64 * y.shape[1] * 2.0**-53) + 1e-6
    first = rows.edges[0]
    part = y[:, :first] @ anchors.y[:, :first].T
    more = np.outer(rows.rest[0][at], anchors.rest[0]) + slack
    r, a = np.nonzero((part + more >= low) & (part - more <= high))
    part, slack = part[r, a], slack[r, a]
    for k in range(1, len(rows.edges)):
        p, e = rows.edges[k - 1], rows.edges[k]
        part = part + np.einsum("ij,ij->i", y[r, p:e], anchors.y[a, p:e])
        more = rows.rest[k][at][r] * anchors.rest[k][a] + slack
        keep = (part + more >= low[a]) & (part - more <= high[a])
        r, a, part, slack = r[keep], a[keep], part[keep], slack[keep]
    score = np.empty(len(r), np.int64)
    for i in range(0, len(r), 100_000):
        s = slice(i, i + 100_000)
        score[s] = np.einsum("ij,ij->i", rows.q[at][r[s]], anchors.q[a[s]])
    return r, a, score


def _best(keys: list[np.ndarray], score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` best of each key: by score, then smallest id."""
    order = np.lexsort((ids, -score, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def _kth(slot: np.ndarray, score: np.ndarray, slots: int, k: int) -> np.ndarray:
    """The k-th best score of each slot's list, lists being sorted; the least number where there are fewer."""
    out = np.full(slots, -FAR)
    count = np.bincount(slot, minlength=slots)
    full = count >= k
    out[full] = score[np.cumsum(count)[full] - count[full] + k - 1]
    return out


def top_scores(rows: Turned, ids: np.ndarray, anchors: Turned, bounds: np.ndarray, k: int, other) -> tuple[np.ndarray, ...]:
    """The ``k`` best rows of each slot: ``slot, id, score``. Slot ``i * m + j`` is the j-th of the ``m`` score ranges
    ``bounds[i]`` of anchor ``i``; rows come by ascending id, so that later ones must be better to enter a full list.
    ``other(r, a)`` says which pairs count."""
    n, m = bounds.shape[:2]
    low, high = bounds[:, :, 0], bounds[:, :, 1]
    slot, got, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for begin in range(0, len(ids), ROWS):
        at = slice(begin, begin + ROWS)
        worst = _kth(slot, score, n * m, k).reshape(n, m)
        need = np.maximum(low, worst + 1)
        open_ = need <= high
        if not open_.any():
            break
        least = np.where(open_, need, FAR).min(axis=1)
        most = np.where(open_, high, -FAR).max(axis=1)
        r, a, s = survivors(rows, at, anchors, least, most)
        ok = other(begin + r, a)
        r, a, s = r[ok], a[ok], s[ok]
        i, j = np.nonzero((s[:, None] >= bounds[a][:, :, 0]) & (s[:, None] <= bounds[a][:, :, 1]) & (s[:, None] >= need[a]))
        slot, got, score = np.r_[slot, a[i] * m + j], np.r_[got, ids[at][r[i]]], np.r_[score, s[i]]
        best = _best([slot], score, got, k)
        slot, got, score = slot[best], got[best], score[best]
    return slot, got, score


def _search(rotation: dict[int, np.ndarray], k: int, same_label: bool):
    """Local lists of every anchor in one group of rows after another: rows of a group first, then its anchors."""

    def vectors(batch: pa.RecordBatch, d: int) -> np.ndarray:
        return np.asarray(batch.column("q").flatten()).astype(np.int64).reshape(-1, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, ids, labels = None, None, None, None
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for begin, end in _runs(batch, ["grp", "dim", "part", "anchor"]):
                some = batch.slice(begin, end - begin)
                own = tuple(some.column(c)[0].as_py() for c in ("grp", "dim", "part"))
                if own != key:
                    key, rows, held = own, None, []
                d = own[1]
                if not some.column("anchor")[0].as_py():
                    held.append(some)
                    continue
                if rows is None:
                    if not held:
                        continue
                    ids = np.concatenate([np.asarray(x.column("id")) for x in held])
                    labels = np.concatenate([np.asarray(x.column("label")) for x in held])
                    rows = Turned(np.concatenate([vectors(x, d) for x in held]), rotation[d])
                    held = []
                for i in range(0, some.num_rows, ANCHORS):
                    part = some.slice(i, ANCHORS)
                    anchor_ids, anchor_labels = np.asarray(part.column("id")), np.asarray(part.column("label"))
                    flat = part.column("bounds").flatten()
                    per = part.column("bounds").value_lengths().to_numpy().astype(np.int64)
                    m = int(per.max())
                    bounds = np.empty((len(per), m, 2), np.int64)
                    bounds[:, :, 0], bounds[:, :, 1] = 1, 0  # no range
                    own_anchor = np.repeat(np.arange(len(per)), per)
                    place = np.arange(len(own_anchor)) - np.repeat(np.cumsum(per) - per, per)
                    bounds[own_anchor, place, 0], bounds[own_anchor, place, 1] = np.asarray(flat.field("low")), np.asarray(flat.field("high"))
                    other = (lambda r, a: ids[r] != anchor_ids[a]) if same_label else (lambda r, a: labels[r] != anchor_labels[a])  # noqa: B023
                    slot, got, score = top_scores(rows, ids, Turned(vectors(part, d), rotation[d]), bounds, k, other)
                    names = np.zeros((len(per), m), np.int64)
                    names[own_anchor, place] = np.asarray(flat.field("id"))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor_ids[slot // m]), pa.array(names.reshape(-1)[slot]), pa.array(got), pa.array(score)], ["anchor_id", "range_id", "id", "score"])

    return run


def _runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[int, int]]:
    """Where consecutive rows of equal ``names`` begin and end."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for c in names:
        x = batch.column(c).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new).tolist()
    yield from zip(at, [*at[1:], n], strict=True) if n else ()


def _lists(vectors: DataFrame, anchors: DataFrame, same_label: bool, rotation: dict[int, np.ndarray], k: int) -> DataFrame:
    """``anchor_id, range_id, id, score, rank``: the best ``k`` rows of every range ``bounds`` of every anchor.

    Rows are dealt to groups of at most about GROUP_NUMBERS components, of one label if only equal labels count; an anchor
    visits all groups that may hold rows of its lists."""
    grp = F.col("label") if same_label else F.lit(0).cast("long")
    part = F.ceil(F.count("*") * F.col("dim") / GROUP_NUMBERS).cast("long").alias("parts")
    sizes = stage(vectors.groupBy(grp.alias("grp"), "dim").agg(part), "sizes")
    own = vectors.withColumn("grp", grp).join(sizes, ["grp", "dim"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    visits = anchors.withColumn("grp", grp).join(sizes, ["grp", "dim"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    none = F.lit(None).cast("array<struct<id:long,low:long,high:long>>")
    columns = ["grp", "dim", "part", "anchor", "id", "label", "q", "bounds"]
    met = own.withColumn("bounds", none).withColumn("anchor", F.lit(False)).select(columns).unionByName(visits.withColumn("anchor", F.lit(True)).select(columns))
    met = met.repartition("grp", "dim", "part").sortWithinPartitions("grp", "dim", "part", "anchor", "id")
    found = met.mapInArrow(_search(rotation, k, same_label), "anchor_id long, range_id long, id long, score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "range_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``is_anchor`` marks.

    ``vectors`` is ``id, label, dim, q`` as ``integer_vectors`` returns it. A score is the inner product with the anchor;
    higher ones come first, ties by smaller id. The positives are the first ``positives`` other rows of the anchor's label;
    for each, the negatives are the first ``negatives`` rows of another label with
    ``low * positive_score <= 100 * score <= high * positive_score``, ``rank`` from 1. Anchors or positives without any have
    no row; a negative positive score leaves no range. Vectors of different numbers of components never meet. An empty table
    has no result.
    """
    vectors = stage(vectors, "vectors")
    rotation = rotations(vectors)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(1 - FAR).cast("long").alias("low"), F.lit(FAR - 1).cast("long").alias("high")))
    anchors = vectors.where(is_anchor)
    near = _lists(vectors, anchors.withColumn("bounds", everything), True, rotation, positives)
    near = stage(near.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # whole numbers: rounded up and down without leaving the longs
    s = F.col("positive_score").cast("decimal(20,0)")
    bound = F.struct(F.col("positive_id").alias("id"), F.ceil(s * low / 100).cast("long").alias("low"), F.floor(s * high / 100).cast("long").alias("high"))
    ranges = near.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(bound).alias("bounds"))
    far = _lists(vectors, anchors.join(ranges, "id"), False, rotation, negatives)
    far = far.select("anchor_id", F.col("range_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return far.join(near, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
