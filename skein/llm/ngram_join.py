"""Exact Jaccard self-join on word shingles, and its connected components.

Every set of shingles is put in one global order, rarest first. Two sets of enough overlap share a shingle among the first
few of each, so sets meet on prefix shingles only. Length, positional and suffix filters drop pairs as they are formed (the
suffix filter bounds the overlap by the numbers of hashes in 128 ranges, or more for large sets). Pairs that were verified
once, on the texts, are not verified again.

Components need no list of all pairs: each set first meets the smallest set that shares a prefix shingle, then some sets of
the largest component of each shingle; at last only pairs of different components meet, each shingle's minority with the
rest. No link between components is lost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import discard, names_aside
from skein.llm.common import stage as stage_table
from skein.llm.shingles import mix, shingle_sets
from skein.llm.textbatch import flat_bytes, slices
from skein.operators.components import connected_components, smallest_ends, stars

stage = functools.partial(stage_table, broadcast=False)

SKETCH_BITS = 23
SKETCH_SLICES = 256
SLICE_BYTES = 300_000
PARTNERS = 8
RANGES = 128  # of hashes, for the bound on an overlap; larger sets have more


def _classes(sets: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A 128-bit name of each set: two independent folds of its hashes, each mixed with its size."""
    out = np.zeros((len(counts), 2), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        with np.errstate(over="ignore"):
            a = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), starts)
            b = np.add.reduceat(mix(sets + np.uint64(0x14057B7EF767814F)), starts)
            n = counts[some].astype(np.uint64)
            out[some, 0] = mix(a + n)
            out[some, 1] = mix(b ^ (n << np.uint64(32)))
    at = np.arange(len(counts) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(out)])


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact up to 64, then eight steps for each doubling."""
    wide = 64 + 8 * np.log2(np.maximum(counts, 64) / 64)
    return np.where(counts <= 64, counts, np.minimum(wide, 255)).astype(np.uint8)


def _profile(k: int):
    """Rows of kind 0: a document's class and set size. Rows of kind 1: a slice (``n``) of this task's counts of shingles
    by sketch cell; ``doc_id`` is then the task."""
    names = ["kind", "doc_id", "n", "cls", "th", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.uint16)
        held: list[np.ndarray] = []

        def count() -> None:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            cells[at] = np.minimum(cells[at] + n, 65535)
            held.clear()

        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                sets, counts = shingle_sets(*flat_bytes(part.column(1)), k)
                held.append((sets >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32))
                if sum(map(len, held)) > 1 << 20:
                    count()
                kind = np.zeros(len(counts), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(kind), part.column(0), pa.array(counts.astype(np.int64)), _classes(sets, counts), part.column(2), pa.nulls(len(counts), pa.binary())], names)
        if held:
            count()
        if not cells.any():
            return
        m = SKETCH_SLICES
        task = TaskContext.get().partitionId()
        for i, part in enumerate(cells.reshape(m, -1)):
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([task]), pa.array([i]), pa.nulls(1, pa.binary()), none, pa.array([part.astype("<u2").tobytes()], pa.binary())], names)

    return run


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up the slices of each number that a task is given, as they come."""
    held: dict[int, np.ndarray] = {}
    for pdf in frames:
        for n, x in zip(pdf["n"], pdf["cells"], strict=True):
            part = np.frombuffer(x, "<u2" if len(x) == (2 << SKETCH_BITS) // SKETCH_SLICES else "<i8").astype(np.int64)
            held[n] = held[n] + part if n in held else part
    for n, x in held.items():
        yield pd.DataFrame({"n": [n], "cells": [x.astype("<i8").tobytes()]})


def _levels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in _summed(frames):
        yield pd.DataFrame({"n": pdf["n"], "cells": [_level(np.frombuffer(x, "<i8")).tobytes() for x in pdf["cells"]]})


def _sketch(slices_: DataFrame) -> np.ndarray:
    """How often each cell's shingles occur, by ``_level``: the tasks' slices summed in two steps, never many in one task."""
    part = slices_.withColumn("g", F.floor(F.col("doc_id") / 256)).repartition("n", "g").select("n", "cells")
    part = part.mapInPandas(_summed, "n long, cells binary").repartition(SKETCH_SLICES, "n")
    out = np.zeros((SKETCH_SLICES, (1 << SKETCH_BITS) // SKETCH_SLICES), np.uint8)
    for row in part.mapInPandas(_levels, "n long, cells binary").collect():  # SKETCH_SLICES rows
        out[row.n] = np.frombuffer(row.cells, np.uint8)
    return out.reshape(-1)


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many of ``n`` ordered shingles must be seen to meet every set of Jaccard ``num / den`` or more."""
    return np.where(n > 0, n - -(-num * n // den) + 1, 0)


def _ranges(hashes: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall in each of ``RANGES`` ranges, or in more, where those would hold over 8 each."""
    bits = max(RANGES, len(hashes) // 8).bit_length() - 1
    return np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def _prefixes(k: int, num: int, den: int, sketch):
    names = ["cls", "n", "prefix", "ranges", "coarse"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sketch.value
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                sets, counts = shingle_sets(*flat_bytes(part.column(0)), k)
                own = np.repeat(np.arange(len(counts)), counts)
                order = np.lexsort((sets, often[(sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], own))
                want = prefix_length(counts, num, den)
                begin = np.cumsum(counts) - counts
                keep = np.arange(len(sets)) - begin[own] < want[own]
                flat = pa.array(sets[order][keep].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(want)].astype(np.int32)), flat)
                fine = [_ranges(x) for x in np.split(sets, np.cumsum(counts)[:-1])]
                size = np.array([len(x) for x in fine])
                few = size == RANGES  # the others say nothing by so few ranges, and are judged by their own
                coarse = np.concatenate([x if ok else np.zeros(RANGES, np.int32) for x, ok in zip(fine, few.tolist(), strict=True)]).reshape(-1, RANGES)
                few &= coarse.max(axis=1) < 128
                coarse = pa.FixedSizeListArray.from_arrays(pa.array(coarse.reshape(-1).astype(np.int8)), RANGES)
                coarse = pc.if_else(pa.array(few), coarse.cast(pa.list_(pa.int8())), None)
                fine = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(np.concatenate(fine).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([_classes(sets, counts), pa.array(counts.astype(np.int64)), lists, fine, coarse], names)

    return run


def _verify(k: int, num: int, den: int):
    """Of pairs with both texts, those that link: the exact counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in slices(batch, 2, SLICE_BYTES):
                for part in slices(half, 3, SLICE_BYTES):
                    a, na = shingle_sets(*flat_bytes(part.column(2)), k)
                    b, nb = shingle_sets(*flat_bytes(part.column(3)), k)
                    n = len(na)
                    oa, ob = np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)
                    h, o = np.r_[a, b], np.r_[oa, ob]
                    order = np.lexsort((h, o))
                    h, o = h[order], o[order]
                    twice = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
                    common = np.bincount(o[1:][twice], minlength=n)
                    linked = (common > 0) & (den * common >= num * (na + nb - common))
                    hit = pa.array(np.flatnonzero(linked))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(hit), part.column(1).take(hit)], ["src", "dst"])

    return run


def _enough(ni: Column, nj: Column, ub: Column, num: int, den: int) -> Column:
    """Whether sizes and an upper bound on the overlap allow a link."""
    return (F.least(ni, nj) * den >= F.greatest(ni, nj) * num) & (ub * (num + den) >= (ni + nj) * num)


def _repeats(rows: DataFrame) -> bool:
    """Whether any id and text come twice."""
    return not rows.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _shared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x.cast("int"))


def _halved(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(a) - 1, F.lit(2)), lambda i: F.element_at(a, i) + F.element_at(a, i + 1))


def _bound(a: str, b: str) -> Column:
    """Most that two sets can share by how many of their hashes fall in each range. Sets that may link have as many
    ranges or one twice as many as the other."""
    x, y = F.col(a), F.col(b)
    return F.when(F.size(x) > F.size(y), _shared(_halved(x), y)).when(F.size(x) < F.size(y), _shared(x, _halved(y))).otherwise(_shared(x, y))


def similar_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, cls, th, root, component_id, repeats`` for every row of ``docs`` (doc_id, text).

    Texts link when ``den`` times the shared shingles is at least ``num`` times those of either. ``cls`` names the set:
    documents of one class have equal sets; ``th`` is a hash of the text, ``root`` names the component; ``repeats`` says of
    the table whether any id and text come twice. ``component_id``
    is the smallest doc_id reachable over links; documents without words have an empty set, link with nothing and keep
    their own id. Null texts count as empty, null ids take part and are never the smallest unless alone. Rows that repeat
    an id are documents of their own that share it.
    The counts behind the order cover all documents in a sketch of fixed size: it decides speed, never results.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    both = stage(rows.mapInArrow(_profile(words), "kind int, doc_id long, n long, cls binary, th long, cells binary"), "profile")
    profile = both.where("kind = 0").drop("kind", "cells")
    repeats = _repeats(profile)
    sketch = spark.sparkContext.broadcast(_sketch(both.where("kind = 1").select("doc_id", "n", "cells")))

    made = rows.select("text").mapInArrow(_prefixes(words, num, den, sketch), "cls binary, n long, prefix array<long>, ranges array<int>, coarse array<tinyint>")
    firsts = [F.first(c).alias(c) for c in ("n", "prefix", "ranges", "coarse")]
    sets = stage(made.where("n > 0").groupBy("cls").agg(*firsts), "prefixes")
    sketch.destroy()
    spots = sets.select("cls", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "key"))
    often = sets.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = spots.join(often, "key").select("key", "cls", "n", "pos", (F.col("m") > 2).alias("open"))
    # ``prev``: the shared shingle before it in the set's order. Sets that share this one too have met there
    shared = stage(shared.withColumn("prev", F.lag("key").over(W.partitionBy("cls").orderBy("pos"))), "shared")

    # one text for each class that shares a prefix shingle
    wanted = shared.select("cls").distinct()
    holders = profile.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("doc_id", "th")).alias("h"))
    texts = rows.join(holders, F.col("doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("th") == F.col("h.th"))).select("cls", "text")
    texts = stage(texts.groupBy("cls").agg(F.first("text").alias("text")) if repeats else texts, "texts")
    sizes = sets.select("cls", F.col("n").cast("int").alias("n"), "ranges")
    tried: list[DataFrame] = []

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Links among pairs (x < y) that weren't looked at before."""
        for was in tried:
            pairs = pairs.join(was, ["x", "y"], "left_anti")
        # suffix filter: what the hash ranges of both sets allow; then the texts of what is left
        rx = sizes.select(F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("ranges").alias("rx"))
        ry = sizes.select(F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("ranges").alias("ry"))
        may = pairs.join(rx, "x").join(ry, "y").where(_enough(F.col("nx"), F.col("ny"), _bound("rx", "ry"), num, den))
        pairs = stage(may.select("x", "y"), f"pairs-{name}")
        tried.append(pairs)
        x = texts.select(F.col("cls").alias("x"), F.col("text").alias("text_x"))
        y = texts.select(F.col("cls").alias("y"), F.col("text").alias("text_y"))
        full = pairs.join(x, "x").join(y, "y").select("x", "y", "text_x", "text_y")
        return stage(full.mapInArrow(_verify(words, num, den), "src binary, dst binary"), name)

    def ordered(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]

    # first round: every set and the smallest set of each shared shingle
    low = shared.groupBy("key").agg(F.min(F.struct("cls", "n", "pos")).alias("p"))
    star = shared.join(low, "key").where("cls != p.cls")
    ub = F.least("pos", "p.pos") + F.least(F.col("n") - F.col("pos"), F.col("p.n") - F.col("p.pos"))
    star = star.where(_enough(F.col("n"), F.col("p.n"), ub, num, den)).select(*ordered("cls", "p.cls")).distinct()
    links = verified(star, "links1")
    # after a few rounds a set may have several ends: later rounds go on from all edges, the labels only say who has met
    known = stars(links, rounds=2)
    comps = smallest_ends(known)

    def mixed_keys(comps: DataFrame) -> DataFrame:
        """Rows of the shingles whose sets are not known as connected, with the component of most of them. A shingle of
        two sets is done: they have met."""
        named = shared.where("open").drop("open").join(comps.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
        per = named.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("k")).where("k > 1")
        return named.join(per.select("key", F.col("top.comp").alias("major")), "key")

    # second round: sets outside a shingle's largest component meet some sets of it, others for each shingle
    mixed = stage(mixed_keys(comps), "mixed")
    some = [F.min(F.struct(F.xxhash64("cls", "key", F.lit(i)), "cls", "n", "pos")) for i in range(PARTNERS)]
    pick = mixed.where("comp = major").groupBy("key").agg(F.array_distinct(F.array(*some)).alias("ps")).select("key", F.explode("ps").alias("p"))
    tries = mixed.where("comp != major").join(pick, "key").where(_enough(F.col("n"), F.col("p.n"), ub, num, den)).select(*ordered("cls", "p.cls")).distinct()
    found = verified(tries, "links2")
    before, known = known, stars(found.unionByName(known.toDF("src", "dst")), rounds=2)
    comps = smallest_ends(known)
    discard(mixed, found, before)

    # last round: the sets outside a shingle's largest component meet all of other components
    near = stage(mixed_keys(comps).join(sets.select("cls", "coarse"), "cls"), "near")
    side = lambda a: [F.col(c).alias(c + a) for c in ("cls", "n", "pos", "prev", "comp", "coarse")]
    minor = near.where("comp != major").select("key", *side("_x"))
    other = near.select("key", *side("_y"), (F.col("comp") == F.col("major")).alias("main"))
    ub = F.least("pos_x", "pos_y") + F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    fresh = ~F.coalesce(F.col("prev_x") == F.col("prev_y"), F.lit(False))
    may = F.col("coarse_x").isNull() | F.col("coarse_y").isNull() | _enough(F.col("n_x"), F.col("n_y"), _shared("coarse_x", "coarse_y"), num, den)
    meet = minor.join(other, "key").where((F.col("comp_x") != F.col("comp_y")) & (F.col("main") | (F.col("cls_x") < F.col("cls_y"))) & fresh & _enough(F.col("n_x"), F.col("n_y"), ub, num, den) & may)
    more = verified(meet.select(*ordered("cls_x", "cls_y")).distinct(), "links3")
    final = connected_components(more.unionByName(known.toDF("src", "dst")))

    named_docs = profile.join(final.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("component", "cls"))
    lowest = named_docs.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("low"))
    out = named_docs.join(lowest, "root", "left")
    own = F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id"))
    out = stage(out.select("doc_id", F.col("n").alias("n_shingles"), "cls", "th", "root", own.alias("component_id"), F.lit(repeats).alias("repeats")), "found")
    discard(both, sets, shared, texts, near, more, known, *tried)
    return out


@names_aside("doc_id", "text")
def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the document of the smallest id stays (null ids last, and
    of rows that share an id the one of the smallest text hash). Documents without words all stay. Columns are kept."""
    found = similar_components(docs, words, num, den)
    has_set = F.col("n_shingles") > 0
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("f")
    best = found.where(has_set).groupBy("root").agg(first).select("f.doc_id", "f.th")
    names = docs.columns
    taken = {c.lower() for c in names}
    key, mark = (next(x for x in (f"__{base}{i}" for i in range(len(names) + 1)) if x not in taken) for base in ("id", "hash"))
    stay = best.unionByName(found.where(~has_set).select("doc_id", "th").distinct()).select(F.col("doc_id").alias("stay_id"), F.col("th").alias("stay_hash"))
    own = [F.col("doc_id").cast("long").alias(key), F.xxhash64(F.col("text").cast("string")).alias(mark)]
    keyed = docs.select(*(F.col(f"`{c}`") for c in names), *own)
    kept = keyed.join(stay, F.col(key).eqNullSafe(F.col("stay_id")) & (F.col(mark) == F.col("stay_hash")), "left_semi")
    blank = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    if found.select("repeats").head(1) == [(True,)]:  # one of them
        kept = kept.where(blank).unionByName(kept.where(~blank).dropDuplicates([key, mark]))
    return kept.select(*(F.col(f"`{c}`") for c in names))
