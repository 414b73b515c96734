"""What five quality filters remove, in every order in which they can be applied.

One scan over the Arrow buffers of the texts counts words, capitals, code points and symbols by byte classes and prefix
sums, and distinct words by sorted hashes that are verified. A document's failures are a mask of five bits; all orders are
then read off the numbers of documents of each mask.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import wordscan
from skein.llm.common import stage
from skein.llm.textbatch import flat_bytes, slices

FILTERS = "ABCDE"
SLICE_BYTES = 2_000_000

_CLASS = np.zeros((3, 256), bool)  # capitals, symbols, first bytes of code points
_CLASS[0, 65:91] = True
_CLASS[1, list(b"#$%&*|")] = True
_CLASS[2] = True
_CLASS[2, 0x80:0xC0] = False


def _counts(of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the marked bytes are in each text, by prefix sums."""
    sums = np.zeros(len(of) + 1, np.int64)
    np.cumsum(of, out=sums[1:])
    return np.diff(sums[at])


def _scan(column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, SLICE_BYTES):
                raw, at = flat_bytes(part.column(column))
                capitals, symbols, points = (_counts(c[raw], at) for c in _CLASS)
                starts, ends, words = wordscan.spans(raw, at)
                found = [words, wordscan.distinct(raw, starts, ends, words), capitals, points, symbols]
                kept = [c for i, c in enumerate(part.columns) if i != column]
                names = [n for i, n in enumerate(part.schema.names) if i != column]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x.astype(np.int64)) for x in found)], [*names, *COUNTS])

    return run


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def text_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, text_sha256`` and the counts of each whole text: words, distinct words, capitals A-Z, code points and
    the symbols ``#$%&*|``. A null text counts as an empty one. Other columns are left out. Slices of a few MB are scanned
    at a time; a longer text is one slice and takes some 30 bytes a byte."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", F.sha2(text.cast("binary"), 256).alias("text_sha256"), text.alias("text"))
    types = dict(docs.dtypes)
    ddl = f"doc_id {types['doc_id']}, lang {types['lang']}, text_sha256 string, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(_scan(3), ddl)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For every part, order of the filters and step: how many documents stay, go, fail again or fail this filter only.

    ``docs`` has ``doc_id, text, lang``, ``labels`` has ``doc_id, quality, toxic``. Filters: A under 100 words; B under 80
    distinct words in 100; C over 10 capitals in 100 code points; D any of ``#$%&*|``; E a text that also has a smaller
    doc_id. A part is a ``lang`` (null: the empty string). Rows are counted, so repeated rows count each time; a row without
    doc_id is never larger than another, so it passes E. Labels of one id count once, as 1 if any is. No documents: no rows.

    Texts are scanned once and never shuffled. The first of equal texts is found by an aggregation on digests and met again
    on digest and id together, so copies, however many, don't meet in one task.
    """
    counted = stage(text_counts(docs), "text_counts")
    fails = [
        F.col("n_words") < 100,
        100 * F.col("n_distinct") < 80 * F.col("n_words"),
        100 * F.col("n_capitals") > 10 * F.col("n_points"),
        F.col("n_symbols") > 0,
    ]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    rows = counted.select("doc_id", "text_sha256", F.coalesce("lang", F.lit("")).alias("part"), mask.alias("mask"))
    first = rows.groupBy("text_sha256").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(first, ["text_sha256", "doc_id"], "left").join(known, "doc_id", "left")
    again = (F.col("first").isNull() & F.col("doc_id").isNotNull()).cast("int") * (1 << FILTERS.index("E"))
    one = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    masks = rows.groupBy("part", (F.col("mask") + again).alias("mask")).agg(F.count("*").alias("n"), one("good"), one("toxic"))
    return interactions(masks)


def _steps() -> str:
    """Every order's steps as JSON: the step's bit, and the bits of the filters before it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": step, "own": own, "before": before})
            before |= own
    return json.dumps(out)


def interactions(masks: DataFrame) -> DataFrame:
    """The report from the numbers of documents ``n, good, toxic`` by ``part, mask``: at most 32 rows a part, 600 out."""
    each = masks.withColumn("o", F.explode(F.from_json(F.lit(_steps()), "array<struct<filter_order:string,step:int,own:int,before:int>>"))).select("*", "o.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda n, when: F.sum(F.when(when, n).otherwise(F.lit(0))).cast("long")
    n = F.col("n")
    return each.groupBy("part", "filter_order", "step").agg(
        total(n, ~fails & ~gone).alias("kept"),
        total(n, fails & ~gone).alias("removed"),
        total(n, fails & gone).alias("redundant"),
        total(n, F.col("mask") == F.col("own")).alias("unique_fails"),
        total(F.col("good"), fails & ~gone).alias("good_lost"),
        total(F.col("toxic"), fails & ~gone).alias("toxic_lost"),
        # of k failing filters each comes first in 120 / k orders
        total((n * 120 / F.bit_count("mask")).cast("long"), fails).alias("shapley"),
    )
