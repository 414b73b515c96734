"""Quality classifier on supervised subword embeddings.

Words, character n-grams and the kind of each pair of neighbouring words (equal or different) are hashed to rows of one
embedding table; a document is the weighted mean of its rows, and a softmax
over that mean gives the class probabilities. Table and output layer are trained together by stochastic gradient descent
in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import id_bucket, with_fields
from skein.llm.textbatch import code_points, slices, split_words, sum_by_text

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_features(words: pa.Array, buckets: int, grams: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of every word (itself and its character n-grams within ``<word>``), and how many rows each word has."""
    chars, at = code_points(words, "<", ">")
    n = len(words)
    c = chars.astype(np.uint64) + np.uint64(1)
    ends = np.repeat(at[1:], np.diff(at))
    owner = np.repeat(np.arange(n), np.diff(at))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(np.diff(at).max(initial=1)) + 1, _BASE, np.uint64))
        local = np.arange(len(c)) - np.repeat(at[:-1], np.diff(at))
        whole = np.add.reduceat(c * powers[local], at[:-1]) if n else np.zeros(0, np.uint64)
        ids, own = [_mix(whole)], [np.arange(n)]
        h = np.zeros(len(c), np.uint64)
        for k in range(grams[1]):
            m = len(c) - k
            if m <= 0:
                break
            h = h[:m] * _BASE + c[k : k + m]
            if k + 1 >= grams[0]:
                ok = np.arange(m) + k < ends[:m]
                ids.append(_mix(h[ok] + np.uint64(k + 1)))
                own.append(owner[:m][ok])
    order = np.argsort(np.concatenate(own), kind="stable")
    rows = (np.concatenate(ids) % np.uint64(buckets)).astype(np.int64)[order]
    return rows, np.bincount(np.concatenate(own), minlength=n)


PAIR_WEIGHT = 8.0  # a pair of neighbouring words counts as much as this many n-grams


def pair_features(index: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The two table rows for neighbouring words (equal, different), and per text how many pairs of either kind it has."""
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = owner[1:] == owner[:-1]
    same = inside & (index[1:] == index[:-1])
    n_same = np.bincount(owner[1:][same], minlength=len(counts))
    n_pairs = np.bincount(owner[1:][inside], minlength=len(counts))
    rows = (_mix(np.array([1, 2], np.uint64)) % np.uint64(buckets)).astype(np.int64)
    return rows, np.stack([n_same, n_pairs - n_same], axis=1).astype(np.float64)


@dataclass
class QualityModel:
    """``table`` holds an embedding per bucket; ``out`` and ``bias`` the softmax layer over classes 0 and 1."""

    table: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    grams: tuple[int, int] = (3, 5)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of class 1 for each whole text. Without words only the bias speaks."""
        words, index, counts = split_words(texts)
        mean = np.zeros((len(texts), self.table.shape[1]))
        if len(words):
            rows, per_word = word_features(words, len(self.table), self.grams)
            of_word = sum_by_text(self.table[rows], per_word)
            n = np.maximum(sum_by_text(per_word[index][:, None].astype(np.float64), counts), 1.0)
            pair_rows, pairs = pair_features(index, counts, len(self.table))
            pairs *= PAIR_WEIGHT
            mean = (sum_by_text(of_word[index], counts) + pairs @ self.table[pair_rows]) / (n + pairs.sum(axis=1, keepdims=True))
        z = mean @ self.out + self.bias
        return 1.0 / (1.0 + np.exp(np.clip(z[:, 0] - z[:, 1], -700, 700)))


def fit(texts: list[str], labels: list[int], buckets: int = 1 << 15, dims: int = 16, epochs: int = 5, rate: float = 0.5, seed: int = 7, grams: tuple[int, int] = (3, 5)) -> QualityModel:
    """Train on labelled texts. Classes are drawn equally often, then the bias is set back to their true shares."""
    rng = np.random.default_rng(seed)
    model = QualityModel(rng.uniform(-1 / dims, 1 / dims, (buckets, dims)).astype(np.float32), np.zeros((dims, 2)), np.zeros(2), grams)
    docs = []
    for t in texts:
        words, index, _ = split_words(pa.array([t], pa.string()))
        if not len(words):
            docs.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        rows, per_word = word_features(words, buckets, grams)
        weight = np.repeat(np.bincount(index, minlength=len(words)), per_word).astype(np.float64)
        pair_rows, pairs = pair_features(index, np.array([len(index)]), buckets)
        rows, weight = np.r_[rows, pair_rows], np.r_[weight, pairs[0] * PAIR_WEIGHT]
        uniq, inverse = np.unique(rows, return_inverse=True)
        w = np.bincount(inverse, weights=weight)
        docs.append((uniq, w / w.sum()))
    y = np.array(labels, np.int64)
    by = [np.flatnonzero(y == c) for c in (0, 1)]
    if not len(by[0]) or not len(by[1]):
        model.bias[1] = 20.0 * (len(by[1]) > 0) - 10.0 if len(y) else 0.0
        return model
    steps = epochs * len(y)
    pick = np.where(np.arange(steps) % 2 == 0, rng.choice(by[0], steps), rng.choice(by[1], steps))
    for step, i in enumerate(pick.tolist()):
        lr = rate * (1 - step / steps)
        rows, w = docs[i]
        x = w @ model.table[rows] if len(rows) else np.zeros(dims)
        z = x @ model.out + model.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        g = p
        g[y[i]] -= 1.0
        back = model.out @ g
        model.out -= lr * np.outer(x, g)
        model.bias -= lr * 0.1 * g
        if len(rows):  # the mean's gradient, scaled as if each row had its own step
            model.table[rows] -= (lr * (w * len(rows))[:, None] * back[None, :]).clip(-1, 1).astype(np.float32)
    model.bias += np.log(np.maximum([len(by[0]), len(by[1])], 1) / len(y)) - np.log(0.5)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 3000, max_chars: int = 30_000_000, max_text_chars: int = 300_000) -> pd.DataFrame:
    """A bounded sample of labelled whole texts: at most ``max_rows`` rows in the order of a hash of the id, and of those
    as many as stay within ``max_chars`` characters. Texts over ``max_text_chars`` characters are not learned from, so that
    no single one fills the sample; they are scored like all others. Rows whose crc32(doc_id) modulo 5 is 0 are held out; null labels,
    ids or texts teach nothing."""
    own = labels.where((id_bucket("doc_id", 5) != 0) & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    one = own.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"), F.min(F.col(label)).cast("int").alias("z")).where("y = z")
    few = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", "y")
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= max_text_chars)).select("doc_id", "text")
    rows = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    return got[got["text"].str.len().cumsum() <= max_chars]


def fit_from(docs: DataFrame, labels: DataFrame, **sample) -> QualityModel:
    """Fit on ``training_rows``; only the text enters the score."""
    rows = training_rows(docs, labels, **sample)
    return fit(rows["text"].tolist(), rows["y"].tolist())


def score_quality(docs: DataFrame, model: QualityModel, max_bytes: int = 2_000_000) -> DataFrame:
    """All columns of ``docs`` with ``score``, the probability of good quality of the whole text (a column of this name
    is replaced). Null and empty texts get the score of no evidence. Equal texts get equal scores."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "score"]
    base = docs.select(*(F.col(f"`{c}`") for c in keep))
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, max_bytes):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held.value.score(part.column(at)), pa.float64())], [*keep, "score"])

    return base.mapInArrow(run, with_fields(base, "score double"))
