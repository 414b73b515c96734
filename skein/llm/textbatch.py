"""Arrow text columns as flat numpy buffers, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def filled(col: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return pc.fill_null(col, "") if col.null_count else col


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and the n + 1 offsets at which texts begin and end. Null texts are empty."""
    col = filled(col)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices whose texts take at most ``max_bytes`` together, or one row."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        done = size[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(size, done + max_bytes, side="right")))
        yield batch.slice(a, b - a)
        a = b


def split_words(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct white-space separated words of a text column, the index of each word in its place, and words per text."""
    lists = pc.utf8_split_whitespace(filled(col))
    words = lists.flatten()
    if len(words):
        keep = pc.not_equal(words, "")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        mask = keep.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(counts)), counts)[mask]
        counts = np.bincount(owner, minlength=len(counts))
        coded = words.filter(keep).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts
    return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(len(col), np.int64)


def sum_by_text(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows, of which text i owns ``counts[i]``."""
    out = np.zeros((len(counts), rows.shape[1]), np.float64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        out[some] = np.add.reduceat(rows, starts, axis=0)
    return out


def code_points(words: pa.Array, prefix: str = "", suffix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``prefix + word + suffix``, all words in a row, and the n + 1 offsets."""
    extra = len(prefix) + len(suffix)
    lens = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + extra
    text = (suffix + prefix).join(words.to_pylist())
    text = prefix + text + suffix if len(words) else ""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64), np.r_[0, np.cumsum(lens)]
