"""Word shingles of whole texts as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
CHUNK = 1 << 20  # bytes or words worked through at a time: bounds what one very long text needs


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


_INVERSE = pow(int(_BASE), -1, 1 << 64)
_UP, _DOWN = (np.cumprod(np.r_[np.uint64(1), np.full(CHUNK, b, np.uint64)]) for b in (_BASE, np.uint64(_INVERSE)))


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text in order, A-Z lowered, and the number of words of each text.

    A word is a run of bytes other than blank and the controls 9 to 13; texts are the ranges between ``at``. The prefix
    sums behind the hashes run over the bytes in chunks, so a very long text or word costs a few bytes a byte.
    """
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < at[1:]]
    fresh[edge] = inside[edge]
    starts = np.flatnonzero(fresh)
    inside[:-1] &= ~inside[1:] | fresh[1:]  # now the last byte of each word
    ends = np.flatnonzero(inside) + 1
    del inside, fresh
    h = np.zeros(len(starts), np.uint64)
    total = np.uint64(0)  # of all bytes before the chunk
    with np.errstate(over="ignore"):
        for a in range(0, len(low), CHUNK):
            part = low[a : a + CHUNK]
            sums = np.r_[np.uint64(0), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)])]
            sums = sums * _power(int(_BASE), a) + total
            i, j = np.searchsorted(starts, (a, a + len(part)))
            h[i:j] -= sums[starts[i:j] - a]
            i, j = np.searchsorted(ends, (a, a + len(part)), side="right")
            h[i:j] += sums[ends[i:j] - a]
            total = sums[-1]
        for a in range(0, len(low), CHUNK):
            i, j = np.searchsorted(starts, (a, a + CHUNK))
            h[i:j] *= _DOWN[starts[i:j] - a] * _power(_INVERSE, a)
        h += (ends - starts).astype(np.uint64) * _STEP
        for a in range(0, len(h), CHUNK):
            h[a : a + CHUNK] = mix(h[a : a + CHUNK])
    return h, np.diff(np.searchsorted(starts, at))


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each text, by text and hash, and their number per text.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    h, n_words = words(raw, at)
    n = len(n_words)
    end = np.cumsum(n_words)
    made, of = [], []
    with np.errstate(over="ignore"):
        for a in range(0, len(h), CHUNK):
            part = h[a : a + CHUNK + k]
            here = np.arange(a, min(a + CHUNK, len(h)))
            own = np.searchsorted(end, here, side="right").astype(np.int32)
            left = end[own] - here  # words from here to the text's end
            take = np.where(n_words[own] < k, left == n_words[own], left >= k)
            padded = np.r_[part, np.zeros(k, np.uint64)]
            acc = np.zeros(len(here), np.uint64)
            for j in range(k):
                acc = acc * _BASE + np.where(j < left, padded[j : j + len(here)], np.uint64(0))
            made.append(mix(acc[take] + np.minimum(n_words[own[take]], k).astype(np.uint64) * _STEP))
            of.append(own[take])
    del h
    got = np.concatenate(made) if made else np.zeros(0, np.uint64)
    own = np.concatenate(of) if of else np.zeros(0, np.int32)
    del made, of
    if n == 1:
        got = np.unique(got)
        return got, np.array([len(got)])
    order = np.lexsort((got, own))
    got, own = got[order], own[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (own[1:] != own[:-1])
    return got[new], np.bincount(own[new], minlength=n)
