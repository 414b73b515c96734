"""Words of many texts at once: where they begin and end in a flat byte buffer, their hashes, and exact comparisons.

A word is a run of bytes other than blank and the controls 9 to 13, as it stands.
"""

from __future__ import annotations

import hashlib

import numpy as np

from skein.llm.shingles import mix

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)  # of the first n bytes of a little-endian block
_LONG = 4096  # bytes from which a word is worked on by itself


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word of the texts between ``at``, and the number of words of each text."""
    inside = ~_SEPARATOR[raw]
    edge = at[:-1][at[:-1] < at[1:]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, at))


def blocks(raw: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at every place, as a view; zeros follow the last."""
    held = np.zeros(len(raw) + 8, np.uint8)
    held[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", held, 0, (1,))


def hashes(raw: np.ndarray, eights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes a round."""
    size = ends - starts
    with np.errstate(over="ignore"):
        h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        todo, done = np.flatnonzero(size <= _LONG), 0
        while len(todo):
            left = size[todo] - done
            part = eights[starts[todo] + done] & _MASK[np.minimum(left, 8)]
            h[todo] = mix(h[todo] ^ (part * np.uint64(0xD6E8FEB86659FD93)))
            todo, done = todo[left > 8], done + 8
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def same(raw: np.ndarray, eights: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words ``a[i]`` and ``b[i]`` have the same bytes."""
    size = ends - starts
    alike = size[a] == size[b]
    for i in np.flatnonzero(alike & (size[a] > _LONG)).tolist():
        alike[i] = np.array_equal(raw[starts[a[i]] : ends[a[i]]], raw[starts[b[i]] : ends[b[i]]])
    todo, done = np.flatnonzero(alike & (size[a] <= _LONG)), 0
    while len(todo):
        left = size[a[todo]] - done
        mask = _MASK[np.minimum(left, 8)]
        equal = (eights[starts[a[todo]] + done] ^ eights[starts[b[todo]] + done]) & mask == 0
        alike[todo[~equal]] = False
        todo, done = todo[equal & (left > 8)], done + 8
    return alike


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct words of each text: hashes are sorted within their text, and neighbours of equal hashes compared byte by byte.

    Where different words share a hash, the text is counted again from its words."""
    eights = blocks(raw)
    own = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    key = own << np.uint64(40) | hashes(raw, eights, starts, ends) >> np.uint64(24)
    order = np.argsort(key)
    key = key[order]
    twice = np.flatnonzero(key[1:] == key[:-1])
    alike = same(raw, eights, starts, ends, order[twice], order[twice + 1])
    out = counts - np.bincount(own[order[twice]].astype(np.int64), minlength=len(counts))
    begin = np.cumsum(counts) - counts
    for i in np.unique(own[order[twice[~alike]]].astype(np.int64)).tolist():
        out[i] = len({raw[starts[w] : ends[w]].tobytes() for w in range(begin[i], begin[i] + counts[i])})
    return out
