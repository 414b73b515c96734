"""Repeated word windows found by super-k-mers.

A window's minimiser is the smallest hash of the ``GRAM`` consecutive words inside it (the leftmost of equal ones).
Consecutive windows whose minimiser is at the same place travel as one packed string, a super-k-mer, to the bucket of that
minimiser. Equal windows have equal minimisers, so they meet in one bucket, where windows are named exactly by sorting and
all but the first of a name are repeats.

Two things keep buckets small, whatever repeats. Equal strings of one slice of documents are sent once, for the first of
them. And the windows of minimisers that hold a noticeable share of all rows travel one by one, dealt by their own words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import wordscan
from skein.llm.common import discard, stage, with_fields
from skein.llm.shingles import mix
from skein.llm.textbatch import flat_bytes, slices

GRAM = 4
SLICE_BYTES = 3_000_000
PIECE = 400_000  # windows worked on together: bounds what a very long text needs
HOT_SHARE = 1 / 1024  # of all super-k-mers
GROUP_ROWS = 50_000  # of one bucket key that are sorted in memory; more go window by window
SAMPLE = 8000  # strings that the compression dictionary is made from
LAST = (1 << 63) - 1

_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a slice of texts, their separators made single blanks."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        starts, ends, self.counts = wordscan.spans(raw, at)
        self.hash = wordscan.hashes(raw, wordscan.blocks(raw), starts, ends)
        size = ends - starts
        self.starts = np.cumsum(size + 1) - size - 1
        self.ends = self.starts + size
        self.raw = np.full(self.ends[-1] + 1 if len(size) else 0, 32, np.uint8)
        inside = np.zeros(len(raw) + 1, np.int8)  # words of two texts may touch
        inside[starts] += 1
        inside[ends] -= 1
        out = np.zeros(len(self.raw) + 1, np.int8)
        out[self.starts] += 1
        out[self.ends] -= 1
        self.raw[np.cumsum(out[:-1], dtype=np.int8).astype(bool)] = raw[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        self.begin = np.cumsum(self.counts) - self.counts  # of each text


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each word on."""
    acc = np.zeros(max(0, len(h) - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = mix(acc * _STEP + h[j : j + len(acc)])
    return acc


def _windows(words: Words, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Super-k-mers by pieces: first window, number of windows, and minimiser hash of each."""
    k = min(GRAM, window)
    left = np.repeat(words.begin + words.counts, words.counts) - np.arange(len(words.hash))  # words up to the text's end
    for a in range(0, len(words.hash), PIECE):
        part = words.hash[a : a + PIECE + window - 1]
        gram = _grams(part, k)
        n, w = len(part) - window + 1, window - k + 1
        if n <= 0:
            return
        low = (gram >> np.uint64(32) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64)
        reach = 1
        while 2 * reach <= w:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[:n], low[w - reach : w - reach + n])
        spot = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.flatnonzero(left[a : a + n] >= window)
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (spot[at[1:]] != spot[at[:-1]])
        first = np.flatnonzero(new)
        yield a + at[first], np.diff(np.r_[first, len(at)]), gram[spot[at[first]]]


def _strings(words: Words, first: np.ndarray, n_words: np.ndarray) -> pa.Array:
    """Runs of words as text, one blank between words."""
    a, b = words.starts[first], words.ends[first + n_words - 1]
    at = np.r_[0, np.cumsum(b - a)]
    out = np.empty(at[-1], np.uint8)
    i = 0
    while i < len(a):  # some MB at a time
        j = max(i + 1, int(np.searchsorted(at, at[i] + 1_000_000)) - 1)
        size = (b - a)[i:j]
        out[at[i] : at[j]] = words.raw[np.repeat(a[i:j] - (at[i:j] - at[i]), size) + np.arange(at[j] - at[i])]
        i = j
    return pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out))


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by ``keys``, the most important first."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), np.int64)
    for key in keys:
        step[1:] |= key[order[1:]] != key[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in slices(batch, 2, SLICE_BYTES):
            yield Words(*flat_bytes(part.column(2))), np.asarray(part.column(0)), np.asarray(part.column(1))


def _frequent(window: int):
    """The minimisers of a task that hold a noticeable share of its super-k-mers, and ``h`` null: how many it has. Rows of
    ``s`` are a few of its strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        counts: dict[int, int] = {}
        sample: list[str] = []
        total = 0

        def count() -> None:  # of the rare none is kept: a key loses at most an eighth of the share
            h = np.concatenate(held)
            u, n = np.unique(h, return_counts=True)
            often = n > len(h) * HOT_SHARE / 8
            for key, k in zip(u[often].view(np.int64).tolist(), n[often].tolist(), strict=True):
                counts[key] = counts.get(key, 0) + k
            held.clear()

        for words, _, _ in _slices(batches):
            for first, n, h in _windows(words, window):
                total += len(h)
                held.append(h)
                if not sample:
                    some = np.linspace(0, len(h) - 1, min(len(h), 200)).astype(np.int64)
                    sample = _strings(words, first[some], n[some] + window - 1).to_pylist()
                if sum(map(len, held)) > 1 << 19:
                    count()
        if held:
            count()
        if total:
            h, n = [None, *counts, *(None for _ in sample)], [total, *counts.values(), *(0 for _ in sample)]
            s = [*(None for _ in range(len(counts) + 1)), *sample]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.string())], ["h", "n", "s"])

    return run


def survey(texts: DataFrame, window: int) -> tuple[np.ndarray, bytes]:
    """Minimisers that hold over ``HOT_SHARE`` of all super-k-mers, at most 1 / ``HOT_SHARE`` of them, sorted; and a
    compression dictionary made from ``SAMPLE`` strings. They decide how rows are dealt out and packed, never what is found."""
    seen = stage(texts.mapInArrow(_frequent(window), "h long, n long, s string"), "survey")
    counts = seen.where("s IS NULL").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.col("h").isNull().desc(), F.col("n").desc()).limit(1 + int(1 / HOT_SHARE)).collect()
    total = sum(r.n for r in rows if r.h is None)
    hot = np.sort(np.array([r.h for r in rows if r.h is not None and r.n > total * HOT_SHARE], np.int64).view(np.uint64))
    sample = [r.s.encode() for r in seen.where("s IS NOT NULL").select("s").limit(SAMPLE).collect()]
    discard(seen)
    try:
        return hot, zstandard.train_dictionary(1 << 16, sample, level=1).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform: then without
        return hot, b""


class Packer:
    """Strings compressed one by one with a dictionary."""

    def __init__(self, dictionary: bytes):
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if known:
            known.precompute_compress(level=1)
        self._pack = zstandard.ZstdCompressor(level=1, dict_data=known, write_dict_id=False, write_checksum=False).compress
        self._unpack = zstandard.ZstdDecompressor(dict_data=known).decompress

    def pack(self, strings: pa.Array) -> pa.Array:
        return pa.array([self._pack(x) for x in strings.cast(pa.large_binary()).to_pylist()], pa.binary())

    def unpack(self, packed: pa.Array) -> pa.Array:
        return pa.array([self._unpack(x) for x in packed.to_pylist()], pa.binary()).cast(pa.string())


def _single(words: Words, first: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of super-k-mers one by one: where they begin, and hashes of their words."""
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    acc = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(window):
            acc = mix(acc * _STEP + words.hash[at + j])
    return at, acc


def _deal(window: int, hot: np.ndarray, dictionary: bytes):
    """Rows for the buckets: ``h`` the key, ``doc, th, a`` where the string's first window is, ``n`` windows, ``s`` the packed string.
    Strings that occur earlier in the same slice aren't sent: their windows come as rows without a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(dictionary)
        for words, doc, th in _slices(batches):
            own = np.repeat(np.arange(len(words.counts)), words.counts)
            for first, n, h in _windows(words, window):
                if len(hot):
                    place = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    often = hot[place] == h
                    at, key = _single(words, first[often], n[often], window)
                    first, n, h = np.r_[first[~often], at], np.r_[n[~often], np.ones(len(at), np.int64)], np.r_[h[~often], key]
                text = own[first]
                a = first - words.begin[text]
                strings = _strings(words, first, n + window - 1)
                code = strings.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                rank = _ranks(doc[text], th[text], a)
                least = np.full(code.max() + 1, len(rank), np.int64)
                np.minimum.at(least, code, rank)
                send = least[code] == rank
                # a document that is there twice sends its strings once
                sent = np.flatnonzero(send)
                sent = sent[np.unique(code[sent], return_index=True)[1]]
                yield _rows(h[sent], doc[text[sent]], th[text[sent]], a[sent], n[sent], packer.pack(strings.take(pa.array(sent))))
                late = np.flatnonzero(~send)
                if len(late):
                    late = late[np.lexsort((a[late], text[late]))]
                    x, y, z = text[late], a[late], n[late]
                    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1] + z[:-1])]
                    at = np.flatnonzero(new)
                    runs = np.add.reduceat(z, at)
                    key = mix(th[x[at]].view(np.uint64) + y[at].astype(np.uint64))
                    yield _rows(key, doc[x[at]], th[x[at]], y[at], runs, pa.nulls(len(at), pa.binary()))

    return run


def _rows(h, doc, th, a, n, s) -> pa.RecordBatch:
    columns = [pa.array(h.view(np.int64)), pa.array(doc), pa.array(th), pa.array(a), pa.array(n), s]
    return pa.RecordBatch.from_arrays(columns, ["h", "doc", "th", "a", "n", "s"])


def window_names(strings: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """An exact number for every window of every string, in order, and the windows of each string: equal numbers are equal
    words in equal order. Words are numbered by a dictionary; runs of two, four and more words by sorting pairs of numbers."""
    lists = pc.split_pattern(strings, " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    name = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(counts.sum())
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        pair = name[:-step] * (name.max() + 1) + name[step:]
        name = np.unique(pair, return_inverse=True)[1]
        reach += step
    return name[left[: len(name)] >= window], counts - window + 1


_FOUND = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("a", pa.int64()), ("n", pa.int64()), ("s", pa.string())])


def _first_only(rows: pa.Table, packer: Packer, window: int) -> pa.RecordBatch:
    """Windows of whole bucket keys that occur earlier, as runs ``doc, th, a, n``."""
    name, n = window_names(packer.unpack(rows.column("s")), window)
    doc, th, a = (rows.column(c).to_numpy() for c in ("doc", "th", "a"))
    row = np.repeat(np.arange(len(doc)), n)
    rank = _ranks(doc, th, a)[row]
    least = np.full(name.max() + 1, len(doc), np.int64)
    np.minimum.at(least, name, rank)
    late = least[name] != rank
    i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.flatnonzero(late & np.r_[True, ~late[:-1] | (i[1:] == 0)])
    end = np.flatnonzero(late & np.r_[~late[1:] | (i[1:] == 0), True])
    at = row[begin]
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(th[at]), pa.array(a[at] + i[begin]), pa.array(end - begin + 1), pa.nulls(len(at), pa.string())], schema=_FOUND)


def _open(rows: pa.RecordBatch, packer: Packer, window: int) -> Iterator[pa.RecordBatch]:
    """The windows of rows of a key that has too many, one by one with their words."""
    for at in range(0, rows.num_rows, 2000):
        out = []
        part = rows.slice(at, 2000)
        for r, s in zip(part.drop_columns("s").to_pylist(), packer.unpack(part.column("s")).to_pylist(), strict=True):
            w = s.split(" ")
            out += [{"doc": r["doc"], "th": r["th"], "a": r["a"] + i, "n": 1, "s": " ".join(w[i : i + window])} for i in range(len(w) - window + 1)]
        yield pa.RecordBatch.from_pylist(out, _FOUND)


def _buckets(window: int, group_rows: int, dictionary: bytes):
    """Repeats among rows that come sorted by key, some whole keys at a time."""

    def done(parts: list[pa.RecordBatch], packer: Packer) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        h = rows.column("h").to_numpy()
        again = np.r_[False, h[1:] == h[:-1]]
        several = again | np.r_[again[1:], False]  # a single string repeats none of its windows
        if several.any():
            yield _first_only(rows.filter(pa.array(several)), packer, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held = Packer(dictionary), []
        key, wide = None, False  # of the rows that are held; whether the last key had too many
        for batch in batches:
            passed = pc.is_null(batch.column("s"))
            if passed.true_count:
                some = batch.filter(passed)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in _FOUND.names[:-1]), pa.nulls(some.num_rows, pa.string())], schema=_FOUND)
                batch = batch.filter(pc.invert(passed))
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            if wide:
                same = int(np.searchsorted(h != key, True))
                yield from _open(batch.slice(0, same), packer, window)
                batch, h = batch.slice(same), h[same:]
                if not len(h):
                    continue
                wide = False
            last = int(np.searchsorted(h == h[-1], True))  # where the rows of the last key begin: more may come
            if last or (held and key != h[-1]):
                yield from done([*held, batch.slice(0, last)], packer)
                held = []
            held.append(batch.slice(last))
            key = h[-1]
            if sum(x.num_rows for x in held) > group_rows:
                for part in held:
                    yield from _open(part, packer, window)
                held, wide = [], True
        if held:
            yield from done(held, packer)

    return run


def repeated_windows(texts: DataFrame, window: int = 20, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc, th, a, n``: runs of ``n`` windows of ``window`` words, from word ``a`` on, each of which occurs earlier.

    ``texts`` has ``doc`` and ``th`` (longs, which name and order the documents) and ``text``, none of them null."""
    hot, dictionary = survey(texts, window)
    sent = texts.mapInArrow(_deal(window, hot, dictionary), "h long, doc long, th long, a long, n long, s binary")
    dealt = sent.repartition("h").sortWithinPartitions("h")
    found = stage(dealt.mapInArrow(_buckets(window, group_rows, dictionary), "doc long, th long, a long, n long, s string"), "repeats")
    wide = found.where("s IS NOT NULL")
    place = F.struct("doc", "th", "a")
    first = wide.groupBy("s").agg(F.min(place).alias("f"))
    late = wide.join(first, "s").where(place != F.col("f")).drop("f")
    return found.where("s IS NULL").drop("s").unionByName(late.drop("s"))


def _cut(text_at: int, names: list[str], window: int):
    """Texts without the words that the runs ``w`` cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_at, SLICE_BYTES):
                words = Words(*flat_bytes(part.column(text_at)))
                lists = part.column(text_at + 1)
                per = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
                flat = lists.flatten()
                a = np.asarray(flat.field("a")) + np.repeat(words.begin, per)
                total = len(words.hash)
                edge = np.bincount(a, minlength=total + 1) - np.bincount(a + np.asarray(flat.field("n")) + window - 1, minlength=total + 1)
                gone = np.cumsum(edge)[:total] > 0
                own = np.repeat(np.arange(len(per)), words.counts)
                kept = np.flatnonzero(~gone)
                size = words.ends[kept] - words.starts[kept] + 1  # with a blank behind
                stay = np.zeros(len(words.raw) + 1, np.int8)
                stay[words.starts[kept]] += 1
                stay[words.ends[kept] + 1] -= 1
                ends = np.cumsum(np.bincount(own[kept], weights=size, minlength=len(per)).astype(np.int64))
                data = words.raw[np.cumsum(stay[:-1], dtype=np.int8).astype(bool)]
                some = np.diff(np.r_[0, ends]) > 0
                mask = np.ones(len(data), bool)
                mask[ends[some] - 1] = False  # no blank behind a text's last word
                at = np.r_[0, ends - np.cumsum(some)]
                text = pa.LargeStringArray.from_buffers(len(per), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[mask])).cast(pa.string())
                removed = words.counts - np.bincount(own[kept], minlength=len(per))
                yield pa.RecordBatch.from_arrays([*part.columns[:text_at], pa.array(words.counts), pa.array(removed), text], names)

    return run


def remove_repeats(docs: DataFrame, window: int = 20, group_rows: int = GROUP_ROWS) -> DataFrame:
    """All columns of ``docs`` with ``n_words, n_removed`` and ``kept_text``, in place of columns of these names.

    Words are the runs of ``[^\\x20\\x09-\\x0D]`` of each whole text, as they stand. A word goes if a window of ``window``
    words that covers it also starts earlier: in a document of smaller ``doc_id`` (null ids last, then by a hash of the
    text), or earlier in the same. Windows are judged on the input; overlaps count. ``kept_text`` are the other words with a
    blank between them. Null texts and texts without words have none, texts of under ``window`` words stay whole. Rows that
    repeat id and text are one document, and each gets its result. An empty table stays empty.
    """
    added = ["n_words", "n_removed", "kept_text"]
    names = [c for c in docs.columns if c not in added]
    own = [f"_{i}" for i in range(len(names))]  # the given names may clash with ours
    th = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(1), "text")).otherwise(F.xxhash64("text"))
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), th.alias("th"), F.coalesce(F.col("text"), F.lit("")).alias("text")]
    texts = docs.select(*keys).where(F.octet_length("text") >= 2 * window - 1)
    runs = repeated_windows(texts, window, group_rows).groupBy("doc", "th").agg(F.collect_list(F.struct("a", "n")).alias("w"))
    keyed = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)), *(k.alias(f"key_{i}") for i, k in enumerate(keys)))
    both = keyed.join(stage(runs, "runs"), (F.col("key_0") == F.col("doc")) & (F.col("key_1") == F.col("th")), "left")
    schema = with_fields(docs.select(*(F.col(f"`{c}`") for c in names)), "n_words long, n_removed long, kept_text string")
    return both.select(*own, "key_2", "w").mapInArrow(_cut(len(names), schema.names, window), schema)
