"""Best-fit packing of tokenized documents with certified bin counts.

Documents become token sequences, long ones are cut to full windows, and the remaining pieces are packed per partition
by best-fit decreasing. A dual-feasible-function lower bound certifies a partition whose bin count equals it. Partitions
that keep gaps hand the pieces of their open bins to an exchange, where they are packed again together.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stage
from skein.llm.textbatch import slices

END_OF_DOCUMENT = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_IDS = PIECES + ", ids array<int>"


class ByteBpe:
    """Byte-level BPE read from a ``tokenizers`` JSON file, run by tiktoken's merge loop (same ids, less CPU).

    Strings of added special tokens in a text become their ids, as ``Tokenizer.encode`` does by default.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {bytes(byte_of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=split, mergeable_ranks=vocab, special_tokens=self.special)
        self.blanks = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)

    def ids(self, text: str) -> np.ndarray:
        """Token ids of a whole text of any length."""
        try:
            return self._encode(text) if text else np.zeros(0, np.uint32)
        except ValueError:  # the pattern gives up on a very long run of blanks: these are cut out first
            return self._ids_around_blanks(text)

    def _ids_around_blanks(self, text: str) -> np.ndarray:
        """A run of blanks is one pre-token, without its last blank where a character that is none follows."""
        parts, done = [], 0
        for run in self.blanks.finditer(text):
            a, b = run.span()
            if b < len(text) and not any(text.startswith(x, b) for x in self.special):
                b -= 1
            parts.append(self._encode(text[done:a]))
            parts.append(np.array(self.encoding._encode_single_piece(text[a:b]), np.uint32))
            done = b
        return np.concatenate([*parts, self._encode(text[done:])])


def piece_starts(n: int, size: int) -> list[int]:
    """Starts of the pieces of ``n`` tokens: only a first piece is shorter than ``size``."""
    first = n % size or min(n, size)
    return [0, *range(first, n, size)]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document: ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``.

    Null and empty texts give one piece that holds the end token alone. Repeated rows give repeated pieces.
    """
    held: list[ByteBpe] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(ByteBpe(tokenizer_path))
        bpe = held[0]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        n = 6 if with_ids else 5
        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                cols: list[list] = [[] for _ in names]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.append(bpe.ids(text.as_py() or ""), np.uint32(END_OF_DOCUMENT)).astype("<u4")
                    starts = piece_starts(len(ids), max_tokens)
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        for c, v in zip(cols, (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int32) if with_ids else None), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], types[:n], strict=True)], names[:n])

    own = docs.select(F.col("doc_id").cast("long"), "text")
    return own.mapInArrow(run, PIECES_IDS if with_ids else PIECES)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of each item and the number of bins. Ties go to the earlier item and the earlier bin."""
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    mask, n = 0, 0  # bit r: some bin has r free
    for i in order.tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            b, n, r = n, n + 1, capacity
        out[i] = b
        if r > s:
            room[r - s].append(b)
            mask |= 1 << (r - s)
    return out, n


def dual_feasible_bound(sizes: np.ndarray, capacity: int) -> int:
    """Largest of the lower bounds that three families of dual feasible functions give.

    The families: the identity (total size), Martello and Toth's thresholds, and the rounding functions u(k).
    """
    if not len(sizes):
        return 0
    c = capacity
    count = np.bincount(sizes, minlength=c + 1)[: c + 1].astype(np.int64)
    total = count * np.arange(c + 1)
    n_upto, s_upto = np.cumsum(count), np.cumsum(total)
    best = math.ceil(int(s_upto[c]) / c)
    half = c // 2
    for a in range(half + 1):
        large = int(n_upto[c] - n_upto[c - a])
        mid_n = int(n_upto[c - a] - n_upto[half])
        mid_s = int(s_upto[c - a] - s_upto[half])
        small = int(s_upto[half] - (s_upto[a - 1] if a else 0))
        best = max(best, large + mid_n + max(0, math.ceil((small - (mid_n * c - mid_s)) / c)))
    x = np.arange(c + 1)
    for k in range(1, 24):
        even = (x * (k + 1)) % c == 0
        value = np.where(even, x * k, (x * (k + 1)) // c * c)  # times 1 / (k c)
        best = max(best, math.ceil(int((count * value).sum()) / (k * c)))
    return best


def _pack_group(capacity: int, shift: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy(np.int64)
        bins, n = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
        certified = n == dual_feasible_bound(sizes, capacity)
        open_bins = fill < capacity
        if certified:  # then only the emptiest bin can still gain from an exchange
            emptiest = int(np.argmin(fill))
            open_bins = (np.arange(n) == emptiest) & open_bins
        order = np.lexsort((np.arange(len(bins)), bins))
        ordered = bins[order]
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, ordered[1:] != ordered[:-1]]
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        pdf["bin"] = bins + (int(pdf["part"].iloc[0]) << 32) + (shift << 56)
        pdf["offset"] = offset
        pdf["gap"] = open_bins[bins]
        pdf["certified"] = certified
        return pdf[["uid", "length", "bin", "offset", "gap", "certified"]]

    return run


def pack_pieces(pieces: DataFrame, max_tokens: int = 1024, pieces_per_partition: int = 65536, rounds: int = 3) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``max_tokens``.

    Pieces of full length fill a sequence each. The others are dealt by row number, so copies and repeated ids can't
    gather in one task. Every round packs anew what partitions with gaps gave up and is kept where it needs fewer
    sequences than before; a bound on ``pieces_per_partition`` is a bound on a task's memory. Other columns are kept.
    """
    spark = pieces.sparkSession
    table = stage(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = table.where(F.col("length") >= max_tokens).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    full = full.withColumn("sequence_id", -F.col("sequence_id") - 1)
    todo = table.where(F.col("length") < max_tokens).select("uid", "length")
    schema = "uid long, length long, bin long, offset long, gap boolean, certified boolean"
    settled = []
    left = todo.count()
    held = None
    for k in range(rounds):
        parts = max(1, math.ceil(left / pieces_per_partition))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(parts)))
        now = stage(dealt.groupBy("part").applyInPandas(_pack_group(max_tokens, k + 1), schema), f"packed{k}")
        if held is not None:
            was = held.agg(F.countDistinct("bin")).first()[0]
            if now.agg(F.countDistinct("bin")).first()[0] >= was:
                break  # the exchange saved nothing: what was there stays
        settled.append(now.where(~F.col("gap")))
        held = now.where("gap")
        todo = held.select("uid", "length")
        left = held.count()
        if parts == 1 or not left:
            break
    if held is not None:
        settled.append(held)
    placed = settled[0]
    for s in settled[1:]:
        placed = placed.unionByName(s)
    placed = placed.select("uid", F.col("bin").alias("sequence_id"), "offset").unionByName(full)
    return table.join(placed, "uid").drop("uid")


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 1024, with_ids: bool = False) -> DataFrame:
    """Tokenize and pack whole documents; one row per piece with its place in a sequence."""
    return pack_pieces(tokenize_pieces(docs, tokenizer_path, max_tokens, with_ids), max_tokens)


def assemble_sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the token sequences themselves, from ``pack_documents(..., with_ids=True)``.

    A group holds at most one sequence's tokens.
    """
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
