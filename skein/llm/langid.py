"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. A word's probability is the sum over all its
segmentations into pieces, which a forward pass computes; a text's is the product over its words. Piece probabilities
are learned by expectation maximisation with the matching backward pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import id_bucket, with_fields
from skein.llm.textbatch import code_points, filled, slices, split_words, sum_by_text

MARK = "▁"  # the vocabulary's sign for the start of a word
UNDETERMINED = "und"
FIT_WORDS = 2_500
SCHEMA = "lang_pred string, score double"
_LETTER = regex.compile(r"\p{L}")


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i))]


@dataclass
class Trie:
    """Prefix tree of the pieces as sorted arrays: ``keys`` holds state << 21 | code point."""

    n_pieces: int
    keys: np.ndarray
    targets: np.ndarray
    piece_at: np.ndarray
    depth: int

    @staticmethod
    def build(pieces: list[str]) -> Trie:
        step: dict[int, int] = {}
        piece_at = [-1]
        for i, p in enumerate(pieces):
            s = 0
            for c in p:
                key = s << 21 | ord(c)
                if key not in step:
                    step[key] = len(piece_at)
                    piece_at.append(-1)
                s = step[key]
            piece_at[s] = i
        keys = np.array(sorted(step), np.int64)
        return Trie(len(pieces), keys, np.array([step[k] for k in keys.tolist()], np.int64), np.array(piece_at, np.int64), max(map(len, pieces), default=1))

    def matches(self, chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (as positions in ``chars``) and piece of every piece that fits inside a word.

        A character that is no piece alone gets the unknown piece, numbered ``n_pieces``, so a segmentation exists.
        """
        n = len(chars)
        ends = np.repeat(at[1:], np.diff(at))
        pos, state = np.arange(n), np.zeros(n, np.int64)
        starts, stops, pieces = [], [], []
        for d in range(self.depth):
            key = state << 21 | chars[pos + d]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[k] == key
            nxt = np.where(ok, self.targets[k], 0)
            piece = np.where(ok, self.piece_at[nxt], -1)
            if d == 0:
                piece = np.where(piece < 0, self.n_pieces, piece)
            hit = piece >= 0
            starts.append(pos[hit])
            stops.append(pos[hit] + d + 1)
            pieces.append(piece[hit])
            go = ok & (pos + d + 1 < ends[pos])
            pos, state = pos[go], nxt[go]
            if not len(pos):
                break
        return np.concatenate(starts), np.concatenate(stops), np.concatenate(pieces)


@dataclass
class Lattice:
    """All segmentations of a set of words. Word w owns boundaries ``base[w]`` to ``base[w] + length[w]``."""

    base: np.ndarray
    length: np.ndarray
    frm: np.ndarray
    to: np.ndarray
    piece: np.ndarray
    level: np.ndarray  # matches sorted by end within the word; level[t] is where those ending at t begin

    @staticmethod
    def build(trie: Trie, words: pa.Array) -> Lattice:
        chars, at = code_points(words, MARK)
        length = np.diff(at)
        base = at[:-1] + np.arange(len(length))
        word = np.repeat(np.arange(len(length)), length)
        s, e, p = trie.matches(chars, at)
        w = word[s]
        t = e - at[w]
        order = np.lexsort((e, t))
        s, e, p, w, t = s[order], e[order], p[order], w[order], t[order]
        level = np.searchsorted(t, np.arange(int(length.max(initial=0)) + 2))
        return Lattice(base, length, s + w, e + w, p, level)

    def forward(self, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each boundary's prefix per language, and log probability of each word.

        Every 16 characters the live boundaries of words that got very small are scaled up, so no length underflows;
        the boundary values are then only good for the word's own total.
        """
        n_lang = prob.shape[1]
        alpha = np.zeros((int(self.base[-1] + self.length[-1]) + 1 if len(self.base) else 0, n_lang))
        alpha[self.base] = 1.0
        logs = np.zeros((len(self.base), n_lang))
        word_of = np.repeat(np.arange(len(self.base)), self.length + 1)
        for t in range(1, len(self.level) - 1):
            a, b = self.level[t], self.level[t + 1]
            if a == b:
                continue
            ends = self.to[a:b]
            first = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
            alpha[ends[first]] = np.add.reduceat(alpha[self.frm[a:b]] * prob[self.piece[a:b]], first, axis=0)
            if t % 16 == 0:
                at = ends[first]
                small = alpha[at].min(axis=1) < 1e-60
                at = at[small]
                if len(at):
                    scale = np.maximum(alpha[at], 1e-290)
                    for d in range(16):
                        alpha[at - d] /= scale
                    logs[word_of[at]] += np.log(scale)
        final = np.maximum(alpha[self.base + self.length], 1e-300)
        return alpha, np.log(final) + logs

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece per language over words that occur ``weight`` (word by language) times.

        Every segmentation of a word covers all its characters, so a factor for each character leaves the shares of the
        segmentations as they are; it is chosen so that the word's total is 1, and no value under- or overflows.
        """
        _, logs = self.forward(prob)
        word_of = np.repeat(np.arange(len(self.base)), self.length + 1)
        w = word_of[self.to]
        edge = prob[self.piece] * np.exp(-(logs / np.maximum(self.length, 1)[:, None])[w] * (self.to - self.frm)[:, None])
        alpha = np.zeros((len(word_of), prob.shape[1]))
        alpha[self.base] = 1.0
        beta = np.zeros_like(alpha)
        beta[self.base + self.length] = 1.0
        for t in range(1, len(self.level) - 1):
            a, b = self.level[t], self.level[t + 1]
            if a < b:
                np.add.at(alpha, self.to[a:b], alpha[self.frm[a:b]] * edge[a:b])
        for t in range(len(self.level) - 2, 0, -1):
            a, b = self.level[t], self.level[t + 1]
            if a < b:
                np.add.at(beta, self.frm[a:b], beta[self.to[a:b]] * edge[a:b])
        total = alpha[self.base + self.length]
        out = np.zeros_like(prob)
        for k in range(prob.shape[1]):
            use = alpha[self.frm, k] * edge[:, k] * beta[self.to, k] / total[w, k] * weight[w, k]
            out[:, k] = np.bincount(self.piece, weights=use, minlength=len(out))
        return out


@dataclass
class LanguageModel:
    """Piece probabilities per language; ``prob[-1]`` is the unknown character's."""

    langs: list[str]
    trie: Trie
    prob: np.ndarray
    cache: dict = field(default_factory=dict)
    rows: np.ndarray | None = None

    BLOCK = 8192
    CACHE_WORDS = 100_000  # a bound on memory: further words are computed each time

    def word_logs(self, words: pa.Array) -> np.ndarray:
        """Log probability of each distinct word, per language."""
        if self.rows is None:
            self.rows = np.zeros((self.CACHE_WORDS, len(self.langs)))
        text = words.to_pylist()
        known = np.fromiter((self.cache.get(w, -1) for w in text), np.int64, len(text))
        out = np.empty((len(text), len(self.langs)))
        out[known >= 0] = self.rows[known[known >= 0]]
        new = np.flatnonzero(known < 0)
        if len(new):
            for a in range(0, len(new), self.BLOCK):  # a lattice holds some words at a time
                some = new[a : a + self.BLOCK]
                _, out[some] = Lattice.build(self.trie, words.take(pa.array(some))).forward(self.prob)
            for j in new[: self.CACHE_WORDS - len(self.cache)].tolist():
                self.rows[len(self.cache)] = out[j]
                self.cache[text[j]] = len(self.cache)
        return out

    def with_background(self) -> LanguageModel:
        """The same with a last, nameless language in which all pieces are equally likely: what a text is held against."""
        flat = np.full((len(self.prob), 1), 1.0 / len(self.prob))
        return LanguageModel([*self.langs, ""], self.trie, np.hstack([self.prob[:, : len(self.langs)], flat]))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Most likely language, its posterior and the evidence for it for each whole text; ``und``, 0 and 0 without a letter.

        The evidence is the log likelihood ratio of that language to the background; 0 for a model without one.
        """
        words, index, counts = split_words(texts)
        if not self.langs or self.langs == [""]:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        logs = sum_by_text(self.word_logs(words)[index], counts) if len(words) else np.zeros((len(texts), len(self.langs)))
        flat = logs[:, -1] if self.langs[-1] == "" else None
        logs = logs if flat is None else logs[:, :-1]
        best = logs.argmax(axis=1)
        top = logs[np.arange(len(best)), best]
        score = 1.0 / np.exp(logs - top[:, None]).sum(axis=1)
        letters = np.array([bool(_LETTER.search(t)) for t in filled(texts).to_pylist()], bool)
        lang = [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters, strict=True)]
        return lang, np.where(letters, score, 0.0), np.zeros(len(top)) if flat is None else np.where(letters, top - flat, 0.0)


def fit(texts: list[str], langs: list[str], pieces: list[str], rounds: int = 3, smoothing: float = 0.05, longest_word: int = 40) -> LanguageModel:
    """Expectation maximisation over the words of the given texts. Words over ``longest_word`` characters are cut into such stretches."""
    names = sorted(set(langs))
    trie = Trie.build(pieces)
    per_lang: dict[str, np.ndarray] = {}
    for k, lang in enumerate(names):
        words, index, _ = split_words(pa.array([t for t, g in zip(texts, langs, strict=True) if g == lang], pa.string()))
        for w, n in zip(words.to_pylist(), np.bincount(index, minlength=len(words)).tolist(), strict=True):
            for a in range(0, len(w), longest_word):
                per_lang.setdefault(w[a : a + longest_word], np.zeros(len(names)))[k] += n
    prob = np.full((len(pieces) + 1, max(1, len(names))), 1.0 / (len(pieces) + 1))
    words = list(per_lang)
    for _ in range(rounds if words else 0):
        uses = np.full_like(prob, smoothing)
        for a in range(0, len(words), FIT_WORDS):  # lattices of some words at a time bound the memory
            some = words[a : a + FIT_WORDS]
            uses += Lattice.build(trie, pa.array(some, pa.string())).expected(prob, np.array([per_lang[w] for w in some]))
        prob = uses / uses.sum(axis=0)
    return LanguageModel(names, trie, prob)


def fit_from(docs: DataFrame, vocabulary_path: str, max_docs_per_lang: int = 300, max_chars: int = 2_000_000, max_langs: int = 1000) -> LanguageModel:
    """Fit on a bounded sample of the labelled rows of ``docs`` (text, lang).

    The sample: in the order of a hash of the text, up to ``max_docs_per_lang`` whole texts of each of the ``max_langs``
    most frequent languages, as long as a language's stay within its even share of ``max_chars`` characters. The bounds
    are parameters; only the fit is sampled. Texts are filtered where they are read: none is shuffled but the sample's.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    cut = own.withColumn("h", F.xxhash64("text"))
    sizes = cut.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    each = max(1_000, max_chars // max(1, len(sizes)))
    if not sizes:
        return fit([], [], vocabulary(vocabulary_path))
    # a range of the hash order that surely holds enough different texts of each language; copies count once
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, int(min(1.0, 2.0 * max_docs_per_lang / r.n) * 1_000_000) + 1)])
    near = cut.where((F.pmod(F.col("h"), F.lit(1_000_000)) < share[F.col("lang")]) & (F.length("text") <= each))
    rows = near.groupBy("lang", "h").agg(F.min("text").alias("text")).toPandas().sort_values(["lang", "h"], kind="stable")
    rows = rows[rows.groupby("lang").cumcount() < max_docs_per_lang]
    rows = rows[rows["text"].str.len().groupby(rows["lang"]).cumsum() <= each]
    return fit(rows["text"].tolist(), rows["lang"].tolist(), vocabulary(vocabulary_path))


def identify(docs: DataFrame, model: LanguageModel, max_bytes: int = 1_000_000, evidence: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced).

    The whole text counts. Null, empty and letterless texts get ``und`` and 0. Equal texts get equal results. With
    ``evidence`` a column of this name (replaced too) holds how much more likely the text is in its language than by
    equally likely pieces, as a log ratio; it is negative for a text like none of the languages.
    """
    spark = docs.sparkSession
    own = LanguageModel(model.langs, model.trie, model.prob)
    held = spark.sparkContext.broadcast(own.with_background() if evidence else own)
    added = SCHEMA + ", evidence double" if evidence else SCHEMA
    new = [x.split(" ")[0] for x in added.split(", ")]
    keep = [c for c in docs.columns if c.lower() not in new]
    base = docs.select(*(F.col(f"`{c}`") for c in keep))
    schema = with_fields(base, added)
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part in slices(batch, at, max_bytes):
                lang, *numbers = model.predict(part.column(at))
                made = [pa.array(lang, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made[: len(new)]], [*keep, *new])

    return base.mapInArrow(run, schema)


def learning_rows(docs: DataFrame) -> DataFrame:
    """The documents that a held-out evaluation may learn from: crc32 of the id modulo 4 is not 2."""
    return docs.where(id_bucket("doc_id", 4) != 2)


__all__ = ["LanguageModel", "fit", "fit_from", "identify", "learning_rows", "vocabulary"]
