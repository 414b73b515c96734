"""Porter's stemming algorithm (M. F. Porter, 1980), applied to the distinct words of Arrow batches."""

from __future__ import annotations

import functools

import pandas as pd
import pyarrow as pa
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

#: The algorithm's endings and what replaces them, by step.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """``c`` or ``v`` for each letter; y is a vowel behind a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(stem).count("vc")


def _cvc(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    end = _longest(w, ("ed", "ing"))
    if not end or "v" not in _shape(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if _measure(w) == 1 and _cvc(w) else w


def _replace(w: str, pairs) -> str:
    end = _longest(w, [a for a, _ in pairs])
    if end and _measure(w[: -len(end)]):
        return w[: -len(end)] + dict(pairs)[end]
    return w


def _drop(w: str) -> str:
    end = _longest(w, STEP_4)
    if not end:
        return w
    stem = w[: -len(end)]
    return stem if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")) else w


def _last(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _cvc(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@functools.lru_cache(1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case English word; words of under three letters, and all but a-z, stay as they are."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = _past(_plural(word))
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    return _last(_drop(_replace(_replace(w, STEP_2), STEP_3)))


@pandas_udf(ArrayType(StringType()))
def stem_all(tokens: pd.Series) -> pd.Series:
    """The stems of every list of tokens, each distinct word of a batch worked out once."""
    lists = pa.array(tokens, pa.list_(pa.string()))
    coded = lists.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    at = pa.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum(), pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), at])
    return pd.Series(pa.ListArray.from_arrays(offsets, stems).to_pandas())
