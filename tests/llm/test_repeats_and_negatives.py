"""Operators 11 to 13 against brute force, and the rows they must take without failing."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import filter_audit, hard_negatives, superkmer, wordscan
from skein.llm.textbatch import flat_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NULL_LAST = 1 << 63


def words(text):
    return WORD.findall(text or "")


def kept_by_brute_force(rows, window):
    """What each (doc_id, text) keeps, windows met in the order of id, then of the place."""
    docs = sorted(set(rows), key=lambda r: (NULL_LAST if r[0] is None else r[0]))
    assert len({d for d, _ in docs}) == len(docs)
    seen, out = set(), {}
    for doc, text in docs:
        w, gone = words(text), set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out[doc] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def passages():
    rng = random.Random(5)
    word = lambda: rng.choice("the of and a ab Ab é 漢字 \x00z x-y".split(" ")) + str(rng.randrange(40))
    shared = [" ".join(word() for _ in range(n)) for n in (19, 20, 21, 45, 90)]
    texts = [None, "", " \t\n", "one", " ".join("a" for _ in range(70)), "a b " * 60, "\x0b".join(shared[3].split(" ")), shared[0], shared[1], shared[1] + " "]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(30))) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(shared))
        texts.append(rng.choice(["  ", "\n", " "]).join(parts))
    texts += [shared[4]] * 5 + texts[20:30]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [(i * 3 - 50, t) for i, t in rows] + [(None, texts[25])]


@pytest.mark.parametrize("group_rows", [50_000, 3])
def test_word_windows_against_brute_force(spark, monkeypatch, group_rows):
    rows = passages()
    docs = spark.createDataFrame([*rows, rows[3], rows[12]], "doc_id long, text string").repartition(5)
    for share in (1 / 1024, 1 / 50):
        monkeypatch.setattr(superkmer, "HOT_SHARE", share)
        got = superkmer.remove_repeats(docs, 20, group_rows).collect()
        want = kept_by_brute_force(rows, 20)
        assert len(got) == len(rows) + 2
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want


def test_short_windows_and_clashing_columns(spark):
    rows = [(1, "a b c a b c d"), (2, "b c d e"), (3, "c"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("doc", "th", "a.b", "key_0", "w", "s", "_0", "kept"):
        docs = docs.withColumn(c, F.lit(c))
    got = superkmer.remove_repeats(docs.withColumn("n_words", F.lit("old")), 2)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept_text"]
    assert {r.doc_id: r.kept_text for r in got.collect()} == {i: k[2] for i, k in kept_by_brute_force(rows, 2).items()}
    assert all(r["a.b"] == "a.b" and r["_0"] == "_0" and r["doc"] == "doc" for r in got.collect())
    assert superkmer.remove_repeats(docs.limit(0), 20).collect() == []


def test_very_long_texts(spark):
    rng = random.Random(1)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(500_000))
    docs = spark.createDataFrame([(1, long), (2, long[1000:2_500_000]), (3, "x" * 2_000_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in superkmer.remove_repeats(docs).select("doc_id", "n_words", "n_removed").collect()}
    n = len(long[1000:2_500_000].split())
    assert got[1] == (500_000, 0) and got[3] == (1, 0) and got[2][0] == n and got[2][1] >= n - 2


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    texts = ["a A a", "", "  ", "abcdefgh abcdefghi abcdefgh\x00 abcdefgh", "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + "y", "é e é"]
    raw, at = flat_bytes(pa.array(texts))
    starts, ends, counts = wordscan.spans(raw, at)
    want = [len(set(words(t))) for t in texts]
    assert wordscan.distinct(raw, starts, ends, counts).tolist() == want and counts.tolist() == [len(words(t)) for t in texts]
    monkeypatch.setattr(wordscan, "hashes", lambda raw, e, s, t: np.zeros(len(s), np.uint64))  # all words share a hash
    assert wordscan.distinct(raw, starts, ends, counts).tolist() == want


def audit_by_brute_force(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {lang or "" for _, _, lang in docs}:
        masks = []
        for i, text, lang in docs:
            if (lang or "") != part:
                continue
            t, w = text or "", words(text)
            same = [d for d, u, _ in docs if (u or "") == t and d is not None]
            m = {f for f, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), i is not None and min(same) < i), strict=True) if x}
            masks.append((i, m))
        rows = {}
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                now = [i for i, m in masks if f in m and not m & before]
                rows["".join(order), step] = [sum(not m & (before | {f}) for _, m in masks), len(now), sum(f in m and bool(m & before) for _, m in masks), sum(m == {f} for _, m in masks), sum(i in good for i in now), sum(i in toxic for i in now), 0]
        for order, step in rows:
            rows[order, step][6] = sum(rows[o, o.index(order[step - 1]) + 1][1] for o in map("".join, itertools.permutations("ABCDE")))
        out |= {(part, *k): v for k, v in rows.items()}
    return out


def test_filter_orders_against_brute_force(spark):
    rng = random.Random(2)
    make = lambda: " ".join(rng.choice(["Word", "w", "é", "A", "x#", "|"] + [f"v{k}" for k in range(300)]) for _ in range(rng.choice([0, 5, 99, 100, 101, 160])))
    texts = [None, "", *(make() for _ in range(40)), "AB " * 120, " ".join(f"W{i}" for i in range(120))]
    texts += texts[:8]
    docs = [(i - 10, t, rng.choice(["en", None, "", "de"])) for i, t in enumerate(texts)] + [(None, texts[4], "en"), (None, texts[4], "en"), (3, "again", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(-10, 30)] + [(3, 1, 1), (None, 1, 1)]
    tables = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("mask", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(*tables).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == audit_by_brute_force(docs, labels)
    assert len(got) == 3 * 600
    assert filter_audit.audit(tables[0].limit(0), tables[1]).collect() == []
    assert {r.good_lost for r in filter_audit.audit(tables[0], tables[1].limit(0)).collect()} == {0}


def mined_by_brute_force(rows, positives=5, negatives=10):
    out = set()
    good = [(i, lab, q) for i, lab, q in rows]
    for a, lab, q in good:
        if a % 100:
            continue
        score = lambda p, q=q: sum(x * y for x, y in zip(q, p, strict=True))
        others = sorted((-score(p), i, m) for i, m, p in good if i != a and len(p) == len(q))
        for s, pos, _ in [x for x in others if x[2] == lab][:positives]:
            hard = [(t, i) for t, i, m in others if m != lab and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out |= {(a, pos, k, i, -s, -t) for k, (t, i) in enumerate(hard, 1)}
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_hard_negatives_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "GROUP_NUMBERS", 900)
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 12))
    rows = []
    for i in range(400):
        x = base[i % 6] + rng.normal(size=12) * (0 if i % 5 == 0 else 0.7)  # many equal vectors: ties
        rows.append((int(i * 20), int(rng.integers(0, 3)) if i % 4 else 7, (x if i % 11 else x[:5]).tolist()))
    rows += [(100_000, 1, [2.0**20] * 12), (100_100, 1, [2.0**20] * 11 + [2.0**20 + 0.5]), (100_200, 2, [2.0**19] * 12), (100_300, 2, [0.0] * 12)]
    bad = [(200, None, [1.0] * 12), (None, 1, [1.0] * 12), (9_000, 1, None), (9_100, 1, [1.0, None] * 6), (9_200, 1, [float("nan")] * 12), (9_300, 1, [float("inf")] * 12), (9_400, 1, []), (9_500, 1, [1e300] * 12), (9_600, 1, [2.0**25] * 12)]
    bad = [b for b in bad if b[0] not in {r[0] for r in rows}]
    frame = spark.createDataFrame([*rows, *bad, rows[5]], "vec_id long, label int, embedding array<double>")
    vectors = hard_negatives.integer_vectors(frame)
    got = {tuple(r) for r in hard_negatives.mine(vectors, F.col("id") % 100 == 0).collect()}
    whole = [(i, lab, [int(np.floor(256 * v)) for v in x]) for i, lab, x in rows]
    assert got == mined_by_brute_force(whole)
    assert hard_negatives.mine(hard_negatives.integer_vectors(frame.limit(0)), F.col("id") % 100 == 0).collect() == []
