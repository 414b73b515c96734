"""Near duplicates, repeated passages, mixing, language and quality: against brute force and held-out rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from skein.llm import embed_dedup, langid, mixing, ngram_join, quality, queries, shingles, suffix_array
from skein.llm.textbatch import flat_bytes

SF = "/root/testdata/sf0.01"


# --- n-gram Jaccard join ------------------------------------------------------------------------------------------------


def word_shingles(text, k):
    w = [bytes(x) for x in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k, num, den):
    sets = [word_shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g] if j < i).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups: dict = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None) if sets[i] else rows[i][0]) for i in range(len(rows))]


def near_copies(n=60, words=80):
    r = np.random.default_rng(5)
    base = [f"w{x}" for x in r.integers(0, 500, words)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(int(r.integers(0, 4))):
            t[int(r.integers(0, words))] = f"n{r.integers(0, 30)}"
        rows.append((i, " ".join(t)))
    return rows


def test_shingles_match_words():
    texts = ["A b\tC\x0bd e", "", None, " \n", "É É é", "one two", "x" * 3000 + " y z w q", "a b c d a b c d"]
    sets, counts = shingles.shingle_sets(*flat_bytes(pa.array(texts)), 4)
    assert counts.tolist() == [len(word_shingles(t, 4)) for t in texts]
    one = shingles.shingle_sets(*flat_bytes(pa.array(["a B c d"])), 4)[0]
    assert shingles.shingle_sets(*flat_bytes(pa.array(["q w e r t", "A b  c d"])), 4)[0][-1] == one[0]
    assert len(sets) == counts.sum()


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_components_equal_brute_force(spark, k, num, den):
    rows = [*near_copies(), *((100 + i, t) for i, t in near_copies(20, 400)), (200, None), (201, ""), (202, "short one"), (203, "SHORT one"), (204, " "), (205, "same text of words here"), (206, "same text of words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("clash")).withColumn("n", F.lit(None).cast("int"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(df, k, num, den).collect())
    assert got == sorted(brute_components(rows, k, num, den))


def test_components_of_repeated_rows_null_ids_and_nothing(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words in this text here"), (None, "a b c d e f"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(ngram_join.similar_components(df, 4, 85, 100).select("doc_id", "n_shingles", "component_id").collect(), key=repr)
    assert [tuple(r) for r in got] == sorted([(1, 3, 1), (1, 3, 1), (1, 3, 1), (None, 3, 1), (None, 0, None)], key=repr)
    assert ngram_join.similar_components(df.limit(0)).count() == 0
    assert sorted(r.text or "" for r in ngram_join.keep_one(df, 4, 85, 100).collect()) == ["", "a b c d e f", "other words in this text here"]


def test_op4_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op4_ngram_jaccard(spark, SF).collect())
    assert got == sorted(brute_components(rows, 4, 85, 100))


# --- embeddings ---------------------------------------------------------------------------------------------------------


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(3)
    centers = r.standard_normal((25, 32))
    v = np.concatenate([centers[i % 25] + r.standard_normal(32) * 0.15 for i in range(500)]).reshape(-1, 32)
    v = np.concatenate([v, v[:30], v[:1] * 3])
    rows = [(i, x.tolist(), int(i % 3) if i != 7 else None) for i, x in enumerate(v)]
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [1.0, None], 1), (904, [], 1), (905, [1.0, 0.0], 1), (906, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("keys", F.lit(0)).withColumn("dim", F.lit("x"))
    got = {x.vec_id: x for x in embed_dedup.near_duplicates(df, 0.93, block=40).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    lab = np.array([x[2] if x[2] is not None else -1 - i for i, x in enumerate(rows[: len(v)])])
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(len(v)))
    assert found <= link.sum() and found >= 0.97 * link.sum()
    assert all(got[i].n_links <= link[i].sum() for i in range(len(v)))
    assert got[0].n_links >= 1 and got[7].n_links == 0 and got[7].kept
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903, 904))
    assert got[905].n_links == got[906].n_links == 1 and got[906].component_id == 905 and not got[906].kept
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


# --- repeated passages --------------------------------------------------------------------------------------------------


def test_suffix_sort_equals_sorting():
    r = np.random.default_rng(0)
    for trial in range(60):
        strings = [[int(x) + 1 for x in r.integers(0, r.integers(1, 4), r.integers(0, 40))] + [0] for _ in range(r.integers(1, 9))]
        if trial == 0:
            strings = [[1] * 30 + [0], [1, 2] * 15 + [0], [0], [3, 3, 1, 3, 3, 1, 3, 3, 0]]
        at = np.r_[0, np.cumsum([len(s) for s in strings])]
        got = suffix_array.suffix_orders(np.array(sum(strings, []), np.int64), at)
        for i, s in enumerate(strings):
            assert (got[at[i] : at[i + 1]] - at[i]).tolist() == sorted(range(len(s)), key=lambda j: s[j:])


def brute_removed(rows, window):
    seen, out = set(), {}
    for key, text in sorted(rows):
        b = (text or "").encode()
        m = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            if w in seen:
                m[p : p + window] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        spans = int(m[:1].sum()) + int((m[1:] & ~m[:-1]).sum())
        out[key] = (len(b), int(m.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_removed_bytes_equal_brute_force(spark):
    r = np.random.default_rng(4)
    say = lambda n: "".join(chr(97 + x) for x in r.integers(0, 4, n))
    passage, long_ = say(150), say(9000)
    rows = [(i, say(60) + passage[: 90 + i] + say(40)) for i in range(60)] + [(70, say(300)), (71, None), (72, ""), (73, "x" * 99), (74, "x" * 100), (75, "y" * 400), (76, "é" * 80), (77, "é" * 80), (78, long_), (79, long_[:4000] + "Q" + long_[4000:])]
    rows += [(80 + i, rows[-1][1]) for i in range(5)] + [(90 + i, passage + say(3) + passage + f"{i}") for i in range(40)] + [(140 + i, f"{i:03}" + passage[:100] + f"{i:04}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("th", F.lit("clash"))
    got = {x.doc_id: (x.n_bytes, x.n_removed, len(x.spans), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in suffix_array.remove_repeats(df, 100).collect()}
    assert got == brute_removed(rows, 100)


def test_removal_of_repeated_rows_null_ids_and_characters(spark):
    text = "".join(chr(97 + i % 7) + "é" for i in range(100)) + "0123456789" * 12
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (6, "Z" + text[1:] + "é")], "doc_id long, text string")
    got = suffix_array.remove_repeats(df, 100, whole_characters=True).collect()
    assert sorted(x.n_removed for x in got if x.doc_id == 5) == [x.n_removed for x in got if x.doc_id == 5][:1] * 2
    (none,) = [x for x in got if x.doc_id is None]
    assert none.n_removed == none.n_bytes
    for x in got:
        bytes(x.kept).decode()
    assert suffix_array.remove_repeats(df.limit(0)).count() == 0


def test_op9_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_suffix_array_dedup(spark, SF).collect()}
    assert got == brute_removed(rows, 100)


# --- mixing -------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights, budget, epochs):
    left, target = {s for s in sizes if True}, {}
    rest = sum(sizes.values()) * budget
    while left:
        total = sum(weights[s] for s in left)
        over = {s for s in left if rest * weights[s] / total > epochs * sizes[s]}
        if not over:
            return target | {s: rest * weights[s] / total for s in left}
        for s in over:
            target[s] = epochs * sizes[s]
            rest -= target[s]
        left -= over
    return target


def test_mix_meets_capped_targets(spark):
    r = np.random.default_rng(8)
    rows = [(i, ["a", "b", "c", "d", None][min(4, int(r.integers(0, 12)))], "w " * int(r.integers(0, 60))) for i in range(3000)] + [(5000 + i, "e", "z " * 40) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df, bins=64).collect()
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(t.split())
    names = sorted([s for s in sizes if s is not None]) + [None]
    want = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5, 2.0)
    taken = Counter()
    for g in got:
        assert g.target == pytest.approx(want[g.source]) and g.source_size == sizes[g.source] and g.taken <= 2 * g.size
        taken[g.source] += g.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = {(x.doc_id, x.taken) for x in mixing.mix(df, bins=64).collect()}
    assert again == {(x.doc_id, x.taken) for x in got}
    out = mixing.take_mix(df, bins=64)
    assert out.columns == df.columns and out.count() == sum(g.copies for g in got)


def test_mix_of_nothing_and_of_empty_texts(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", ""), (2, "a", ""), (None, None, " ")], "doc_id long, source string, text string")
    assert {(r.size, r.taken) for r in mixing.mix(df).collect()} == {(0, 0)}
    assert mixing.mix(df.limit(0)).count() == 0


# --- language and quality -------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba"]
    trie = langid.Trie.build(pieces)
    prob = np.random.default_rng(0).dirichlet(np.ones(8), 2).T
    words = ["ab", "aba", "abx", "b" * 70 + "a" * 60]
    _, logs = langid.Lattice.build(trie, pa.array(words)).forward(prob)

    def total(w, k):
        w = "▁" + w
        best = [1.0] + [0.0] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(e):
                if w[s:e] in pieces:
                    best[e] += best[s] * prob[pieces.index(w[s:e]), k]
                elif e == s + 1:
                    best[e] += best[s] * prob[-1, k]
        return best[-1]

    for i, w in enumerate(words):
        assert logs[i] == pytest.approx([np.log(total(w, k)) for k in (0, 1)])


def test_languages_edge_texts(spark):
    model = langid.fit(["the cat and the dog", "le chat et le chien"], ["en", "fr"], langid.vocabulary(queries.tokenizer_path("piece_bpe_32k.model")))
    d = spark.createDataFrame([(1, None), (2, ""), (3, "12 !! …"), (4, "the dog"), (5, "le chat"), (6, "the dog " * 20000), (7, "x" * 5000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == got[6][0] == "en" and got[5][0] == "fr"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(d.limit(0), model).count() == 0
    nothing = langid.fit([], [], ["a"])
    assert {r.lang_pred for r in langid.identify(d, nothing).collect()} == {"und"}


def test_op10_held_out_accuracy(spark):
    got = queries.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and len(got) == 1000
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95


def test_quality_edge_texts_and_classes(spark):
    m = quality.fit(["good words here", "bad!! bad!! bad!!", "more good words", "BAD!! BAD!!"] * 20, [1, 0, 1, 0] * 20)
    d = spark.createDataFrame([(1, None), (2, ""), (3, "good words"), (4, "bad!! " * 50000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.score for r in quality.score_quality(d, m).collect()}
    assert got[1] == got[2] and got[3] > 0.5 > got[4] and all(0 <= s <= 1 for s in got.values())
    assert quality.score_quality(d.limit(0), m).count() == 0
    assert 0 <= quality.fit([], []).score(pa.array(["x"]))[0] <= 1 and quality.fit(["a"], [1]).score(pa.array(["x"]))[0] > 0.5


def test_op3_held_out_accuracy(spark):
    got = queries.op3_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == r.quality for r in out]) > 0.9


# --- pipeline -------------------------------------------------------------------------------------------------------------


def test_pipeline_stages_and_entry(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns and after.schema == docs.schema, name
        if name in ("language_id", "near_duplicates"):
            assert after.count() <= before.count()
        before = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "source_mix", "pack"]
    q = __spark_entry__.queries()
    assert {"pipeline", "entry"} - {"entry"} <= set(q) and sum(k.startswith("op") and k[2].isdigit() for k in q) == 10
    assert set(__spark_entry__.oracle_sql()) <= set(q)
