"""Long texts, hostile rows and archives: what operators must take without failing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import langid, mixing, ngram_join, packing, queries, shingles, suffix_array, warc

BPE = "byte_bpe_50k.json"


def test_ids_of_very_long_runs_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(BPE)
    bpe, want = packing.ByteBpe(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    long = ["a" + " " * 600_000 + "b", "\n" * 600_000, " " * 600_000 + "<|endoftext|> x"]
    mixed = ["".join(rng.choice([" ", "\n", " " * 1500, "\n" * 1200, "word", "é1", "\t　" * 600, "<|endoftext|>"]) for _ in range(9)) for _ in range(30)]
    for text in long + mixed:
        assert bpe.ids(text).tolist() == want.encode(text, add_special_tokens=False).ids
        assert bpe._ids_around_blanks(text).tolist() == bpe.ids(text).tolist()
    assert len(bpe.ids("q" + " " * 3_000_000)) == 3_000_001


def test_op2_against_brute_force(spark, tmp_path):
    import zlib

    from tokenizers import Tokenizer

    texts = [None, "", "one two", "one two", "word " * 3000, " " * 700_000 + "end", *("text %d " % i * (i % 400) for i in range(120))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_best_fit_packing(spark, str(tmp_path)).collect()
    want = Tokenizer.from_file(queries.tokenizer_path(BPE))
    pieces = {}
    for i, t in enumerate(texts):
        ids = [*want.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or min(len(ids), 1024)
        starts = [0, *range(first, len(ids), 1024)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            pieces[i, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in bins.values():
        rows.sort()
        assert [o for o, _ in rows] == [sum(n for _, n in rows[:k]) for k in range(len(rows))] and sum(n for _, n in rows) <= 1024
    sizes = np.array([v[1] for v in pieces.values()])
    assert len(bins) <= packing.dual_feasible_bound(sizes, 1024) + 1


def test_expected_uses_cover_every_character():
    import pyarrow as pa

    pieces = langid.vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
    trie = langid.Trie.build(pieces)
    size = np.array([*map(len, pieces), 1])
    rng = random.Random(1)
    flat = np.full((len(pieces) + 1, 2), 1 / 32000)
    steep = np.random.default_rng(0).dirichlet(np.full(len(pieces) + 1, 0.1), 2).T + 1e-9
    for n in (5, 16, 17, 39, 40):
        for alphabet in ("abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他"):
            word = "".join(rng.choice(alphabet) for _ in range(n))
            for prob in (flat, steep):
                uses = langid.Lattice.build(trie, pa.array([word])).expected(prob, np.ones((1, 2)))
                assert (uses * size[:, None]).sum(axis=0) == pytest.approx(n + 1)


def test_mix_of_repeated_rows_and_empty_texts(spark):
    rows = [(1, "a b c", "s")] * 5 + [(i, "", "t") for i in range(10, 14)] + [(20, "x y", "t"), (21, None, None), (22, "k", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__id", F.lit(1)).withColumn("__n", F.lit(2)).withColumn("__mix_n", F.lit(3))
    mixed = mixing.mix(docs).collect()
    assert max(r.copies for r in mixed) <= 2 and all(r.taken <= 2 * r.size for r in mixed)
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    per = {(r.doc_id, r.source): r["count"] for r in taken.groupBy("doc_id", "source").count().collect()}
    want: dict = {}
    for r in mixed:
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.copies
    assert per == {k: v for k, v in want.items() if v}
    assert mixing.take_mix(docs.limit(0)).count() == 0


def test_op7_against_brute_force(spark):
    import re

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op7_mixing_sources(spark, sf).collect()
    assert len(got) == len(docs)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    total: dict = {}
    for i, d in docs.items():
        total[d.source] = total.get(d.source, 0) + size[i]
    names = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        left = 1.5 * sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s]]
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
        free -= set(over)
    target |= share
    taken: dict = {}
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], total[docs[r.doc_id].source]) and r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[docs[r.doc_id].source])
        taken[docs[r.doc_id].source] = taken.get(docs[r.doc_id].source, 0) + r.taken
    longest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in names)


def test_shingles_in_chunks_equal_those_at_once(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB é \n\t") for _ in range(rng.randrange(300))) for _ in range(40)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    want = shingles.shingle_sets(raw, at, 3)
    monkeypatch.setattr(shingles, "CHUNK", 7)
    got = shingles.shingle_sets(raw, at, 3)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_long_texts_without_repeats_or_copies(spark):
    rng = random.Random(2)
    body = " ".join("%x" % rng.getrandbits(24) for _ in range(400_000))
    docs = spark.createDataFrame([(1, body), (2, body[1_000_000:2_500_000]), (3, " " * 3_000_000), (4, None)], "doc_id long, text string")
    cut = {r.doc_id: r for r in suffix_array.remove_repeats(docs).drop("kept", "text").collect()}
    assert (cut[1].n_removed, cut[2].n_removed, cut[4].n_removed) == (0, 1_500_000, 0)
    assert cut[3].n_removed == 2_999_999
    found = {r.doc_id: r for r in ngram_join.similar_components(docs.unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(9).cast("long")))).collect()}
    assert found[9].component_id == 1 and found[2].component_id == 2 and found[3].n_shingles == 0


def test_archives_skip_payloads_and_read_other_writers(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, f"http://h/{i}", "x%d " % i * 5000) for i in range(20)], "page_id long, url string, html string")
    path = warc.write_archive(warc.page_records(pages.coalesce(1)), f"{tmp_path}/own")
    few = warc.read_archive(spark, path, columns=["record_id"])
    assert few.columns == ["record_id"] and few.count() == 20
    full = {r.record_id: bytes(r.payload) for r in warc.read_archive(spark, path, splitbytes=4096).collect()}
    assert full == {f"<urn:page:{i}>": b"x%d " % i * 5000 for i in range(20)}

    class Seen:
        def __init__(self, f):
            self.f, self.n = f, 0

        def seek(self, to):
            self.f.seek(to)

        def read(self, n):
            data = self.f.read(n)
            self.n += len(data)
            return data

    big = warc.encode_record({"warc_type": "response", "payload": random.Random(1).randbytes(3_000_000)})
    (tmp_path / "big.warc.gz").write_bytes(big * 3)
    with open(tmp_path / "big.warc.gz", "rb") as f:
        seen = Seen(f)
        heads = [m.headers()["warc-type"] for m in warc.Members(seen, 0, 3 * len(big))]
    assert heads == ["response"] * 3 and seen.n < len(big)
    assert gzip.decompress(big).startswith(b"WARC/1.1")

    other = tmp_path / "other"
    other.mkdir()
    record = b"WARC/1.0\r\nwarc-type:response\r\nWARC-record-id: <urn:a>\r\ncontent-length: 4\r\n\r\nbody\r\n\r\n"
    (other / "a.warc.gz").write_bytes(gzip.compress(record) * 2)
    got = warc.read_archive(spark, str(other)).collect()
    assert [(r.warc_type, r.record_id, bytes(r.payload), r.payload_length) for r in got] == [("response", "<urn:a>", b"body", 4)] * 2
    (other / "b.warc").write_bytes(record)
    with pytest.raises(Exception, match="gzip member"):
        warc.read_archive(spark, str(other)).collect()


def test_language_stage_rejects_what_no_language_explains(spark):
    rng = random.Random(5)
    words = {"en": "the cat sat on a mat and saw the dog".split(), "fr": "le chat est sur un tapis et voit le chien".split()}
    rows = [(i, " ".join(rng.choices(words[g], k=30)), g, "s", 1, "clash") for i in range(40) for g in words]
    rows += [(900, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300)), None, "s", 1, "clash"), (901, "cat", "en", "s", 1, "clash"), (902, "123", None, "s", 1, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, lang_pred string")
    got = corpus_pipeline.language_id(spark, docs, "")
    assert got.columns == docs.columns
    ids = {r.doc_id for r in got.collect()}
    assert 901 in ids and 902 not in ids and set(range(40)) <= ids and 900 not in ids
