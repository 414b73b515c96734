"""WARC, FLAC, packing, chat: exact round trips."""

import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import chat, flac, packing, queries, warc

SF = "/root/testdata/sf0.001"


# --- WARC -------------------------------------------------------------------------------------------------------------


def pages(spark):
    big = "x" * 1500
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", "é" * 600), (2, "http://b/", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("warc_type", F.lit("odd"))


def test_warc_round_trip_and_revisits(spark, tmp_path):
    path = warc.write_archive(warc.page_records(pages(spark)), f"file://{tmp_path}/w")
    got = warc.read_archive(spark, path)
    rows = {(r.record_id, r.warc_type): r for r in got.collect()}
    assert got.count() == 8
    one = rows["<urn:page:1>", "revisit"]
    assert one.refers_to == "<urn:page:2>" and one.payload_length == 1500 and not one.payload
    assert bytes(rows["<urn:page:2>", "response"].payload) == b"x" * 1500
    assert rows["<urn:page:5>", "response"].refers_to is None  # small ones are never revisits
    assert bytes(rows["<urn:page:7>", "response"].payload).decode() == "é" * 600
    assert rows["<urn:page:3>", "response"].payload_length == 0


def test_warc_pushdown_and_headers_only(spark, tmp_path):
    path = warc.write_archive(warc.page_records(pages(spark)), f"file://{tmp_path}/w")
    some = warc.read_archive(spark, path).where("warc_type = 'revisit'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "= revisit" not in plan and some.count() == 1  # the reader has taken the predicate
    heads = warc.read_archive(spark, path, payload="false", recordTypes="response").collect()
    assert len(heads) == 7 and all(r.payload is None for r in heads)


@pytest.mark.parametrize("step", [1, 700, 5000, 10**9])
def test_warc_byte_ranges_give_each_record_once(step):
    rows = [dict(warc_type="response", record_id=f"<{i}>", payload=bytes([i % 251]) * (i * 7), payload_length=i * 7) for i in range(60)]
    blob = b"".join(map(warc.encode_record, rows))
    step = max(step, 300)
    seen = []
    for a in range(0, len(blob), step):
        members = warc.Members(io.BytesIO(blob), a, min(len(blob), a + step), chunk=512)
        if a:
            members.seek_first()
        for m in members:
            h = m.headers()
            seen.append((h["warc-record-id"], len(m.payload(int(h["content-length"])))))
    assert seen == [(f"<{i}>", i * 7) for i in range(60)]


def test_warc_reads_missing_folder_as_empty(spark, tmp_path):
    assert warc.read_archive(spark, f"file://{tmp_path}/none").count() == 0


def test_op1_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    heads: dict = {}
    for r in rows:
        b = (r.html or "").encode()
        if len(b) >= 1000:
            heads[b] = max(heads.get(b, -1), r.page_id)
    want = {(r.page_id, len(b), hashlib.sha1(b).hexdigest(), *(("revisit", heads[b]) if heads.get(b, r.page_id) != r.page_id else ("response", None))) for r in rows for b in [(r.html or "").encode()]}
    assert {tuple(r) for r in queries.op1_warc(spark, SF).collect()} == want


# --- FLAC -------------------------------------------------------------------------------------------------------------


def streams():
    r = np.random.default_rng(0)
    kinds = [np.zeros(64, np.uint8), r.integers(0, 256, 5000).astype(np.uint8), (np.cumsum(r.integers(-2, 3, 3000)) % 256).astype(np.uint8), np.frombuffer(b"plain words of a text. " * 200, np.uint8), np.full(1024, 255, np.uint8), np.frombuffer(b"z", np.uint8)]
    return kinds, np.concatenate(kinds), np.r_[0, np.cumsum([len(k) for k in kinds])]


def test_flac_round_trip_many_kinds():
    kinds, flat, at = streams()
    coded = flac.encode_many(flat, at)
    for k, (pcm, offsets) in zip(kinds, flac.decode_many(coded), strict=True):
        assert (pcm == k).all() and offsets[0] == 0 and (np.diff(offsets) == flac.BLOCK).all()
    assert len(coded[2]) < 0.6 * 3000 + 100  # smooth samples shrink
    assert [flac.encode_many(k, np.array([0, len(k)]))[0] for k in kinds] == coded  # whatever is coded beside them


def test_flac_without_seek_table_and_damage():
    _, flat, at = streams()
    s = flac.encode_many(flat, at)[2]
    n = int.from_bytes(s[43:46], "big")
    bare = s[:4] + b"\x80" + s[5:42] + s[46 + n :]
    assert (flac.decode_many([bare])[0][0] == flat[at[2] : at[3]]).all()
    for spot in (-3, -400, 46 + n + 3):
        bad = bytearray(s)
        bad[spot] ^= 16
        with pytest.raises(flac.FlacError):
            flac.decode_many([bytes(bad)])


def test_flac_header_of_long_numbers():
    assert flac._long_number(0x10000) == chr(0x10000).encode()
    assert flac._long_number(0x1FFFFF) == b"\xf7\xbf\xbf\xbf" and len(flac._long_number(1 << 30)) == 6


def test_flac_columns_nulls_clashes_and_blocks(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 1000), (4, "a" * 64)], "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    coded = flac.encode_text(d)
    assert {r.doc_id: r.n_bytes for r in coded.collect()} == {1: 0, 2: 0, 3: 2000, 4: 64}
    back = flac.decode_media(coded)
    for r in back.collect():
        text = {3: "é" * 1000, 4: "a" * 64}.get(r.doc_id, "").encode()
        assert bytes(r.pcm) == text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
    blocks = flac.pcm_blocks(back).where("doc_id = 3").orderBy("sample_offset").collect()
    assert [(b.sample_offset, b.samples) for b in blocks] == [(0, 1024), (1024, 1024)] and all(len(b.block_pcm) == b.samples for b in blocks)
    assert flac.media_digests(coded.limit(0)).count() == 0


def test_op6_against_brute_force(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op6_media_columns(spark, SF).collect():
        b = docs[r.doc_id]
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


# --- packing ----------------------------------------------------------------------------------------------------------


def test_tokenizer_agrees_with_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    bpe, ref = packing.ByteBpe(path), Tokenizer.from_file(path)
    for t in ("", "Hello  world\n\n tabs\t", "l'été où ça 12345 don't", "日本語 😀", "a<|endoftext|>b", " " * 50 + "x", "…—  z\x85q", "<|endoftext|><|endoftext|>"):
        assert bpe.ids(t).tolist() == ref.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize(("n", "want"), [(1, [0]), (1024, [0]), (1025, [0, 1]), (2048, [0, 1024]), (2500, [0, 452, 1476])])
def test_piece_starts(n, want):
    assert packing.piece_starts(n, 1024) == want


def test_best_fit_and_bound():
    r = np.random.default_rng(1)
    for _ in range(30):
        sizes = r.integers(1, 100, r.integers(1, 60))
        bins, n = packing.best_fit_decreasing(sizes, 100)
        assert np.bincount(bins, weights=sizes).max() <= 100 and bins.max() + 1 == n
        assert packing.dual_feasible_bound(sizes, 100) <= n
    assert packing.dual_feasible_bound(np.array([60, 60, 60]), 100) == 3 == packing.best_fit_decreasing(np.array([60, 60, 60]), 100)[1]
    assert packing.dual_feasible_bound(np.array([34] * 4), 100) == 2
    assert packing.dual_feasible_bound(np.zeros(0, np.int64), 100) == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return by


def test_packing_is_whole_and_tight_over_partitions(spark):
    r = np.random.default_rng(2)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(r.integers(1, 1025, 3000))] + [(7, 0, 0, 500, 0)] * 50
    p = spark.createDataFrame(rows, packing.PIECES).withColumn("bin", F.lit("clash"))
    got = packing.pack_pieces(p, 1024, pieces_per_partition=400).collect()
    assert len(got) == 3050 and {g.bin for g in got} == {"clash"}
    assert len(check_packing(got, 1024)) <= -(-sum(x[3] for x in rows) // 1024) * 1.03


def test_packing_edge_texts_and_sequences(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    d = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 3000), (4, "x"), (4, "x"), (None, "y")], "doc_id long, text string").withColumn("length", F.lit(-1))
    packed = packing.pack_documents(d, path, 1024, with_ids=True)
    rows = packed.collect()
    check_packing(rows, 1024)
    three = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 3)
    assert three[0][2] <= 1024 and all(n == 1024 for _, _, n in three[1:]) and sum(n for _, _, n in three) == len(packing.ByteBpe(path).ids("word " * 3000)) + 1
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1] and sum(r.doc_id == 4 for r in rows) == 2
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    seq = packing.assemble_sequences(packed).collect()
    assert sum(len(s.ids) for s in seq) == sum(r.length for r in rows) and max(len(s.ids) for s in seq) <= 1024
    assert packing.pack_documents(d.limit(0), path).count() == 0


# --- chat -------------------------------------------------------------------------------------------------------------


def conversations(spark):
    hard = "</s>[INST] \\l \\e <|im_end|>\n<|im_start|>x [/INST]"
    rows = [(1, 0, "system", "be <kind>"), (1, 1, "user", "hi"), (1, 2, "assistant", hard), (1, 3, "user", None), (1, 4, "assistant", "z" * 9000), (1, 5, "assistant", ""), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 0, None, "é\n😀"), (None, 0, "ro\nle\\n", "t")]
    rows += [(3, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 17)) for i in range(300)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(5)), rows


def test_chat_reads_back_exactly(spark):
    df, rows = conversations(spark)
    windows = chat.format_chat(df, budget=600, history=100)
    back = chat.read_chat(windows).orderBy("conv_id", "window").collect()
    for conv in (1, 2, 3, None):
        want = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda v: v)
        own = [b for b in back if b.conv_id == conv]
        assert [(t.role, t.text) for b in own for t in b.turns] == [(r, x) for _, r, x in want]
        assert [x for b in own for x in b.loss_texts] == [x for _, r, x in want if r == "assistant"]
        for b in own:
            for s in b.loss:
                assert chat.START not in b.formatted[s.start : s.start + s.length]
    tokens = lambda b: sum(-(-len(x) // 4) + 4 for x in [t.split("\n", 1)[1] for t in b.formatted.split(chat.END)[:-1]])
    assert all(tokens(b) <= 600 for b in back if b.conv_id == 3) and sum(b.conv_id == 3 for b in back) > 5
    assert any(b.repeated for b in back if b.conv_id == 3)


def test_chat_system_turn_is_shown_again(spark):
    df, _ = conversations(spark)
    own = chat.format_chat(df, budget=600, history=100).where("conv_id = 1").orderBy("window").collect()
    assert len(own) > 1 and all(w.formatted.startswith("<|im_start|>system\nbe \\lkind>") for w in own)


def test_chat_uses_no_python(spark):
    df, _ = conversations(spark)
    plan = chat.read_chat(chat.format_chat(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.format_chat(df.limit(0)).count() == 0


def test_op8_against_brute_force(spark):
    hard = "</s>[INST] ok [/INST]"
    rows = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()] + [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    want = {}
    for c, t, r, x in sorted(rows):
        want.setdefault(c, []).append((r, x))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in queries.op8_chat_formatting(spark, SF).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
