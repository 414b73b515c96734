"""The registered queries of the training-data operators. Each applies its operator to a whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import chat, embed_dedup, filter_audit, flac, hard_negatives, langid, mixing, ngram_join, packing, quality, suffix_array, superkmer, warc
from skein.llm.common import id_bucket


@functools.cache
def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written, read back, and its payload's digest checked against the header."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    columns = ["warc_type", "record_id", "payload_digest", "payload_length", "refers_to", "payload"]
    back = warc.read_archive(spark, warc.write_archive(warc.page_records(pages)), columns=columns)
    response = F.col("warc_type") == "response"
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    digest = F.when(response, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1))
    broken = response & (F.concat(F.lit("sha1:"), F.sha1("payload")) != F.col("payload_digest"))
    return back.select(
        number("record_id").alias("page_id"),
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(broken, F.raise_error(F.lit("a payload differs from its digest")).cast("string")).otherwise(digest).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 1024 tokens with their sequence and offset."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 1024)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every whole text, learned from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score_quality(docs, quality.fit_from(docs, labels))
    held_out = id_bucket("doc_id", 5) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more, whole texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_join.similar_components(docs, words=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors of equal label with a cosine of 0.93 or more."""
    return embed_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a FLAC stream, decoded again; digests of payload and stream, and features of the samples."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = flac.media_digests(flac.encode_text(docs))
    return found.drop("media")


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words takes of every document, at most two epochs of any source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, (5.0, 2.0, 1.0), budget_share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation as parsed back from its formatted windows, and of the text under the loss mask."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    back = chat.read_chat(chat.format_chat(rows.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = back.select("conv_id", "window", F.size("turns").cast("long").alias("n"), said.alias("said"), F.array_join("loss_texts", "").alias("learned"), F.length("formatted").cast("long").alias("chars"))
    grouped = per.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "said", "learned"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    said, learned = F.array_join(F.col("w.said"), ""), F.array_join(F.col("w.learned"), "")
    return grouped.select("conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every whole text once each byte of a 100-byte string that also starts earlier is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = suffix_array.remove_repeats(docs, 100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit_from(langid.learning_rows(docs), tokenizer_path("piece_bpe_32k.model"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every whole text once each word of a 20-word window that also starts earlier is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = superkmer.remove_repeats(docs, 20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every part of the whole documents, in each of their 120 orders."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every anchor, the rows whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.integer_vectors(rows.withColumn("label", label)), F.col("id") % 100 == 0)


QUERIES = (op1_warc, op2_best_fit_packing, op3_quality_classifier, op4_ngram_jaccard, op5_embedding_dedup, op6_media_columns, op7_mixing_sources, op8_chat_formatting, op9_suffix_array_dedup, op10_language_id, op11_substring_dedup, op12_filter_audit, op13_hard_negatives)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP1_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
h AS (SELECT d, max(page_id) AS head FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN head > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN head > page_id THEN head END AS refers_to FROM p LEFT JOIN h ON h.d = p.d AND n >= 1000"""

OP5_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b), low AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(low.m, v.vec_id)) AS component_id, v.vec_id <= coalesce(low.m, v.vec_id) AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN low ON low.a = v.vec_id"""

OP8_SQL = """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT *, (ceil(length(text) / 4.0) + 4)::BIGINT AS tokens, row_number() OVER o AS idx FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
b AS (SELECT *, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY idx) - tokens)::BIGINT AS before, coalesce(max(CASE WHEN idx = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS st, max(CASE WHEN idx = 1 AND role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS sys FROM a),
d AS (SELECT *, greatest(1.0, (2048.0 - 256 - st) / 2)::DOUBLE AS half FROM b), e AS (SELECT *, tokens > half AS long, floor(before / half)::BIGINT AS cell FROM d),
f AS (SELECT *, sum((long OR coalesce(lag_long, false))::INT) OVER (PARTITION BY conv_id ORDER BY idx) AS seg FROM (SELECT *, lag(long) OVER (PARTITION BY conv_id ORDER BY idx) AS lag_long FROM e)),
g AS (SELECT *, sum(coalesce((seg <> ls OR cell <> lc)::INT, 0)) OVER (PARTITION BY conv_id ORDER BY idx) AS win FROM (SELECT *, lag(seg) OVER w AS ls, lag(cell) OVER w AS lc FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY idx))),
h AS (SELECT *, max(before + tokens) OVER (PARTITION BY conv_id, win) - before AS to_end, min(idx) OVER (PARTITION BY conv_id, win) = idx AS opens, max(win) OVER (PARTITION BY conv_id) AS last_win,
  length(replace(replace(replace(text, chr(92), chr(92) || 'e'), '<', chr(92) || 'l'), '[', chr(92) || 'b')) + length(replace(replace(replace(replace(role, chr(92), chr(92) || 'e'), '<', chr(92) || 'l'), '[', chr(92) || 'b'), chr(10), chr(92) || 'n')) + 24 AS chars FROM g),
s AS (SELECT conv_id, chars AS sys_chars FROM h WHERE idx = 1 AND role = 'system'),
k AS (SELECT h.*, chars + CASE WHEN to_end <= 256 AND win < last_win AND NOT (idx = 1 AND role = 'system') THEN chars ELSE 0 END + CASE WHEN opens AND win > 0 THEN coalesce(sys_chars, 0) ELSE 0 END AS shown FROM h LEFT JOIN s USING (conv_id))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(shown)::BIGINT AS formatted_chars FROM k GROUP BY conv_id"""


OP11_SQL = r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i : i + 19], ' ') ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM t),
c AS (SELECT DISTINCT doc_id, i + k AS j FROM late, range(0, 20) r(k)),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n FROM e ANTI JOIN c USING (doc_id, j) GROUP BY doc_id)
SELECT t.doc_id AS doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id"""

OP12_SQL = r"""WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
d AS (SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM t LEFT JOIN l USING (doc_id)),
m AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, f),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT part, o, k AS step, n, good, toxic, f[o[k]] AS fails, len(list_filter(o[1 : k - 1], lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS fs FROM m, o, k),
r AS (SELECT part, list_aggregate(list_transform(o, lambda i: chr((64 + i)::INT)), 'string_agg', '') AS filter_order, step, o[step] AS own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND fs = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM s GROUP BY part, o, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""


OP13_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE alike) WHERE k <= 5),
n AS (SELECT p.a, p.b, p.score AS ps, s.b AS c, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS k FROM p JOIN s ON s.a = p.a AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, b AS positive_id, k::INT AS rank, c AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 10"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express on whole tables; the others are tested against brute force."""
    return {"op1_warc": OP1_SQL, "op5_embedding_dedup": OP5_SQL, "op8_chat_formatting": OP8_SQL, "op11_substring_dedup": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_hard_negatives": OP13_SQL}
