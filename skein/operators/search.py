"""Retrieval: BM25, cosine top-k, rank fusion, intents, grouping, replay metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.nearest import nearest
from skein.operators.scoring import best_documents
from skein.sources.staging import stage

TOKEN = "[a-z0-9]+"
K1, B = 1.2, 0.75
RRF_K = 60
#: Weight of each source by intent.
INTENT_WEIGHTS = {
    "calls-of": {"bm25": 0.55, "vec": 0.1, "graph": 0.35, "ce": 0.0},
    "cross-file-impact": {"bm25": 0.3, "vec": 0.1, "graph": 0.6, "ce": 0.0},
    "nl-conceptual": {"bm25": 0.2, "vec": 0.5, "graph": 0.0, "ce": 0.3},
    "ambiguous": {"bm25": 0.5, "vec": 0.5, "graph": 0.0, "ce": 0.0},
}
#: Phrases of each intent, in order of precedence, with the confidence of a match.
INTENT_PHRASES = (
    ("calls-of", 0.9, ("what calls", "who calls", "callers of", "who invokes", "invokes", "invocations of")),
    ("cross-file-impact", 0.85, ("what breaks", "safe to change", "breaks if", "impact of", "downstream", "depends on", "affected by", "consumers of", "reverse dep", "files affected")),
    ("nl-conceptual", 0.8, ("how does", "how do ", "how works", "how is ", "how are ", "architecture", "explain", "where is", "where does", "what is the", "what runs", "walk me through")),
)
SURE = 0.7  # under this confidence a query is weighed as ambiguous


def tokens(text: str | Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def bm25(docs: DataFrame, queries: DataFrame, top: int, doc_id: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, doc_id, score, rank``: the ``top`` documents of every query (query_id, query).

    One pass makes the lengths and the frequencies of the terms that are asked for; document frequencies and the mean length
    are aggregates of it. Query terms meet tokens by an equality, so other tokens are never shuffled. Any term may match; each distinct
    query term counts once. Scores are rounded to six places before ranking, ties go to the smaller id. See ``best_documents``.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term"))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.array_sort(F.coalesce(tokens(text), F.array().cast("array<string>"))).alias("at"))
    first = lambda i: (i == 0) | (F.get("at", i) != F.get("at", i - 1))
    begins = F.when(F.size("at") > 0, F.filter(F.sequence(F.lit(0), F.size("at") - 1), first)).otherwise(F.array().cast("array<int>"))
    counted = F.transform("begins", lambda a, i: F.struct(F.get("at", a).alias("term"), (F.coalesce(F.get("begins", i + 1), F.size("at")) - a).cast("long").alias("tf")))
    # an empty term stands for the document; of the others only those that are asked for are kept. Nothing is grouped
    own = F.array(F.struct(F.lit("").alias("term"), F.lit(1).cast("long").alias("tf")))
    each = found.withColumn("begins", begins).select("doc_id", F.size("at").cast("long").alias("len"), F.explode(F.concat(own, counted)).alias("p")).select("doc_id", "len", "p.term", "p.tf")
    asked = terms.select("term").unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    each = stage(each.join(asked, "term", "left_semi"), "postings")  # texts are tokenised once
    rows, post = each.where("term = ''"), each
    stats = rows.agg(F.count("*").alias("n"), F.sum("len").alias("total"))
    if not rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # rows of one id are one document
        whole = F.sum(F.when(F.col("term") == "", F.col("len"))).over(W.partitionBy("doc_id"))
        post = stage(each.withColumn("len", whole).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.first("len").alias("len")), "merged")
    post = post.where("term <> ''")
    df = post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asks = terms.join(df, "term").select(F.lit("").alias("tbl"), "query_id", "term", idf.alias("idf"), (F.col("total") / F.col("n")).alias("mean"))
    found = best_documents(stage(asks, "asks"), post.select(F.lit("").alias("tbl"), F.col("doc_id").alias("doc"), "term", "tf", "len"), top, k1=k1, b=b)
    return found.select("query_id", F.col("doc").alias("doc_id"), "score", "rank")


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two numeric arrays in doubles; null for zero vectors."""
    d = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + d(x) * d(x)))
    base = norm(a) * norm(b)
    return F.when(base > 0, dot / base)


def vector_search(rows: DataFrame, queries: DataFrame, top: int, max_distance: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, id, score, rank`` by cosine under a distance, exactly: see ``nearest``."""
    q = queries.select("query_id", F.col(vector).alias("vector"))
    s = nearest(rows.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")), q, top)
    return s.where(1 - F.col("score") < max_distance)


def fuse(ranked: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """``query_id, key, score, sources`` from rows ``query_id, key, rank, source``: sum of weight / (k + rank)."""
    w = F.lit(1.0)
    if weights is not None:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("source") == name, value).otherwise(w)
    part = ranked.withColumn("__s", w / (F.lit(k) + F.col("rank")))
    return part.groupBy("query_id", "key").agg(F.round(F.sum("__s"), 8).alias("score"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def fuse_by_intent(ranked: DataFrame, intents: DataFrame, k: int = RRF_K) -> DataFrame:
    """As ``fuse``, with the weights of each query's intent (query_id, intent, confidence); unsure queries count as
    ambiguous. Rows of source ``ce`` weigh their ``raw_score`` itself instead of their rank, where that column is there."""
    name = F.when(F.col("confidence") < SURE, "ambiguous").otherwise(F.col("intent"))
    w = F.lit(0.0)
    for label, shares in INTENT_WEIGHTS.items():
        for source, value in shares.items():
            w = F.when((name == label) & (F.col("source") == source), value).otherwise(w)
    by_rank = w / (F.lit(k) + F.col("rank"))
    part = by_rank if "raw_score" not in ranked.columns else F.when(F.col("source") == "ce", w * F.col("raw_score")).otherwise(by_rank)
    scored = ranked.join(intents, "query_id").withColumn("__s", part)
    return scored.groupBy("query_id", "key").agg(F.round(F.sum("__s"), 8).alias("score"))


def intent(query: Column) -> Column:
    """Struct of ``intent, confidence``: the first class with a phrase in the query; else up to two words are ambiguous
    (0.7), and longer queries conceptual (0.5). Null and blank queries are ambiguous with confidence 0."""
    q = F.trim(F.lower(F.coalesce(query, F.lit(""))))

    def said(name: str, confidence: float) -> Column:
        return F.struct(F.lit(name).alias("intent"), F.lit(confidence).alias("confidence"))

    out = F.when(q == "", said("ambiguous", 0.0))
    for name, confidence, phrases in INTENT_PHRASES:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | q.contains(p)
        out = out.when(hit, said(name, confidence))
    return out.when(F.size(F.split(q, "\\s+")) <= 2, said("ambiguous", 0.7)).otherwise(said("nl-conceptual", 0.5))


def expand_identifiers(query: Column) -> Column:
    """Every word of the query, each followed by its parts if it is a snake, kebab or camel identifier."""

    def parts(w: Column, mark: str) -> Column:
        return F.filter(F.split(w, mark), lambda x: x != "")

    def humps(w: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(w, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")

    def one(w: Column) -> Column:
        split = F.when(F.size(parts(w, "_")) > 1, F.array_join(parts(w, "_"), " ")).when(F.size(parts(w, "-")) > 1, F.array_join(parts(w, "-"), " "))
        split = split.when(w.rlike("[a-z][A-Z]|[A-Z]{2,}[a-z]"), humps(w))
        return F.concat_ws(" ", w, split)

    return F.array_join(F.transform(F.filter(F.split(query, "\\s+"), lambda x: x != ""), one), " ")


def group_hits(hits: DataFrame, members: DataFrame, groups: int, per_group: int) -> DataFrame:
    """Hits by the group they belong to (key, grp, boost): sum of scores and a tenth of the largest boost decide."""
    j = hits.join(members, "key")
    top = j.groupBy("query_id", "grp").agg(F.round(F.sum("score") + 0.1 * F.max("boost"), 6).alias("priority"), F.count("*").alias("size"))
    g = W.partitionBy("query_id").orderBy(F.desc("priority"), "grp")
    top = top.withColumn("place", F.row_number().over(g)).where(F.col("place") <= groups)
    w = W.partitionBy("query_id", "grp").orderBy(F.desc("score"), "key")
    return j.join(top, ["query_id", "grp"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_group).select("query_id", "grp", "priority", "place", "key", "score")


def abstain(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits of at least ``threshold``; a query without any gives nothing."""
    return hits.where(F.col("score") >= threshold)


def replay_metrics(old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """Per query: Jaccard at ``k`` of two rankings (query_id, key, rank), mean rank change of what both have, top-1
    stability, and a verdict: PASS from 0.8 with a stable top, WARN from 0.5, else FAIL."""
    a = old.where(F.col("rank") <= k).select("query_id", "key", F.col("rank").alias("ra"))
    b = new.where(F.col("rank") <= k).select("query_id", "key", F.col("rank").alias("rb"))
    j = a.join(b, ["query_id", "key"], "full_outer")
    both = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    m = j.groupBy("query_id").agg(
        F.round(F.count_if(both) / F.count("*"), 6).alias("jaccard"),
        F.round(F.avg(F.when(both, F.abs(F.col("ra") - F.col("rb")))), 6).alias("rank_delta"),
        F.coalesce(F.max((F.col("ra") == 1) & (F.col("rb") == 1)), F.lit(False)).alias("top1_stable"),
    )
    return m.withColumn("verdict", F.when((F.col("jaccard") >= 0.8) & F.col("top1_stable"), "PASS").when(F.col("jaccard") >= 0.5, "WARN").otherwise("FAIL"))


def recall_at(expected: DataFrame, actual: DataFrame, k: int) -> DataFrame:
    """``query_id, recall`` of expected keys among the first ``k``."""
    j = expected.select("query_id", "key").distinct().join(actual.where(F.col("rank") <= k).select("query_id", "key").distinct().withColumn("hit", F.lit(1)), ["query_id", "key"], "left")
    return j.groupBy("query_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
