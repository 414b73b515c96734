"""Text operators: chunks, lines, sections, patterns, entities, shared-signal clusters, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.components import connected_components


def chunk(docs: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 120) -> DataFrame:
    """``key, chunk, start, end, body``: windows of ``size`` characters; each begins ``overlap`` before the last one's end.

    A text that fits is one chunk; empty texts have none.
    """
    n = F.length(text)
    step = size - overlap
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    rows = docs.where(n > 0).select(key, text, n.alias("__n"), F.posexplode(F.sequence(F.lit(0), (count - 1) * step, F.lit(step))).alias("chunk", "start"))
    end = F.least(F.col("start") + size, F.col("__n"))
    return rows.select(key, "chunk", "start", end.alias("end"), F.substring(F.col(text), F.col("start") + 1, end - F.col("start")).alias("body"))


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line``: 1-based lines."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def grep(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Lines that match a regular expression; whole texts without a match never explode."""
    return lines(docs.where(F.col(text).rlike(pattern)), key, text).where(F.col("line").rlike(pattern))


def sections(marked: DataFrame, key: str) -> DataFrame:
    """``key, start, end, level, parent``: spans of headings from rows ``key, line_no, level`` (null: no heading).

    A section ends before the next heading of no deeper level, or with the document; its parent is the nearest heading
    before it of a smaller level.
    """
    last = marked.groupBy(key).agg(F.max("line_no").alias("__last"))
    h = marked.where("level IS NOT NULL").select(key, F.col("line_no").alias("start"), "level")
    later = h.select(key, F.col("start").alias("__s2"), F.col("level").alias("__l2"))
    ends = h.join(later, key).where("__s2 > start AND __l2 <= level").groupBy(key, "start").agg((F.min("__s2") - 1).alias("__end"))
    up = h.join(later, key).where("__s2 < start AND __l2 < level").groupBy(key, "start").agg(F.max("__s2").alias("parent"))
    j = h.join(ends, [key, "start"], "left").join(up, [key, "start"], "left").join(last, key)
    return j.select(key, "start", F.coalesce("__end", "__last").alias("end"), "level", "parent")


def extract_all(docs: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """``key, kind, value``: every match of every named pattern."""

    def matches(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = [matches(k, p) for k, p in patterns.items()]
    return docs.select(key, F.explode(F.concat(*found)).alias("m")).select(key, "m.kind", "m.value")


def signal_clusters(signals: DataFrame, key: str, signal: str) -> DataFrame:
    """``key, cluster``: rows connected through shared signals, named by the smallest key.

    A signal links its keys to its smallest one: as many links as rows, whatever the size of its bucket.
    """
    own = signals.select(key, signal).distinct()
    low = own.groupBy(signal).agg(F.min(key).alias("__low"))
    edges = own.join(low, signal).select(F.col(key).alias("src"), F.col("__low").alias("dst")).where("src <> dst")
    got = connected_components(edges)
    return own.select(key).distinct().join(got, F.col(key) == F.col("id"), "left").select(key, F.coalesce("component", key).alias("cluster"))


def pattern_audit(rows: DataFrame, key: str, text: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rule, severity, rows, hits`` of regular-expression rules (name, pattern, severity), in one pass."""
    counts = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.regexp_count(F.col(text), F.lit(p)).cast("long").alias("c")) for n, p, s in rules])
    r = rows.select(F.explode(counts).alias("r")).where("r.c > 0")
    return r.groupBy("r.rule", "r.severity").agg(F.count("*").alias("rows"), F.sum("r.c").alias("hits"))


def migration_progress(rows: DataFrame, group: str, text: str, old: str, new: str) -> DataFrame:
    """``group, old, new, pct``: counts of an old and a new pattern and the share of the new."""
    a, b = F.regexp_count(F.col(text), F.lit(old)).cast("long"), F.regexp_count(F.col(text), F.lit(new)).cast("long")
    g = rows.groupBy(group).agg(F.sum(a).alias("old"), F.sum(b).alias("new"))
    return g.withColumn("pct", F.round(F.when(F.col("old") + F.col("new") > 0, F.col("new") / (F.col("old") + F.col("new"))), 6))


def drift(documented: DataFrame, implemented: DataFrame, key: str) -> DataFrame:
    """``key, status``: in both, documented only, or in the code only."""
    a, b = documented.select(key).distinct().withColumn("__a", F.lit(1)), implemented.select(key).distinct().withColumn("__b", F.lit(1))
    status = F.when(F.col("__b").isNull(), "code-missing").when(F.col("__a").isNull(), "documentation-missing").otherwise("matched")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def first_ids(rows: DataFrame, group: list[str], id_col: str, most: int) -> DataFrame:
    """``group, n, ids, truncated``: the smallest ids of each group, at most ``most``, and whether there are more."""
    w = W.partitionBy(*group).orderBy(id_col)
    cut = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    ids = cut.groupBy(*group).agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
    n = rows.groupBy(*group).agg(F.count("*").alias("n"))
    return n.join(ids, group).withColumn("truncated", F.col("n") > most)


def token_estimate(text: Column | str) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")
