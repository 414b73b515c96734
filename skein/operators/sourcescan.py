"""Line-scan analyzers over source text: state machines, taint, locks, error checks, resources, faults, rules.

All take rows ``file, line_no, line`` and return bounded, ordered findings. What one line tells is a regular expression in
the JVM; what depends on the lines before is a window per file or, where a state is carried, one pandas pass per file.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fsm(lines: DataFrame, variable: str = "state") -> tuple[DataFrame, DataFrame]:
    """States (``file, state``) and transitions (``file, line_no, source, target, known``).

    States are members of enums; a transition is an assignment of a state to the variable, from the last ``case`` label
    before it. ``known`` tells whether the target is a member of an enum of the file.
    """
    member = F.regexp_extract("line", r"^\s*([A-Z][A-Z0-9_]+)\s*(?:=\s*\d+)?\s*,?\s*(?://.*)?$", 1)
    states = lines.select("file", member.alias("state")).where("state <> ''").distinct()
    case = F.nullif(F.regexp_extract("line", r"case\s+(?:\w+::)?([A-Z][A-Z0-9_]+)\s*:", 1), F.lit(""))
    target = F.regexp_extract("line", rf"\b{re.escape(variable)}\s*=\s*(?:\w+::)?([A-Z][A-Z0-9_]+)", 1)
    w = W.partitionBy("file").orderBy("line_no")
    moves = lines.withColumn("source", F.last(case, True).over(w)).withColumn("target", target).where("target <> ''")
    known = states.select("file", F.col("state").alias("target"), F.lit(True).alias("known"))
    return states, moves.join(known, ["file", "target"], "left").select("file", "line_no", "source", "target", F.coalesce("known", F.lit(False)).alias("known"))


def error_checks(lines: DataFrame, within: int = 8) -> DataFrame:
    """``file, line_no, source, checked_at``: calls that may fail and the first check of their result within some lines."""
    name = F.nullif(F.regexp_extract("line", r"(\w+)\s*=\s*\w+\(", 1), F.lit(""))
    src = lines.select("file", "line_no", name.alias("source")).where("source IS NOT NULL")
    test = F.nullif(F.regexp_extract("line", r"if\s*\(\s*!?\s*(\w+)", 1), F.lit(""))
    chk = lines.select("file", F.col("line_no").alias("c"), test.alias("source")).where("source IS NOT NULL")
    hit = src.join(chk, ["file", "source"]).where((F.col("c") > F.col("line_no")) & (F.col("c") <= F.col("line_no") + within)).groupBy("file", "source", "line_no").agg(F.min("c").alias("checked_at"))
    return src.join(hit, ["file", "source", "line_no"], "left").select("file", "line_no", "source", "checked_at")


def lock_inversions(lines: DataFrame) -> DataFrame:
    """``a, b, files``: locks that are taken in both orders, with the number of files that do either."""
    said = lines.select("file", "line_no", "line").where(F.col("line").rlike(r"\b(lock|unlock)\("))
    pairs = said.repartition("file").sortWithinPartitions("file", "line_no").mapInPandas(_lock_orders, "file string, outer string, inner string")
    # who takes two locks in either order is counted once for each file, so no file meets another
    per = pairs.groupBy(F.least("outer", "inner").alias("a"), F.greatest("outer", "inner").alias("b"), "file").agg(F.max(F.col("outer") < F.col("inner")).alias("there"), F.max(F.col("outer") > F.col("inner")).alias("back"))
    return per.groupBy("a", "b").agg(F.count("file").alias("files"), F.max("there").alias("there"), F.max("back").alias("back")).where("there AND back").select("a", "b", "files")


def _lock_orders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each pair of locks that a file takes one in the other; lines come sorted by file, and a file may span frames."""
    own, held, out = None, Counter(), set()

    def told() -> pd.DataFrame:
        return pd.DataFrame({"file": [own] * len(out), "outer": [a for a, _ in out], "inner": [b for _, b in out]}, dtype=object)

    for pdf in frames:
        for file, line in zip(pdf["file"], pdf["line"], strict=True):
            if file != own:
                if out:
                    yield told()
                own, held, out = file, Counter(), set()
            for op, name in re.findall(r"\b(lock|unlock)\(\s*&?(\w+)\s*\)", line):
                if op == "lock":
                    out.update((h, name) for h in held if h != name)
                    held[name] += 1
                elif held[name] > 1:
                    held[name] -= 1
                else:
                    del held[name]
    if out:
        yield told()


def taint(lines: DataFrame, sources: str, sanitizers: str, sinks: str, most: int | None = None) -> DataFrame:
    """``file, source_line, sink_line, variable``: values of a source call that reach a sink without a sanitizer.

    If ``most`` is given, the first of each file.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dirty: dict[str, int] = {}
        out = []
        for n, line in pdf.sort_values("line_no")[["line_no", "line"]].itertuples(index=False):
            m = re.match(r"\s*(?:\w+\s+)?(\w+)\s*=\s*(.+)", line)
            if m:
                name, value = m.groups()
                came = [dirty[v] for v in re.findall(r"\w+", value) if v in dirty]
                if re.search(sanitizers, value):
                    dirty.pop(name, None)
                elif re.search(sources, value):
                    dirty[name] = n
                elif came:
                    dirty[name] = min(came)
                else:
                    dirty.pop(name, None)
            k = re.search(sinks, line)
            if k and not re.search(sanitizers, line):
                out += [(dirty[v], n, v) for v in sorted(set(re.findall(r"\w+", line[k.end() :]))) if v in dirty]
        out = out[:most]
        return pd.DataFrame({"file": [pdf["file"].iloc[0]] * len(out), "source_line": [a for a, _, _ in out], "sink_line": [b for _, b, _ in out], "variable": [c for _, _, c in out]}, dtype=object)

    return lines.groupBy("file").applyInPandas(run, "file string, source_line long, sink_line long, variable string")


def resources(lines: DataFrame, acquire: str, release: str) -> DataFrame:
    """``file, name, acquired, released``: names by acquire and release patterns (one group each), paired in order."""
    w = W.partitionBy("file", "name").orderBy("line_no")
    a = lines.select("file", "line_no", F.regexp_extract("line", acquire, 1).alias("name")).where("name <> ''").withColumn("k", F.row_number().over(w))
    r = lines.select("file", F.col("line_no").alias("released"), F.regexp_extract("line", release, 1).alias("name")).where("name <> ''")
    r = r.withColumn("k", F.row_number().over(W.partitionBy("file", "name").orderBy("released")))
    return a.join(r, ["file", "name", "k"], "left").select("file", "name", F.col("line_no").alias("acquired"), "released")


def fault_branches(lines: DataFrame, call: str, after: int = 10) -> DataFrame:
    """``file, line_no, result, guarded, returns``: for each call of a target, whether a branch tests its result within
    some lines, and whether one of these lines returns."""
    name = F.regexp_extract("line", rf"(\w+)\s*=\s*{call}\(", 1)
    hit = lines.withColumn("result", name)
    w = W.partitionBy("file").orderBy("line_no").rangeBetween(1, after)
    seen = hit.withColumn("__next", F.concat_ws("\n", F.collect_list("line").over(w)))
    rows = seen.where("result <> ''")
    guarded = F.expr("__next rlike concat('if\\\\s*\\\\(\\\\s*!?\\\\s*', result)")
    return rows.select("file", "line_no", "result", guarded.alias("guarded"), F.col("__next").rlike(r"\breturn\b").alias("returns"))


def rule_hits(lines: DataFrame, rules: list[tuple[str, str, str]], most: int | None = None) -> DataFrame:
    """``category, rule, file, line_no`` of rules (category, name, pattern); if ``most`` is given, the first per category."""
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(c).alias("category"), F.lit(n).alias("rule"))) for c, n, p in rules]))
    r = lines.select("file", "line_no", F.explode(hits).alias("h")).select("h.category", "h.rule", "file", "line_no")
    if most is None:
        return r
    w = W.partitionBy("category").orderBy("file", "line_no", "rule")
    return r.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def pressure(lines: DataFrame, limits: str, uses: str, same_file: bool = False) -> DataFrame:
    """``name, limit_at, used_at, used_in``: constraints joined with the operations on what they bound, of all files or of
    the same."""
    a = lines.select(F.regexp_extract("line", limits, 1).alias("name"), F.concat_ws(":", "file", "line_no").alias("limit_at"), F.col("file").alias("used_in")).where("name <> ''")
    b = lines.select(F.regexp_extract("line", uses, 1).alias("name"), F.col("line_no").alias("used_at"), F.col("file").alias("used_in")).where("name <> ''")
    joined = a.join(b, ["name", "used_in"]) if same_file else a.drop("used_in").join(b, "name")
    return joined.select("name", "limit_at", "used_at", "used_in")


def boundary_segments(facts: DataFrame, most: int | None = None) -> DataFrame:
    """``trace, segment, kind, at``: handoff facts (trace, kind, at) in order, numbered; if ``most`` is given, the first of each trace."""
    w = W.partitionBy("trace").orderBy("at", "kind")
    out = facts.withColumn("segment", F.row_number().over(w)).select("trace", "segment", "kind", "at")
    return out if most is None else out.where(F.col("segment") <= most)


def coverage(findings: DataFrame, files: DataFrame, analyzers: list[str]) -> DataFrame:
    """``file`` and a count per analyzer, for every file."""
    p = findings.groupBy("file").pivot("analyzer", analyzers).agg(F.count(F.lit(1)))
    return files.select("file").distinct().join(p, "file", "left").na.fill(0)
