"""The query surface: guarded SQL over graph views, typed query documents, result tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from skein.sources import graph
from skein.sources.graph import Tables

MAX_ROWS = 5000
_READS = ("SELECT", "WITH", "VALUES", "FROM", "TABLE", "SHOW", "DESCRIBE", "EXPLAIN")


class QueryError(ValueError):
    """A query that is not allowed or not understood; ``code`` names why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def bare(sql: str) -> str:
    """The statement with comments, quoted strings and quoted names blanked, of equal length."""
    pattern = r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`"
    return re.sub(pattern, lambda m: " " * len(m.group()), sql, flags=re.S)


def top_level_limit(sql: str) -> int | None:
    """The number of a LIMIT outside brackets, strings and comments; None if there is none or it is no number."""
    depth, found = 0, None
    for m in re.finditer(r"[(\[{]|[)\]}]|\blimit\s+(\d+)", bare(sql), re.I):
        t = m.group()
        if t in "([{":
            depth += 1
        elif t in ")]}":
            depth -= 1
        elif depth == 0:
            found = int(m.group(1))
    return found


def check_read_only(sql: str) -> None:
    """Raises for anything but one reading statement."""
    plain = bare(sql).strip().rstrip(";").strip()
    if not plain:
        raise QueryError("empty", "no statement")
    if ";" in plain:
        raise QueryError("several", "one statement at a time")
    if not plain.upper().startswith(_READS):
        raise QueryError("write", "only reading statements are allowed")
    if re.search(r"\b(insert\s+(into|overwrite)|create\s|drop\s|alter\s|truncate\s|merge\s+into|delete\s+from|update\s+\w+\s+set|load\s+data|refresh\s|cache\s)", plain, re.I):
        raise QueryError("write", "only reading statements are allowed")


def sql(spark: SparkSession, statement: str, args: dict | None = None, cap: int = MAX_ROWS) -> DataFrame:
    """Run a reading statement with named parameters; results over ``cap`` rows are cut there unless a lower LIMIT is set."""
    check_read_only(statement)
    df = spark.sql(statement.rstrip().rstrip(";"), args=args or {})
    limit = top_level_limit(statement)
    return df if limit is not None and limit <= cap else df.limit(cap)


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views ``nodes`` and ``edges`` over the tables of a folder."""
    t = Tables(spark, sf_dir)
    graph.nodes(t).createOrReplaceTempView("nodes")
    graph.edges(t).createOrReplaceTempView("edges")


@dataclass
class TypedQuery:
    """Lines of ``kind: value``; filters as (field, operator, value)."""

    intent: str | None = None
    filters: list[tuple[str, str, str]] = field(default_factory=list)
    lanes: dict[str, list[str]] = field(default_factory=dict)


LANES = ("symbol", "file", "lex", "vec", "graph", "hyde")


def parse_typed_query(text: str) -> TypedQuery | None:
    """The typed query in a text, or None if no line has a known kind. Unknown kinds, empty values, repeated intents and
    malformed filters raise."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if not any(re.match(r"(intent|filter|%s)\s*:" % "|".join(LANES), x) for x in lines):
        return None
    out = TypedQuery()
    for line in lines:
        m = re.match(r"(\w+)\s*:\s*(.*)$", line)
        if not m:
            raise QueryError("untyped-line", f"no kind: {line}")
        kind, value = m.groups()
        if not value:
            raise QueryError("empty-value", f"{kind} has no value")
        if kind == "intent":
            if out.intent is not None:
                raise QueryError("repeated-intent", "one intent only")
            out.intent = value
        elif kind == "filter":
            f = re.match(r"(\w+)\s*(!=|=|~)\s*(.+)$", value)
            if not f:
                raise QueryError("bad-filter", value)
            out.filters.append(f.groups())
        elif kind in LANES:
            out.lanes.setdefault(kind, []).append(value)
        else:
            raise QueryError("unknown-kind", kind)
    return out


def apply_filters(df: DataFrame, filters: list[tuple[str, str, str]]) -> DataFrame:
    """Typed filters as column predicates: equal, not equal (nulls pass), or a regular expression."""
    for name, op, value in filters:
        c = df[name].cast("string")
        df = df.where(c == value if op == "=" else ~c.eqNullSafe(value) if op == "!=" else c.rlike(value))
    return df


def markdown(df: DataFrame, cap: int = 100) -> str:
    """The first rows as a Markdown table."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = df.limit(cap).collect()
    head = "| " + " | ".join(df.columns) + " |"
    return "\n".join([head, "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
