"""Queries of stateful, streaming, hierarchy and line-scan operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import hierarchy, packing, sourcescan
from skein.sources.graph import Tables
from skein.streaming import state

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1, 2""")
def streaming_tumbling_counts(t: Tables) -> DataFrame:
    """Six-hour windows of a stream, each window's last update."""
    s = state.tumbling_counts(state.read_events(t.spark, f"{t.folder}/events.parquet"), "6 hours", "1 day")
    got = state.drain(s, "update", ["start", "event_type"])
    return got.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS changes, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id""")
def streaming_projection(t: Tables) -> DataFrame:
    """The event log folded by a stateful stream."""
    got = state.drain(state.projection(state.read_events(t.spark, f"{t.folder}/events.parquet")), "update", ["user_id"])
    return got.select("user_id", "status", "changes", "errors")


@query("""SELECT user_id, event_type, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, event_type, s, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def session_windows(t: Tables) -> DataFrame:
    """Sessions with gaps of twelve hours."""
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", "event_type", F.session_window("ts", "12 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id", "event_type").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("SELECT p_brand AS grp, count(*) AS offered, sum(p_size)::BIGINT AS weight FROM part GROUP BY 1")
def budget_groups(t: Tables) -> DataFrame:
    """What is offered to the token budget of each group."""
    return t.part.groupBy(F.col("p_brand").alias("grp")).agg(F.count("*").alias("offered"), F.sum("p_size").alias("weight"))


@query()
def token_budget_packing(t: Tables) -> DataFrame:
    """Greedy packing under a budget of 500 per brand: what does not fit is skipped, later smaller items may fit."""
    items = t.part.select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("cost"), F.col("p_retailprice").alias("score"))
    return packing.pack_budget(items, 500)


@query("""WITH k AS (SELECT user_id, event_type, (props->>'k')::INT % 10 AS key, event_id, ts FROM events), d AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, key ORDER BY ts, event_id) AS r FROM k)
SELECT user_id, event_type, key, event_id, count(*) OVER (PARTITION BY user_id, event_type, key) AS coalesced FROM d QUALIFY r = 1""")
def request_coalescing(t: Tables) -> DataFrame:
    """Requests of one key share the first: which it is and how many it serves."""
    k = t.events.select("user_id", "event_type", (F.get_json_object("props", "$.k").cast("int") % 10).alias("key"), "event_id", "ts")
    return k.groupBy("user_id", "event_type", "key").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("coalesced"))


@query("""WITH c AS (SELECT (SELECT epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2 FROM events) AS cut), a AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events, c WHERE epoch_us(ts) <= cut GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events GROUP BY 1)
SELECT b.user_id AS user_id, CASE WHEN a.s IS NULL THEN 'added' WHEN a.s <> b.s THEN 'changed' ELSE 'same' END AS change FROM b LEFT JOIN a ON a.user_id = b.user_id""")
def session_diff(t: Tables) -> DataFrame:
    """Status at half time against the end."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    cut = t.events.agg((F.min(us) + F.floor((F.max(us) - F.min(us)) / 2)).alias("cut"))
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    e = t.events.crossJoin(F.broadcast(cut))  # one row
    m = e.groupBy("user_id").agg(F.max_by(F.when(us <= F.col("cut"), F.col("event_type")), F.when(us <= F.col("cut"), F.struct("ts", "event_id"))).alias("a"), last.alias("b"))
    return m.select("user_id", F.when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("change"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events) SELECT user_id, CASE WHEN max(ts) >= (SELECT now FROM n) - INTERVAL 6 HOUR THEN 'fresh' WHEN max(ts) >= (SELECT now FROM n) - INTERVAL 24 HOUR THEN 'stale' ELSE 'expired' END AS freshness FROM events GROUP BY 1""")
def freshness_states(t: Tables) -> DataFrame:
    """Fresh, stale or expired by the age of the last event."""
    now = t.events.agg(F.max("ts").alias("now"))
    m = t.events.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(now))  # one row
    return m.select("user_id", F.when(F.col("last") >= F.col("now") - F.expr("INTERVAL 6 HOUR"), "fresh").when(F.col("last") >= F.col("now") - F.expr("INTERVAL 24 HOUR"), "stale").otherwise("expired").alias("freshness"))


# --- hierarchies ------------------------------------------------------------------------------------------------------

# Customers inherit from their nation and their segment, in an order by parity; nations from regions, and all from O.
MRO_SQL = """mro AS (SELECT 'C' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN ['C' || c_custkey, 'N' || n_nationkey, 'R' || n_regionkey, 'S' || c_mktsegment, 'O']
  ELSE ['C' || c_custkey, 'S' || c_mktsegment, 'N' || n_nationkey, 'R' || n_regionkey, 'O'] END AS mro FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'N' || n_nationkey, ['N' || n_nationkey, 'R' || n_regionkey, 'O'] FROM nation UNION ALL SELECT DISTINCT 'R' || n_regionkey, ['R' || n_regionkey, 'O'] FROM nation
  UNION ALL SELECT DISTINCT 'S' || c_mktsegment, ['S' || c_mktsegment, 'O'] FROM customer UNION ALL SELECT 'O', ['O']),
methods AS (SELECT 'N' || n_nationkey AS owner, 'run' AS method FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT DISTINCT 'S' || c_mktsegment, 'run' FROM customer WHERE length(c_mktsegment) % 2 = 0
  UNION ALL SELECT DISTINCT 'R' || n_regionkey, 'init' FROM nation WHERE n_regionkey % 2 = 0 UNION ALL SELECT 'C' || c_custkey, 'run' FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'O', 'run' UNION ALL SELECT 'O', 'init'),
spots AS (SELECT id, method, owner, pos FROM (SELECT id, unnest(mro) AS owner, generate_subscripts(mro, 1) AS pos FROM mro) JOIN methods USING (owner))"""


def class_parents(t: Tables) -> DataFrame:
    """``child, parent, pos``: the customers' hierarchy."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name = lambda mark, column: F.concat(F.lit(mark), F.col(column).cast("string"))
    even = (F.col("c_custkey") % 2 == 0).cast("int")
    up = c.select(name("C", "c_custkey").alias("child"), F.explode(F.array(F.struct(name("N", "n_nationkey").alias("parent"), (2 - even).alias("pos")), F.struct(name("S", "c_mktsegment").alias("parent"), (1 + even).alias("pos")))).alias("p"))
    rows = up.select("child", "p.parent", "p.pos").unionByName(t.nation.select(name("N", "n_nationkey").alias("child"), name("R", "n_regionkey").alias("parent"), F.lit(1).alias("pos")))
    tops = t.nation.select(name("R", "n_regionkey").alias("child")).unionByName(t.customer.select(name("S", "c_mktsegment").alias("child"))).distinct()
    return rows.unionByName(tops.select("child", F.lit("O").alias("parent"), F.lit(1).alias("pos")))


def class_methods(t: Tables) -> DataFrame:
    """``owner, method`` of the customers' hierarchy."""
    own = lambda df, mark, column, method: df.select(F.concat(F.lit(mark), F.col(column).cast("string")).alias("owner"), F.lit(method).alias("method")).distinct()
    rows = own(t.nation.where("n_nationkey % 3 = 0"), "N", "n_nationkey", "run").unionByName(own(t.customer.where("length(c_mktsegment) % 2 = 0"), "S", "c_mktsegment", "run"))
    rows = rows.unionByName(own(t.nation.where("n_regionkey % 2 = 0"), "R", "n_regionkey", "init")).unionByName(own(t.customer.where("c_custkey % 10 = 0"), "C", "c_custkey", "run"))
    return rows.unionByName(t.spark.createDataFrame([("O", "run"), ("O", "init")], "owner string, method string"))


@query(f"WITH {MRO_SQL} SELECT id, array_to_string(mro, ',') AS mro FROM mro")
def c3_linearisation(t: Tables) -> DataFrame:
    """Linearised ancestors of every class; null where inconsistent or cyclic."""
    return hierarchy.linearise(class_parents(t)).select("id", F.array_join("mro", ",").alias("mro"))


@query(f"WITH {MRO_SQL} SELECT id, method, arg_min(owner, pos) AS owner FROM spots GROUP BY id, method")
def method_lookup(t: Tables) -> DataFrame:
    """The class in whose method each name resolves."""
    return hierarchy.lookup(hierarchy.linearise(class_parents(t)), class_methods(t))


# --- source lines -----------------------------------------------------------------------------------------------------

# Each user's events, in order, as the lines of a file: what a line says goes by the kind and number of the event.
LINES = (
    ("click", 4, 0, "b", 5, " = open(p);"), ("click", 4, 1, "b", 5, " = recv(s);"), ("click", 4, 2, "S", 7, ","), ("click", 4, 3, "state = S", 7, ";"),
    ("view", 4, 0, "if (b", 5, " < 0) return -1;"), ("view", 4, 1, "case S", 7, ":"), ("view", 4, 2, "switch (state) { // ", 7, ""), ("view", 4, 3, "return; // ", 7, ""),
    ("signup", 2, 0, "b0 = escape(b", 5, ");"), ("signup", 2, 1, "b1 = b", 5, ";"), ("purchase", 2, 0, "exec(b", 5, ");"), ("purchase", 2, 1, "close(b", 5, ");"),
    ("error", 2, 0, "lock(l", 3, ");"), ("error", 2, 1, "unlock(l", 3, ");"),
)
VALUES = "src AS (SELECT 'user' || user_id AS file, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS line_no, CASE " + " ".join(f"WHEN event_type = '{k}' AND event_id % {m} = {r} THEN '{a}' || (event_id % {n}) || '{z}'" for k, m, r, a, n, z in LINES) + " ELSE '' END AS line FROM events)"


def _source(t: Tables) -> DataFrame:
    line = F.lit("")
    for k, m, r, a, n, z in reversed(LINES):
        line = F.when((F.col("event_type") == k) & (F.col("event_id") % m == r), F.concat(F.lit(a), (F.col("event_id") % n).cast("string"), F.lit(z))).otherwise(line)
    order = W.partitionBy("user_id").orderBy("event_id")
    return t.events.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("file"), F.row_number().over(order).alias("line_no"), line.alias("line"))


@query(rf"""WITH {VALUES}, states AS (SELECT DISTINCT file, regexp_extract(line, '^\s*([A-Z][A-Z0-9_]+)\s*(?:=\s*\d+)?\s*,?\s*(?://.*)?$', 1) AS state FROM src),
m AS (SELECT file, line_no, last_value(nullif(regexp_extract(line, 'case\s+(?:\w+::)?([A-Z][A-Z0-9_]+)\s*:', 1), '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS source, regexp_extract(line, '\bstate\s*=\s*(?:\w+::)?([A-Z][A-Z0-9_]+)', 1) AS target FROM src)
SELECT m.file AS file, line_no, source, target, s.state IS NOT NULL AS known FROM m LEFT JOIN states s ON s.file = m.file AND s.state = m.target WHERE target <> ''""")
def fsm_transitions(t: Tables) -> DataFrame:
    """State transitions of every file and whether their target is known."""
    return sourcescan.fsm(_source(t))[1]


@query()
def taint_trace(t: Tables) -> DataFrame:
    """Received bytes that reach a call unescaped."""
    return sourcescan.taint(_source(t), r"\brecv\(", r"\bescape\(", r"\bexec\(")


@query()
def lock_inversions(t: Tables) -> DataFrame:
    """Locks that are taken in both orders."""
    return sourcescan.lock_inversions(_source(t))


@query(f"WITH {VALUES}, s AS (SELECT file, line_no, regexp_extract(line, '(\\w+)\\s*=\\s*\\w+\\(', 1) AS source FROM src), c AS (SELECT file, line_no AS c, regexp_extract(line, 'if\\s*\\(\\s*!?\\s*(\\w+)', 1) AS source FROM src) SELECT s.file AS file, s.line_no AS line_no, s.source AS source, min(c) AS checked_at FROM s LEFT JOIN c ON c.file = s.file AND c.source = s.source AND c.c > s.line_no AND c.c <= s.line_no + 8 WHERE s.source <> '' GROUP BY 1, 2, 3")
def error_topology(t: Tables) -> DataFrame:
    """Calls whose result is checked, and where."""
    return sourcescan.error_checks(_source(t))


@query(rf"""WITH {VALUES}, a AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY line_no) AS k FROM (SELECT file, line_no, regexp_extract(line, '(\w+)\s*=\s*open\(', 1) AS name FROM src) WHERE name <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY line_no) AS k FROM (SELECT file, line_no, regexp_extract(line, 'close\((\w+)\)', 1) AS name FROM src) WHERE name <> '')
SELECT a.file AS file, a.name AS name, a.line_no AS acquired, r.line_no AS released FROM a LEFT JOIN r ON r.file = a.file AND r.name = a.name AND r.k = a.k""")
def resource_facts(t: Tables) -> DataFrame:
    """Acquired and released descriptors."""
    return sourcescan.resources(_source(t), r"(\w+)\s*=\s*open\(", r"close\((\w+)\)")


@query(rf"""WITH {VALUES}, n AS (SELECT file, line_no, regexp_extract(line, '(\w+)\s*=\s*open\(', 1) AS result, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), '') AS nxt FROM src)
SELECT file, line_no, result, regexp_matches(nxt, 'if\s*\(\s*!?\s*' || result) AS guarded, regexp_matches(nxt, '\breturn\b') AS returns FROM n WHERE result <> ''""")
def fault_simulation(t: Tables) -> DataFrame:
    """What happens if a call fails."""
    return sourcescan.fault_branches(_source(t), "open")


@query(rf"""WITH {VALUES}, a AS (SELECT regexp_extract(line, 'if \((\w+) < 0', 1) AS name, file || ':' || line_no AS limit_at, file FROM src), b AS (SELECT regexp_extract(line, 'exec\((\w+)', 1) AS name, line_no AS used_at, file FROM src)
SELECT a.name AS name, limit_at, used_at, b.file AS used_in FROM a JOIN b ON a.name = b.name AND a.file = b.file WHERE a.name <> ''""")
def pressure_impact(t: Tables) -> DataFrame:
    """Checks of a value's range and the uses of it in the same file."""
    return sourcescan.pressure(_source(t), r"if \((\w+) < 0", r"exec\((\w+)", same_file=True)


LINE_RULES = [("memory", "open", r"\bopen\("), ("memory", "close", r"\bclose\("), ("flow", "switch", r"\bswitch\b"), ("flow", "return", r"\breturn\b")]


@query(f"WITH {VALUES} " + " UNION ALL ".join(f"SELECT '{c}' AS category, '{n}' AS rule, file, line_no FROM src WHERE regexp_matches(line, '{p}')" for c, n, p in LINE_RULES))
def systems_rules(t: Tables) -> DataFrame:
    """Rule hits by category."""
    return sourcescan.rule_hits(_source(t), LINE_RULES)


@query("SELECT user_id AS trace, segment::INT AS segment, event_type AS kind, event_id AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type) AS segment FROM events WHERE event_type IN ('click', 'purchase')) WHERE segment <= 50")
def boundary_trace(t: Tables) -> DataFrame:
    """Handoffs in order, numbered per trace: the first 50 of each."""
    return sourcescan.boundary_segments(_handoffs(t), 50)


@query()
def boundary_trace_whole(t: Tables) -> DataFrame:
    """All handoffs in order, numbered per trace; ``boundary_trace`` stops at 50."""
    return sourcescan.boundary_segments(_handoffs(t))


def _handoffs(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type").isin("click", "purchase")).select(F.col("user_id").alias("trace"), F.col("event_type").alias("kind"), F.col("event_id").alias("at"))


@query("SELECT source AS file, count(*) FILTER (quality = 0) AS low, count(*) FILTER (quality = 1) AS good FROM (SELECT DISTINCT source FROM documents) LEFT JOIN (SELECT source AS s, quality FROM documents JOIN labels USING (doc_id)) ON s = source GROUP BY 1")
def coverage_manifest(t: Tables) -> DataFrame:
    """Findings per file and analyzer, zeros included."""
    f = t.documents.join(t.labels, "doc_id").select(F.col("source").alias("file"), F.when(F.col("quality") == 0, "low").otherwise("good").alias("analyzer"))
    return sourcescan.coverage(f, t.documents.select(F.col("source").alias("file")), ["low", "good"])


@query("""WITH b AS (SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) SELECT c_nationkey AS nation, c_mktsegment AS segment, c_custkey AS keeper, n FROM b WHERE r = 1""")
def keyed_upsert(t: Tables) -> DataFrame:
    """One record per key: the smallest id, with how many it stands for."""
    w = W.partitionBy("c_nationkey", "c_mktsegment")
    b = t.customer.withColumn("r", F.row_number().over(w.orderBy("c_custkey"))).withColumn("n", F.count("*").over(w))
    return b.where("r = 1").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("keeper"), "n")
