"""Resolution of references and imports over the relational fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import resolution
from skein.sources import graph as G
from skein.sources.graph import Tables

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


@query("""WITH c AS (SELECT l_orderkey AS ref, l_partkey || '/' || l_suppkey AS def, ['local', 'import', 'reexport', 'namespace', 'wildcard', 'global-qualified', 'global-name'][(l_partkey % 7 + 1)::INT] AS origin, (l_partkey % 7)::INT AS place,
  l_suppkey % 3 = 0 AND l_partkey % 7 BETWEEN 1 AND 4 AS unlinked, (l_linenumber - 1)::INT AS scope, CASE WHEN l_suppkey % 4 = 0 THEN (l_quantity::INT % 8)::INT END AS mro, l_discount > 0.05 AS own, CASE WHEN l_tax < 0.02 THEN 'incompatible' WHEN l_tax < 0.05 THEN 'unknown' ELSE 'compatible' END AS arity, l_quantity > 45 AS dyn FROM lineitem),
w AS (SELECT *, least(1000, greatest(0, [550, 450, 400, 400, 300, 350, 100][place + 1] * CASE WHEN unlinked THEN 0.5 ELSE 1 END - 20 * scope + CASE WHEN mro IS NULL THEN 0 ELSE [500, 420, 360, 320, 300][least(mro, 4) + 1] END + CASE WHEN own THEN 200 ELSE 0 END + CASE arity WHEN 'compatible' THEN 100 WHEN 'incompatible' THEN -150 ELSE 0 END + CASE WHEN dyn THEN 20 ELSE 0 END)) AS conf,
  count(*) FILTER (arity = 'compatible') OVER (PARTITION BY ref) > 0 AS sure FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY conf DESC, scope, coalesce(mro, 0), place, def) AS r, count(*) OVER (PARTITION BY ref) AS n FROM w WHERE NOT (sure AND arity = 'incompatible'))
SELECT ref, def, (conf / 1000.0)::DOUBLE AS confidence, n AS candidates FROM k WHERE r = 1""")
def evidence_resolution(t: Tables) -> DataFrame:
    """Which line each order means, lines being candidates with evidence of every kind."""
    n = F.col("l_partkey") % 7
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("ref"), F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("def"),
        F.element_at(F.array(*map(F.lit, resolution.ORIGINS)), (n + 1).cast("int")).alias("origin"), ((F.col("l_suppkey") % 3 == 0) & n.between(1, 4)).alias("unlinked"),
        (F.col("l_linenumber") - 1).cast("int").alias("scope_depth"), F.when(F.col("l_suppkey") % 4 == 0, F.col("l_quantity").cast("int") % 8).alias("mro_depth"), (F.col("l_discount") > 0.05).alias("owner_match"),
        F.when(F.col("l_tax") < 0.02, "incompatible").when(F.col("l_tax") < 0.05, "unknown").otherwise("compatible").alias("arity"), (F.col("l_quantity") > 45).alias("dynamic"),
    )
    return resolution.resolve(rows)


_ENDINGS = ", ".join(f"({i}, '{e}')" for i, e in enumerate(resolution.ENDINGS))


@query(f"""WITH f AS (SELECT p_partkey AS pos, 'src/' || p_type || '/' || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || ['.ts', '/index.js', '.py', '.JAVA', ''][(p_partkey % 5 + 1)::INT] AS path, * FROM part),
w AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem), e AS (SELECT DISTINCT a, b FROM w WHERE b IS NOT NULL),
i AS (SELECT x.path AS file, CASE y.p_size % 4 WHEN 0 THEN '../' || replace(y.p_brand, '#', '') || '/' || replace(y.p_name, ' ', '_') WHEN 1 THEN 'app.' || lower(y.p_type) || '.' || replace(y.p_brand, '#', '') || '.' || replace(y.p_name, ' ', '_') WHEN 2 THEN replace(y.p_name, ' ', '_') || '.ts' ELSE 'lib/' || replace(y.p_name, ' ', '_') END AS target,
  y.p_size % 4 = 0 AS rel, CASE WHEN y.p_size % 3 = 0 THEN 'cpp' ELSE 'ts' END AS language FROM e JOIN f x ON x.p_partkey = a JOIN f y ON y.p_partkey = b),
d AS (SELECT DISTINCT file, target, language, rel FROM i),
k AS (SELECT *, CASE WHEN rel THEN list_aggregate(string_split(file, '/')[1 : len(string_split(file, '/')) - 2], 'string_agg', '/') || '/' || target[4:] WHEN contains(target, '/') OR language = 'cpp' THEN target ELSE replace(target, '.', '/') END AS key FROM d),
q AS (SELECT DISTINCT rel, key FROM k), t AS (SELECT rel, key, n AS i, list_aggregate(string_split(key, '/')[n:], 'string_agg', '/') AS tail FROM q, range(1, 9) r(n) WHERE n <= CASE WHEN rel THEN 1 ELSE len(string_split(key, '/')) END),
s AS (SELECT path, pos, n = 1 AS whole, list_aggregate(string_split(path, '/')[n:], 'string_agg', '/') AS suffix FROM f, range(1, 9) r(n) WHERE n <= len(string_split(path, '/'))),
x(nth, ending) AS (VALUES {_ENDINGS}),
m AS (SELECT rel, key, path, row_number() OVER (PARTITION BY rel, key ORDER BY i, nth, tail || ending <> suffix, pos) AS r FROM t CROSS JOIN x JOIN s ON lower(t.tail || x.ending) = lower(s.suffix) WHERE NOT rel OR (whole AND tail || ending = suffix))
SELECT file, target, language, path AS resolved FROM k LEFT JOIN m ON m.rel = k.rel AND m.key = k.key AND r = 1""")
def import_resolution(t: Tables) -> DataFrame:
    """Imports of parts that follow one another, by relative paths, packages and bare names, resolved to files of parts."""
    name, brand = F.replace("p_name", F.lit(" "), F.lit("_")), F.replace("p_brand", F.lit("#"), F.lit(""))
    ending = F.element_at(F.array(*map(F.lit, (".ts", "/index.js", ".py", ".JAVA", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    files = t.part.select(F.col("p_partkey").alias("pos"), F.concat_ws("/", F.lit("src"), "p_type", brand, F.concat(name, ending)).alias("path"), "p_size", "p_type", name.alias("name"), brand.alias("brand"))
    way = F.col("p_size") % 4
    target = F.when(way == 0, F.concat_ws("/", F.lit(".."), "brand", "name")).when(way == 1, F.concat_ws(".", F.lit("app"), F.lower("p_type"), "brand", "name")).when(way == 2, F.concat("name", F.lit(".ts"))).otherwise(F.concat(F.lit("lib/"), F.col("name")))
    language = F.when(F.col("p_size") % 3 == 0, "cpp").otherwise("ts")
    pair = G.follows(t).select(F.substring_index("src", ":", -1).cast("long").alias("a"), F.substring_index("dst", ":", -1).cast("long").alias("b"))
    imports = pair.join(files.select(F.col("pos").alias("a"), F.col("path").alias("file")), "a").join(files.select(F.col("pos").alias("b"), target.alias("target"), language.alias("language")), "b")
    return resolution.resolve_imports(imports.select("file", "target", "language").distinct(), files.select("path", "pos"))


@query()
def binding_propagation(t: Tables) -> DataFrame:
    """Names of parts carried along orders: every part exports its brand's and its type's name if it is large, binds one of
    the part that follows it first, and all of the part that follows it last."""
    f = t.part.select(F.col("p_partkey").alias("file"), "p_brand", "p_type", "p_size")
    big = f.where("p_size > 25")
    exports = big.select("file", F.col("p_brand").alias("name"), F.col("p_type").alias("type")).unionByName(big.select("file", F.col("p_type").alias("name"), F.col("p_brand").alias("type")))
    pair = G.follows(t).select(F.substring_index("src", ":", -1).cast("long").alias("file"), F.substring_index("dst", ":", -1).cast("long").alias("source")).where("file <> source")
    ends = pair.groupBy("file").agg(F.min("source").alias("first"), F.max("source").alias("last"))
    named = ends.join(f.select(F.col("file").alias("first"), "p_type"), "first").select("file", F.col("p_type").alias("local"), F.col("first").alias("source"), F.col("p_type").alias("name"), F.lit(0).alias("pos"), (F.col("file") % 3 != 0).alias("reexport"))
    wild = ends.select("file", F.col("last").alias("source"), F.lit(1).alias("pos"), (F.col("file") % 2 == 0).alias("reexport"))
    return resolution.propagate_bindings(exports, named, wild)
