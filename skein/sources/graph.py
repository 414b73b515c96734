"""Property-graph views of relational tables: nodes, typed edges, and the SQL that states the same."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tables:
    """The Parquet tables of one folder, read when asked for; Catalyst prunes columns and pushes filters into the scans.

    ``least_weight`` is the weight from which ``strong`` keeps an edge; at 1 it keeps all.
    """

    spark: SparkSession
    folder: str
    least_weight: int = 2

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def tag(label: str, key) -> F.Column:
    """A node id: the label, a colon and the key."""
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


def nodes(t: Tables) -> DataFrame:
    """``id, label, name, grp``: every entity, with the group it belongs to (region, nation or brand)."""
    parts = [
        t.region.select(tag("Region", "r_regionkey").alias("id"), F.lit("Region").alias("label"), F.col("r_name").alias("name"), F.lit("World").alias("grp")),
        t.nation.select(tag("Nation", "n_nationkey").alias("id"), F.lit("Nation").alias("label"), F.col("n_name").alias("name"), tag("Region", "n_regionkey").alias("grp")),
        t.customer.select(tag("Customer", "c_custkey").alias("id"), F.lit("Customer").alias("label"), F.col("c_name").alias("name"), tag("Nation", "c_nationkey").alias("grp")),
        t.supplier.select(tag("Supplier", "s_suppkey").alias("id"), F.lit("Supplier").alias("label"), F.col("s_name").alias("name"), tag("Nation", "s_nationkey").alias("grp")),
        t.part.select(tag("Part", "p_partkey").alias("id"), F.lit("Part").alias("label"), F.col("p_name").alias("name"), F.col("p_brand").alias("grp")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NODES_SQL = """nodes AS (
  SELECT 'Region:' || r_regionkey AS id, 'Region' AS label, r_name AS name, 'World' AS grp FROM region
  UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation', n_name, 'Region:' || n_regionkey FROM nation
  UNION ALL SELECT 'Customer:' || c_custkey, 'Customer', c_name, 'Nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier', s_name, 'Nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'Part:' || p_partkey, 'Part', p_name, p_brand FROM part)"""


def calls(t: Tables) -> DataFrame:
    """``src, dst, type, weight, confidence``: customers to the parts they ordered."""
    own = t.orders.select("o_orderkey", "o_custkey").join(t.lineitem.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    n = own.groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("weight"))
    return n.select(tag("Customer", "o_custkey").alias("src"), tag("Part", "l_partkey").alias("dst"), F.lit("CALLS").alias("type"), "weight", F.least(F.lit(1.0), F.col("weight") / 10.0).alias("confidence"))


CALLS_SQL = """calls AS (
  SELECT 'Customer:' || o_custkey AS src, 'Part:' || l_partkey AS dst, 'CALLS' AS type, count(*) AS weight, least(1.0, count(*) / 10.0) AS confidence
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey)"""


def uses(t: Tables) -> DataFrame:
    """``src, dst, type, weight, confidence``: parts to the suppliers that ship them."""
    n = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("weight"))
    return n.select(tag("Part", "l_partkey").alias("src"), tag("Supplier", "l_suppkey").alias("dst"), F.lit("USES").alias("type"), "weight", F.least(F.lit(1.0), F.col("weight") / 10.0).alias("confidence"))


USES_SQL = """uses AS (
  SELECT 'Part:' || l_partkey AS src, 'Supplier:' || l_suppkey AS dst, 'USES' AS type, count(*) AS weight, least(1.0, count(*) / 10.0) AS confidence
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def contains(t: Tables) -> DataFrame:
    """Membership edges: region to nation, nation to customer and supplier."""
    n = nodes(t).where(F.col("label").isin("Nation", "Customer", "Supplier"))
    return n.select(F.col("grp").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"), F.lit(1).cast("long").alias("weight"), F.lit(1.0).alias("confidence"))


CONTAINS_SQL = """contains_edges AS (
  SELECT grp AS src, id AS dst, 'CONTAINS' AS type, 1::BIGINT AS weight, 1.0 AS confidence FROM nodes WHERE label IN ('Nation', 'Customer', 'Supplier'))"""


def edges(t: Tables) -> DataFrame:
    """All typed edges."""
    return calls(t).unionByName(uses(t)).unionByName(contains(t))


EDGES_SQL = f"""{NODES_SQL}, {CALLS_SQL}, {USES_SQL}, {CONTAINS_SQL},
edges AS (SELECT * FROM calls UNION ALL SELECT * FROM uses UNION ALL SELECT * FROM contains_edges)"""


def follows(t: Tables) -> DataFrame:
    """``src, dst, weight``: part to part on the next line of the same order."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = t.lineitem.select(tag("Part", "l_partkey").alias("src"), tag("Part", F.lead("l_partkey").over(w)).alias("dst")).where("dst IS NOT NULL")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))


FOLLOWS_SQL = """follows AS (
  SELECT src, dst, count(*) AS weight FROM (
    SELECT 'Part:' || l_partkey AS src, 'Part:' || lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem)
  WHERE dst IS NOT NULL GROUP BY 1, 2)"""


def strong(t: Tables) -> DataFrame:
    """The part-to-part edges that were seen at least ``t.least_weight`` times: twice, unless the tables say else."""
    return follows(t).where(F.col("weight") >= t.least_weight)


STRONG_SQL = FOLLOWS_SQL + ", strong AS (SELECT * FROM follows WHERE weight >= 2)"
