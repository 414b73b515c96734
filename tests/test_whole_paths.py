"""Ranked paths follow all edges of a node unless a cap is given."""

from skein.operators import traversal
from skein.plans import registry


def test_paths_follow_all_edges(spark, tmp_path):
    edges = spark.createDataFrame([("a", f"b{i:02}", 1) for i in range(60)] + [("b59", "c", 3), ("c", "d", 4), ("d", "e", 8)], "src string, dst string, weight long")
    seeds = spark.createDataFrame([(0, "a")], "seed int, id string")
    got = {r.id: (r.depth, r.score) for r in traversal.strongest_paths(edges, seeds).collect()}
    assert got == {f"b{i:02}": (1, 1.0) for i in range(60)} | {"c": (2, 1.5), "d": (3, 4 / 3), "e": (4, 2.0)}
    assert traversal.strongest_paths(edges, seeds, per_node=50).count() == 50


def test_whole_query_follows_more_than_ten_edges(spark, tmp_path):
    rows = [(i, n, p) for i in range(12) for n, p in ((1, 1), (2, 100 + i))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert registry.queries()["graph_path_scores_whole"](spark, str(tmp_path)).count() == 12
