"""Queries on pairs of edges, in shares and without rows that the result doesn't hold."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import blocks, traversal
from skein.plans import graph_queries
from tests.oracle import connect, differences
from tests.test_skew import SF, largest_rows


@pytest.mark.parametrize("name", ["diamond_pattern_whole", "neighbourhood_two_hops_whole", "diamond_pattern", "neighbourhood_two_hops"])
def test_equal_to_sql(spark, monkeypatch, name):
    monkeypatch.setattr(traversal, "PAIRS", 20_000)
    assert differences(spark, connect(SF), SF, graph_queries.QUERIES[name], graph_queries.SQL[name]) == ""


def test_diamonds_form_no_paths_of_three(spark):
    df = graph_queries.QUERIES["diamond_pattern_whole"](spark, SF)
    f = graph_queries.G.follows(graph_queries.Tables(spark, SF))
    two = f.select("src", F.col("dst").alias("m")).join(f.select(F.col("src").alias("m"), "dst"), "m").count()
    assert largest_rows(spark, df) <= max(two, df.count()) + two


def test_rounds_use_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(traversal, "stage", lambda *a, **k: pytest.fail("a round that may broadcast"))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert {r.id: r.scc for r in traversal.strong_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


@pytest.mark.parametrize("size", [1, 40, 1_000_000])
def test_strong_components_whatever_lies_in_blocks(spark, monkeypatch, size):
    r = random.Random(5)
    rows = [(100 * c + r.randrange(n), 100 * c + r.randrange(n)) for c, n in enumerate([3, 8, 20, 30, 40]) for _ in range(n + n // 3)] + [(900, 900)]
    reach = {a: {a} for e in rows for a in e}
    for _ in reach:
        for a, b in rows:
            reach[a] |= reach[b]
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach}
    monkeypatch.setattr(blocks, "BLOCK", size)
    if size > 100:  # nothing is left to rounds
        monkeypatch.setattr(traversal, "_by_colours", lambda e: pytest.fail("rounds over small components"))
    got = traversal.strong_components(spark.createDataFrame(rows, "src long, dst long"))
    assert {x.id: x.scc for x in got.collect()} == want


@pytest.mark.parametrize("size", [20, 1_000_000])
def test_hops_and_diamonds_whatever_lies_in_blocks(spark, monkeypatch, size):
    r = random.Random(6)
    rows = sorted({(100 * c + r.randrange(n), 100 * c + r.randrange(n)) for c, n in enumerate([4, 6, 15]) for _ in range(3 * n)} | {(900, 900)})
    strong = {e: i % 3 > 0 for i, e in enumerate(rows)}
    monkeypatch.setattr(blocks, "BLOCK", size)
    if size > 100:  # no rows of pairs are shuffled
        monkeypatch.setattr(traversal, "_in_shares", lambda *a: pytest.fail("joins over small components"))
    got = traversal.diamonds(spark.createDataFrame([(*e, s) for e, s in strong.items()], "src long, dst long, strong boolean"))
    want = [(a, b, c, d) for a, b in rows for b2, d in rows if b2 == b and a != d and strong[a, b] and strong[b, d] for a2, c in rows if a2 == a and c != b and (c, d) in strong]
    assert sorted(tuple(x) for x in got.select("a", "b", "c", "d").collect()) == sorted(want)
    near = {i: {a + b - i for a, b in rows if i in (a, b) and a != b} for e in rows for i in e}
    want = {i: len(set().union(n, *(near[j] for j in n)) - {i}) for i, n in near.items() if n}
    assert {x.id: x.within_two for x in traversal.within_two(spark.createDataFrame(rows, "src long, dst long")).collect()} == want
