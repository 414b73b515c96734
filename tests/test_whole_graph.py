"""Graph queries on all part-to-part edges, against brute force on a small fixture whose edges were nearly all seen once."""

import random

import pytest

from skein.plans import registry

QUERIES = registry.queries()
PARTS = 24


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    r = random.Random(5)
    lines = [(o, n, r.randint(1, PARTS - 4)) for o in range(9) for n in range(1, 4)]
    lines += [(100, 1, 21), (100, 2, 22), (100, 3, 23)]  # a chain apart; part 24 is in no order
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{at}/lineitem.parquet")
    parts = [(p, 50 if p == 21 else 1, "ECONOMY") for p in range(1, PARTS + 1)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_type string").write.parquet(f"{at}/part.parquet")
    return at


@pytest.fixture(scope="module")
def edges(spark, folder):
    per = {}
    for r in sorted(spark.read.parquet(f"{folder}/lineitem.parquet").collect()):
        per.setdefault(r.l_orderkey, []).append(f"Part:{r.l_partkey}")
    return {e for v in per.values() for e in zip(v, v[1:], strict=False)}


def closure(edges, both_ways=False):
    """The nodes behind each node, over one edge or more."""
    if both_ways:
        edges = edges | {(b, a) for a, b in edges}
    nodes = {n for e in edges for n in e}
    out = {n: {b for a, b in edges if a == n} for n in nodes}
    while True:
        new = {n: s | {y for x in s for y in out[x]} for n, s in out.items()}
        if new == out:
            return out
        out = new


def got(spark, folder, name):
    return [tuple(r) for r in QUERIES[name](spark, folder).collect()]


def test_components_have_all_nodes(spark, folder, edges):
    want = {n: min(s | {n}) for n, s in closure(edges, True).items()}
    assert dict(got(spark, folder, "connected_components_whole")) == want


def test_strong_components_and_cycles(spark, folder, edges):
    reach = closure(edges)
    want = {n: min({m for m in s if n in reach[m]} | {n}) for n, s in reach.items()}
    assert dict(got(spark, folder, "strongly_connected_whole")) == want
    sizes = {c: sum(v == c for v in want.values()) for c in want.values()}
    loops = {a for a, b in edges if a == b}
    on = loops | {n for n, c in want.items() if sizes[c] > 1}
    assert got(spark, folder, "cycle_summary_whole") == [(sum(n > 1 for n in sizes.values()), len(loops), len(on))]


def test_levels(spark, folder, edges):
    reach = closure(edges)
    bad = {n for n, s in reach.items() if n in s}
    bad |= {m for n in bad for m in reach[n]}
    level = {}
    while len(level) < len(reach) - len(bad):
        done = set(level)
        level |= {n: max((level[a] + 1 for a, b in edges if b == n), default=0) for n in reach if n not in bad | done and all(a in done for a, b in edges if b == n)}
    last = max(level.values(), default=-1) + 1
    assert dict(got(spark, folder, "topological_levels_whole")) == level | dict.fromkeys(bad, last)


def test_parts_preceded_once_are_not_dead(spark, folder, edges):
    kind = dict(got(spark, folder, "dead_code_whole"))
    assert {p for p, k in kind.items() if k == "dead"} == set(kind) - {"Part:21"} - {b for _, b in edges}
    assert [kind[f"Part:{p}"] for p in (21, 22, 23, 24)] == ["entry-only", "entry-only", "entry-only", "dead"]
