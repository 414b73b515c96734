"""Queries whose rows crowd on few keys: as their SQL, and without forming pairs that the result doesn't hold."""

import pytest

from skein.operators import joins, sourcescan
from skein.plans import relational_queries, search_queries
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["contract_exact_match", "contract_fanout", "tiered_resolution", "recall_at_k"])
def test_equal_to_sql(spark, name):
    home = relational_queries if name in relational_queries.QUERIES else search_queries
    assert differences(spark, connect(SF), SF, home.QUERIES[name], home.SQL[name]) == ""


def largest_rows(spark, df):
    """Most rows that any step of the finished plan made."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        m = p.metrics().get("numOutputRows")
        most = max(most, m.get().value() if m.isDefined() else 0)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_files_of_the_same_inversion_do_not_meet(spark):
    rows = [(f"f{i}", n, line) for i in range(400) for n, line in enumerate(["lock(a);", "x", "lock(b);", "unlock(b);", "unlock(a);"] if i % 2 else ["lock(b); lock(a);", "unlock(c); unlock(a); unlock(b);", "lock(c);"])]
    df = sourcescan.lock_inversions(spark.createDataFrame(rows, "file string, line_no int, line string"))
    assert [tuple(r) for r in df.collect()] == [("a", "b", 400)]
    assert largest_rows(spark, df) <= len(rows)


def test_fanout_forms_no_pairs(spark):
    schema = "repo string, service int, contract_id string, uid long, confidence double"
    p = [("x", 0, f"t{i % 2}", i, 1.0) for i in range(300)] + [("x", 0, "t1", 0, 1.0), (None, 0, "t0", 999, 1.0), ("y", 0, "t0", 998, 1.0), ("x", 0, None, 997, 1.0)]
    c = [("y" if i % 3 else "x", 0, f"t{i % 2}", i, 1.0) for i in range(300)]
    df = joins.contract_fanout(spark.createDataFrame(p, schema), spark.createDataFrame(c, schema))
    links = {(a[3], b[3]) for a in p for b in c if a[2] == b[2] and a[0] and a[0] != b[0]}
    want = {}
    for u, v in sorted(links):
        want.setdefault(u, []).append(v)
    want = {u: (len(v), v[0]) for u, v in want.items()}
    assert {r.uid: (r.consumers, r.first) for r in df.collect()} == want
    assert largest_rows(spark, df) <= 4 * len(c)


def test_pairs_are_counted_by_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIRS", 50)
    rows = [(b, (b * 7 + i * i) % 40) for b in range(60) for i in range(5)]
    df = joins.basket_pairs(spark.createDataFrame(rows, "basket long, item long"), "basket", "item")
    want = {}
    for b in range(60):
        own = sorted({i for x, i in rows if x == b})
        for p in ((x, y) for x in own for y in own if x < y):
            want[p] = want.get(p, 0) + 1
    assert {(r.a, r.b): r.together for r in df.collect()} == want
    assert df.rdd.getNumPartitions() >= sum(want.values()) // 50
