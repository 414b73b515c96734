"""Operators on hand-made rows: cycles, ties, empty inputs, nulls."""

import pytest
from pyspark.sql import functions as F

from skein import api
from skein.functions import scalars
from skein.operators import analysis, components, hierarchy, joins, packing, rank, search, sourcescan, textops, traversal
from skein.plans import phases
from skein.sources import files


def edges(spark, pairs, weight=1):
    return spark.createDataFrame([(a, b, w[0] if w else weight) for a, b, *w in pairs], "src string, dst string, weight long")


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_components_chain_and_star(spark):
    e = edges(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("x", "y"), ("y", "x"), ("z", "z")])
    got = as_dict(components.connected_components(e), "id", "component")
    assert {got[f"n{i:02}"] for i in range(21)} == {"n00"}
    assert got["x"] == got["y"] == "x"


def test_components_empty(spark):
    assert components.connected_components(edges(spark, [])).count() == 0


def test_bfs_depth_cycle_and_cap(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")])
    seeds = spark.createDataFrame([("s", "a")], "seed string, id string")
    assert as_dict(traversal.bfs(e, seeds, 5), "id", "depth") == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert as_dict(traversal.bfs(e, seeds, 5, frontier_cap=1), "id", "depth") == {"a": 0, "b": 1, "c": 2}


def test_scc_and_levels(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("e", "a"), ("f", "f")])
    assert as_dict(traversal.strong_components(e), "id", "scc") == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "f"}
    assert as_dict(traversal.topological_levels(e), "id", "level") == {"e": 0, "a": 1, "b": 1, "c": 1, "d": 1, "f": 1}


@pytest.mark.parametrize("parts", ["1", "3"])
def test_pagerank_does_not_depend_on_partitions(spark, parts):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d")])
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = as_dict(rank.pagerank(e, iterations=50, tolerance=1e-12), "id", "score")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(got.values()) == pytest.approx(1.0)
    assert got["c"] > got["b"] and got["a"] == pytest.approx(got["d"])


def test_pagerank_without_seeds_restarts_nowhere(spark):
    none = spark.createDataFrame([], "id string")
    got = rank.pagerank(edges(spark, [("a", "b")]), iterations=3, tolerance=0, seeds=none, dangling=False, stop_when_no_seeds=True)
    assert as_dict(got, "id", "score") == {"a": 0.0, "b": 0.0}


def test_flows_keep_first_branches_without_repeats(spark):
    e = edges(spark, [("a", "b", 3), ("a", "c", 2), ("a", "d", 1), ("b", "a", 1), ("b", "e", 1), ("c", "e", 1)])
    got = traversal.flows(e, spark.createDataFrame([("a",)], "id string"), branching=2, max_depth=5, min_steps=3)
    assert {tuple(r.path) for r in got.collect()} == {("a", "b", "e"), ("a", "c", "e")}


def test_interval_join_counts_each_pair_once(spark):
    left = spark.createDataFrame([(1, 0, 100, "l1"), (1, 250, 260, "l2"), (2, 0, 9, "l3"), (1, 9, 3, "bad")], "k long, start long, end long, l string")
    right = spark.createDataFrame([(1, 90, 255, "r1"), (1, 101, 249, "r2"), (2, 10, 11, "r3")], "k long, start2 long, end2 long, r string")
    got = sorted((r.l, r.r) for r in joins.interval_overlap(left, right, ["k"], 25).collect())
    assert got == [("l1", "r1"), ("l2", "r1")]


@pytest.mark.parametrize(("glob", "path", "hit"), [("src/*.py", "src/a.py", True), ("src/*.py", "src/b/a.py", False), ("**/*.py", "a.py", True), ("**/*.py", "x/y/a.py", True), ("a?c", "abc", True), ("{a,b}/x", "b/x", True), ("a.c", "abc", False)])
def test_globs(spark, glob, path, hit):
    assert spark.createDataFrame([(path,)], "p string").where(F.col("p").rlike(joins.glob_to_regex(glob))).count() == int(hit)


def test_longest_prefix_ends_at_segments(spark):
    p = spark.createDataFrame([("a/b/c",), ("a/bc",), ("z",)], "path string")
    pre = spark.createDataFrame([("a",), ("a/b",)], "prefix string")
    assert as_dict(joins.longest_prefix(p, pre, "path", "prefix"), "path", "prefix") == {"a/b/c": "a/b", "a/bc": "a", "z": None}


def test_basket_pairs(spark):
    b = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (2, "y"), (2, "x"), (3, "z")], "o long, i string")
    assert [tuple(r) for r in joins.basket_pairs(b, "o", "i").collect()] == [("x", "y", 2)]


def test_budget_skips_and_continues(spark):
    items = spark.createDataFrame([("g", 1, 6, 9.0), ("g", 2, 5, 8.0), ("g", 3, 4, 7.0)], "grp string, id long, cost long, score double")
    assert sorted(r.id for r in packing.pack_budget(items, 10).collect()) == [1, 3]


def test_chunks_and_sections(spark):
    d = spark.createDataFrame([(1, "x" * 2500), (2, "short"), (3, "")], "k long, t string")
    got = [(r.k, r.chunk, r.start, r.end) for r in textops.chunk(d, "k", "t").orderBy("k", "chunk").collect()]
    assert got == [(1, 0, 0, 1200), (1, 1, 1080, 2280), (1, 2, 2160, 2500), (2, 0, 0, 5)]
    m = spark.createDataFrame([(1, 1, 1), (1, 2, None), (1, 3, 2), (1, 4, 1), (1, 5, None)], "k long, line_no int, level int")
    spans = {(r.start, r.end, r.parent) for r in textops.sections(m, "k").collect()}
    assert spans == {(1, 3, None), (3, 3, 1), (4, 5, None)}


def test_signal_clusters_are_transitive(spark):
    s = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c")], "k long, s string")
    assert as_dict(textops.signal_clusters(s, "k", "s"), "k", "cluster") == {1: 1, 2: 1, 3: 1, 4: 4}


CLASSES = [("A", "B", 1), ("A", "C", 2), ("B", "D", 1), ("C", "D", 1), ("D", "O", 1), ("X", "Y", 1), ("X", "Z", 2), ("Y", "Z", 1), ("Z", "O", 1), ("P", "Q", 1), ("Q", "P", 1)]
METHODS = [("A", "run"), ("B", "run"), ("C", "stop"), ("D", "run"), ("D", "stop"), ("O", "init"), ("Y", "go"), ("Z", "go"), ("X", "go")]
SOURCE = ["enum S {", "  IDLE,", "  RUNNING,", "  DONE", "};", "switch (state) {", "case IDLE: state = RUNNING; break;", "case RUNNING:", "  state = DONE;", "case DONE: state = BROKEN;", "}",
          "fd = open(path);", "if (fd < 0) return -1;", "n = read(fd);", "buf = recv(sock);", "cmd = buf;", "exec(cmd);", "safe = escape(buf);", "exec(safe);", "lock(a);", "lock(b);", "unlock(b);", "unlock(a);", "lock(b);", "lock(a);", "unlock(a);", "unlock(b);", "close(fd);"]


def test_c3(spark):
    assert hierarchy.merge_c3("A", ["B", "C"], [["B", "D"], ["C", "D"]]) == ["A", "B", "C", "D"]
    assert hierarchy.merge_c3("A", ["B", "C"], [["B"], ["C", "B"]]) is None  # B before C, and C before B
    mro = hierarchy.linearise(spark.createDataFrame(CLASSES, "child string, parent string, pos int"))
    got = as_dict(mro.select("id", F.array_join("mro", ",").alias("m")), "id", "m")
    assert got["A"] == "A,B,C,D,O" and got["X"] == "X,Y,Z,O" and got["P"] is None
    owners = {(r.id, r.method): r.owner for r in hierarchy.lookup(mro, spark.createDataFrame(METHODS, "owner string, method string")).collect()}
    assert owners["A", "stop"] == "C" and owners["A", "run"] == "A" and owners["B", "stop"] == "D"


def test_line_scans(spark):
    source = spark.createDataFrame([("a.c", i + 1, x) for i, x in enumerate(SOURCE)], "file string, line_no int, line string")
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert sorted(rows(sourcescan.fsm(source)[1])) == [("a.c", 7, "IDLE", "RUNNING", True), ("a.c", 9, "RUNNING", "DONE", True), ("a.c", 10, "DONE", "BROKEN", False)]
    assert rows(sourcescan.taint(source, r"\brecv\(", r"\bescape\(", r"\bexec\(")) == [("a.c", 15, 17, "cmd")]
    assert rows(sourcescan.lock_inversions(source)) == [("a", "b", 1)]
    assert rows(sourcescan.resources(source, r"(\w+)\s*=\s*open\(", r"close\((\w+)\)")) == [("a.c", "fd", 12, 28)]
    assert rows(sourcescan.fault_branches(source, "open")) == [("a.c", 12, "fd", True, True)]
    lines = spark.createDataFrame([("f", 1, "limit: pool"), ("f", 7, "use: pool")], "file string, line_no int, line string")
    assert sourcescan.pressure(lines, r"limit: (\w+)", r"use: (\w+)").collect()[0].used_at == 7


def test_bm25_prefers_rare_terms(spark):
    d = spark.createDataFrame([(1, "apple pear"), (2, "apple apple"), (3, "pear plum"), (4, None), (5, "")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "plum apple")], "query_id long, query string")
    got = [r.doc_id for r in search.bm25(d, q, 2).orderBy("rank").collect()]
    assert got == [3, 2]


def test_intent_weights_sum_to_one():
    assert all(sum(w.values()) == pytest.approx(1.0) for w in search.INTENT_WEIGHTS.values())


def test_scalars(spark):
    p = spark.createDataFrame([("src\\tests\\a.ts",), ("a/b_test.go",), ("src/a.ts",), (None,)], "p string")
    assert [r[0] for r in p.select(scalars.is_test_file(F.col("p"))).collect()] == [True, True, False, False]
    assert p.select(scalars.top_folder(F.col("p")).alias("t")).first().t == "src"
    t = spark.createDataFrame([("\x00\x01ab",), ("ok\r\nline",)], "t string")
    assert [r[0] for r in t.select(scalars.looks_binary(F.col("t"))).collect()] == [True, False]
    assert t.select(scalars.clean_text(F.col("t")).alias("t")).collect()[1].t == "ok\nline"
    assert t.select(scalars.capitalise(F.lit("aBC")).alias("t")).first().t == "ABC"


def test_files_commits_and_hunks(spark, tmp_path):
    (tmp_path / "a.py").write_text("print(1)\n")
    (tmp_path / "b.bin").write_bytes(bytes(range(32)) * 10)
    got = files.read_files(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.language) for r in got] == [("a.py", "python")]
    assert files.walk(spark, str(tmp_path), ignore=[r"\.bin$"]).count() == 1
    log = spark.createDataFrame([("s1\tann\t86400\na.py\nb.py\na.py\n",), ("",)], "value string")
    (c,) = files.commits(log).collect()
    assert (c.sha, c.author, c.files) == ("s1", "ann", ["a.py", "b.py"])
    diff = spark.createDataFrame([("--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n+l\n@@ -9 +10 @@\n--- a/y\n+++ b/y\n@@ -0,0 +5,2 @@\n",)], "value string")
    assert sorted(tuple(r) for r in files.hunks(diff).collect()) == [("x", 1, 3), ("x", 10, 10), ("y", 5, 6)]


def test_graph_sinks(spark, tmp_path):
    n = spark.createDataFrame([("a", "L"), ("b", "M")], "id string, label string")
    e = spark.createDataFrame([("a", "b", "T"), ("a", "zz", "T")], "src string, dst string, type string")
    files.write_graph(n, e, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 1 == spark.read.parquet(str(tmp_path / "g/rejects")).count()
    files.write_json(n, e, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).groupBy("kind").count().count() == 2


@pytest.mark.parametrize("bad", ["DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"])
def test_guard_rejects(spark, bad):
    with pytest.raises(api.QueryError):
        api.sql(spark, bad)


def test_guard_limits_and_parameters(spark):
    assert api.top_level_limit("SELECT * FROM (SELECT 1 LIMIT 3) -- LIMIT 4\n LIMIT 7") == 7
    assert api.top_level_limit("SELECT 'LIMIT 5' FROM (SELECT 1 LIMIT 3)") is None
    spark.range(20).createOrReplaceTempView("r20")
    assert api.sql(spark, "SELECT * FROM r20 WHERE id < :n", {"n": 15}, cap=9).count() == 9
    assert api.markdown(spark.range(1)) == "| id |\n| --- |\n| 0 |"


def test_typed_query(spark):
    q = api.parse_typed_query("intent: impact\nfilter: lang = fr\nlex: login form\nlex: user")
    assert (q.intent, q.filters, q.lanes) == ("impact", [("lang", "=", "fr")], {"lex": ["login form", "user"]})
    assert api.parse_typed_query("plain words") is None
    for bad in ("lex: a\nnoise", "lex:", "intent: a\nintent: b", "filter: x", "lex: a\nwhat: b"):
        with pytest.raises(api.QueryError):
            api.parse_typed_query(bad)
    d = spark.createDataFrame([("fr", 1), ("de", 2), (None, 3)], "lang string, n long")
    assert api.apply_filters(d, [("lang", "!=", "fr")]).count() == 2


def test_phases_order_cycle_and_dropping():
    log = []
    P = phases.Phase
    out = phases.run([P("c", lambda d: log.append("c") or d["a"] + d["b"], ("a", "b")), P("a", lambda d: log.append("a") or 1), P("b", lambda d: log.append("b") or d["a"] + 1, ("a",))], keep={"c"})
    assert log == ["a", "b", "c"] and out.outputs == {"c": 3}
    with pytest.raises(ValueError, match="x -> y -> x"):
        phases.ordered([P("x", None, ("y",)), P("y", None, ("x",))])
    with pytest.raises(ValueError, match="no phase"):
        phases.ordered([P("x", None, ("q",))])


def test_result_cache():
    from skein.operators.analysis import ResultCache

    now = [0.0]
    c = ResultCache(ttl=10, size=2, clock=lambda: now[0])
    c.put("a", 1, version=1)
    assert c.get("a", 1) == ("hit", 1) and c.get("a", 2) == ("stale", None) and c.get("b") == ("miss", None)
    now[0] = 11
    assert c.get("a", 1) == ("expired", None)
    for k in "xyz":
        c.put(k, k)
    assert c.get("x") == ("miss", None) and c.get("z") == ("hit", "z")


def test_method_overrides(spark):
    parents = spark.createDataFrame([("A", "B", 0), ("A", "C", 1), ("B", "D", 0), ("C", "D", 0), ("X", "Y", 0), ("Y", "Z", 0)], "child string, parent string, pos int")
    methods = spark.createDataFrame([("A", "run"), ("B", "run"), ("D", "run"), ("C", "stop"), ("D", "stop"), ("A", "own"), ("X", "go"), ("Y", "go"), ("Z", "go")], "owner string, method string")
    got = {tuple(r) for r in analysis.overrides(hierarchy.linearise(parents), methods).collect()}
    assert got == {("A", "run", "B"), ("B", "run", "D"), ("C", "stop", "D"), ("X", "go", "Y"), ("Y", "go", "Z")}
