"""Evidence, every branch of its ties, and the files that imports mean."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import resolution

COLUMNS = "ref string, def string, origin string, unlinked boolean, scope_depth int, mro_depth int, owner_match boolean, arity string, dynamic boolean"


def row(ref, name, origin=None, unlinked=None, scope=None, mro=None, own=None, arity=None, dynamic=None):
    return ref, name, origin, unlinked, scope, mro, own, arity, dynamic


@pytest.mark.parametrize(
    ("signals", "evidence", "confidence"),
    [
        ({"origin": "local"}, [("local", 550), ("kind-match", 0)], 0.55),
        ({"origin": "wildcard", "unlinked": True}, [("import", 150), ("kind-match", 0)], 0.15),
        ({"origin": "import", "scope": 3, "mro": 1, "own": True, "arity": "compatible", "dynamic": True}, [("import", 450), ("scope-chain", -60), ("type-binding", 420), ("owner-match", 200), ("kind-match", 0), ("arity-match", 100), ("dynamic-import-unresolved", 20)], 1.0),
        ({"arity": "incompatible"}, [("kind-match", 0), ("arity-match", -150)], 0.0),
        ({"mro": 9, "scope": 0}, [("type-binding", 300), ("kind-match", 0)], 0.3),
        ({"origin": "global-name", "arity": "unknown"}, [("global-name", 100), ("kind-match", 0), ("arity-match", 0)], 0.1),
        ({}, [("kind-match", 0)], 0.0),
    ],
)
def test_evidence_composes(spark, signals, evidence, confidence):
    got = resolution.weighed(spark.createDataFrame([row("r", "d", **signals)], COLUMNS)).first()
    assert [tuple(e) for e in got.evidence] == evidence and got.confidence == confidence


def test_ties_fall_through_in_order(spark):
    rows = [
        row("confident", "b", "local"), row("confident", "a", "import"),
        row("scope", "a", "reexport", scope=2, own=True), row("scope", "b", "import", unlinked=True, scope=1, mro=3, dynamic=True),  # 560 against 545
        row("near scope", "a", "local", scope=1, dynamic=True), row("near scope", "b", "local", scope=0),
        row("class", "a", mro=2), row("class", "b", mro=2), row("class", "c", "local", scope=1, mro=None),
        row("near class", "a", mro=7), row("near class", "b", mro=4),
        row("origin", "a", "namespace"), row("origin", "b", "reexport"),
        row("name", "b", "local"), row("name", "a", "local"), row("name", "a", "local"),
        row("no origin", "b"), row("no origin", "a", "global-name", arity="incompatible"),
        row("arity", "a", "local", arity="incompatible", own=True), row("arity", "b", "global-name", arity="compatible"), row("arity", "c", "local", arity="unknown", dynamic=True),
        row("all wrong", "a", "local", arity="incompatible"), row("all wrong", "b", "local", arity="unknown"),
    ]
    got = {r.ref: (r["def"], round(r.confidence, 3), r.candidates) for r in resolution.resolve(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()}
    assert got == {
        "confident": ("b", 0.55, 2), "scope": ("a", 0.56, 2), "near scope": ("b", 0.55, 2), "class": ("c", 0.53, 3), "near class": ("b", 0.3, 2), "origin": ("b", 0.4, 2),
        "name": ("a", 0.55, 3), "no origin": ("b", 0.0, 2), "arity": ("c", 0.57, 2), "all wrong": ("b", 0.55, 2),
    }
    assert resolution.resolve(spark.createDataFrame([], COLUMNS)).collect() == []


FILES = [
    "src/app/main.ts", "src/app/util.ts", "src/app/util.tsx", "src/app/widgets/index.ts", "src/lib/Util.py", "lib/util.py", "com/example/Foo.java", "other/example/Foo.java",
    "pkg/__init__.py", "include/animal.h", "src/animal.c", "deep/mod.rs", "README", "a/x.ts", "b/x.ts", "src/app/data.json",
]
IMPORTS = [
    ("src/app/main.ts", "./util", "ts", "src/app/util.tsx"), ("src/app/main.ts", "./util.ts", "ts", "src/app/util.ts"), ("src/app/main.ts", "./widgets", "ts", "src/app/widgets/index.ts"),
    ("src/app/widgets/index.ts", "../main", "ts", "src/app/main.ts"), ("src/app/widgets/index.ts", "../../lib/Util", "ts", "src/lib/Util.py"), ("src/app/widgets/index.ts", "../../lib/util", "ts", None),
    ("src/app/main.ts", "../../../../README", "ts", "README"), ("x.java", "com.example.Foo", "java", "com/example/Foo.java"), ("x.java", "org.example.Foo", "java", "com/example/Foo.java"), ("x.java", "com.example.*", "java", None),
    ("x.py", "pkg", "python", "pkg/__init__.py"), ("x.py", "lib.util", "python", "lib/util.py"), ("x.py", "LIB.UTIL", "python", "src/lib/Util.py"), ("x.c", "animal.h", "c", "include/animal.h"), ("x.c", "animal.h", "ts", None),
    ("x.c", "zoo/animal.c", "ts", "src/animal.c"), ("x.rs", "deep", "rust", "deep/mod.rs"), ("a/y.ts", "x", "ts", "a/x.ts"), ("a/y.ts", "b/x", "ts", "b/x.ts"), ("a/y.ts", "nothing/here", "ts", None),
    ("a/y.ts", None, "ts", None), ("a/y.ts", "", "ts", None), ("a/y.ts", "x", None, "a/x.ts"), ("src/app/main.ts", "./data.json", "ts", "src/app/data.json"), ("main.ts", "./README", "ts", "README"),
]


def test_imports(spark):
    files = spark.createDataFrame([(p, i) for i, p in enumerate(FILES)] + [(None, 99)], "path string, pos int").repartition(3)
    imports = spark.createDataFrame([(i, f, t, lang) for i, (f, t, lang, _) in enumerate(IMPORTS)], "n int, file string, target string, language string")
    got = resolution.resolve_imports(imports, files)
    assert got.columns == ["n", "file", "target", "language", "resolved"]
    assert {r.n: r.resolved for r in got.collect()} == {i: x[3] for i, x in enumerate(IMPORTS)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert all(r.resolved is None for r in resolution.resolve_imports(imports, files.where(F.lit(False))).collect())


def bound(exports, named, wild):
    """Names by rounds over whole files, after the rules."""
    known = {}
    for f, n, t in exports:
        if f is not None and n is not None:
            old = known.get((f, n))
            types = [x for x in (t, old and old[0]) if x is not None]
            known[f, n] = (min(types, default=None), f, n, 0, True)
    shadow = {(f, local) for f, local, s, n, _, _ in named if None not in (f, local, s, n)}
    hops = 0
    fresh = dict(known)
    while fresh:
        hops += 1
        offers = {}
        for f, local, s, n, pos, again in named:
            got = fresh.get((s, n))
            if f is not None and local is not None and got and got[4]:
                offers.setdefault((f, local), []).append((pos, s, got, bool(again)))
        for f, s, pos, again in wild:
            for (g, n), got in fresh.items():
                if f is not None and g == s and got[4] and (f, n) not in shadow:
                    offers.setdefault((f, n), []).append((pos, s, got, bool(again)))
        fresh = {}
        for key, own in offers.items():
            if key not in known:
                pos, s, got, again = min(own, key=lambda x: (x[0], x[1], x[2][1], x[2][2], x[2][0] is not None, x[2][0] or "", x[3]))
                fresh[key] = (got[0], got[1], got[2], hops, again)
        known |= fresh
    return known


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_bindings_on_cyclic_imports(spark, seed):
    r = random.Random(seed)
    files, names = [f"f{i}" for i in range(14)], ["x", "y", "z"]
    exports = [(r.choice(files), r.choice(names), r.choice(["A", "B", None])) for _ in range(9)] + [(None, "x", "A"), ("f1", None, "A")]
    named = [(r.choice(files), r.choice(names), r.choice(files), r.choice(names), r.randrange(3), r.choice([True, True, False, None])) for _ in range(16)] + [("f1", "x", None, "x", 0, True)]
    wild = [(r.choice(files), r.choice(files), r.randrange(3), r.choice([True, True, False])) for _ in range(22)] + [("f2", "f3", 0, True), ("f3", "f4", 0, True), ("f4", "f2", 0, True)]
    got = resolution.propagate_bindings(
        spark.createDataFrame(exports, "file string, name string, type string"), spark.createDataFrame(named, "file string, local string, source string, name string, pos int, reexport boolean"),
        spark.createDataFrame(wild, "file string, source string, pos int, reexport boolean"),
    ).collect()
    assert {(r.file, r.name): (r.type, r.origin, r.origin_name, r.hops, r.exported) for r in got} == bound(exports, named, wild)
    assert len({(r.file, r.name) for r in got}) == len(got) > 20
