"""Impact over three hops on a small fixture, against brute force."""

import random

from skein.plans import registry

QUERIES = registry.queries()


def test_impact_is_transitive(spark, tmp_path):
    r = random.Random(8)
    lines = [(o, n, r.randint(1, 60)) for o in range(30) for n in range(1, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    brand = {p: f"B{p % 7}" for p in range(1, 61)}
    spark.createDataFrame([(p, f"n{p}", b) for p, b in brand.items()], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    for name, columns in {"region": "r_regionkey long, r_name string", "nation": "n_nationkey long, n_name string, n_regionkey long", "customer": "c_custkey long, c_name string, c_nationkey long", "supplier": "s_suppkey long, s_name string, s_nationkey long"}.items():
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    pairs = [(a[2], b[2]) for a, b in zip(lines, lines[1:], strict=False) if a[0] == b[0]]
    out = {}
    for a, _ in pairs:
        out[f"Part:{a}"] = out.get(f"Part:{a}", 0) + 1
    seeds = [int(s[5:]) for s in sorted(out, key=lambda s: (-out[s], s))[:5]]
    depth = {}
    for s in seeds:
        depth[s], front = {s: 0}, {s}
        for d in (1, 2, 3):
            front = {a for a, b in pairs if b in front} - set(depth[s])
            depth[s] |= dict.fromkeys(front, d)
        del depth[s][s]
    assert any(d == 3 for v in depth.values() for d in v.values())
    risk = {x.seed: (x.direct, x.total, x.modules) for x in QUERIES["impact_risk_whole"](spark, str(tmp_path)).collect()}
    assert risk == {f"Part:{s}": (sum(d == 1 for d in v.values()), len(v), len({brand[p] for p in v})) for s, v in depth.items() if v}
    shared = {x.id: (x.hits, x.depth) for x in QUERIES["impact_batch_shared_whole"](spark, str(tmp_path)).collect()}
    found = {p: [v[p] for v in depth.values() if p in v] for p in {p for v in depth.values() for p in v}}
    assert shared == {f"Part:{p}": (len(d), min(d)) for p, d in found.items() if len(d) > 1}
