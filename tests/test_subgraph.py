"""Bounded subgraphs against brute force: budgets hold exactly and no end is missing."""

import random

import pytest

from skein.operators import subgraph


def brute(seeds, nodes, edges, hops, max_nodes, max_edges):
    label = {}
    for i, lab in nodes:
        if i is not None and lab is not None:
            label[i] = min(lab, label.get(i, lab))
    e = {x for x in edges if None not in x and x[0] in label and x[1] in label}
    out = {}
    for ctx in {c for c, i in seeds if c is not None and i in label}:
        hop = {i: 0 for c, i in seeds if c == ctx and i in label}
        for h in range(1, hops + 1):
            new = {b for s, d, _ in e for a, b in ((s, d), (d, s)) if hop.get(a) == h - 1} - set(hop)
            hop |= dict.fromkeys(new, h)
        order = sorted(hop, key=lambda i: (hop[i], i))
        shown = order[:max_nodes]
        inner = [x for x in e if x[0] in hop and x[1] in hop]
        closed = sorted((x for x in inner if x[0] in shown and x[1] in shown), key=lambda x: (x[0], x[2], x[1]))
        kept = closed[:max_edges]
        out[ctx] = (shown, kept, (len(hop), len(inner), len(shown), len(kept), len(hop) - len(shown), len(closed) - len(kept), len(inner) - len(closed)), {i: label[i] for i in shown})
    return out


@pytest.mark.parametrize(("hops", "max_nodes", "max_edges"), [(1, 128, 256), (2, 5, 4), (3, 12, 0), (0, 3, 9)])
def test_subgraphs(spark, hops, max_nodes, max_edges):
    r = random.Random(hops)
    names = [f"n{i:02d}" for i in range(30)]
    nodes = [(n, r.choice(["A", "B", "C"])) for n in names[:26]] + [("n03", "A"), (None, "A"), ("n04", None)]
    edges = [(r.choice(names), r.choice(names), r.choice(["X", "Y"])) for _ in range(45)] + [("n01", "n01", "X"), ("n00", None, "X"), ("n00", "n02", "X"), ("n00", "n02", "X")]
    seeds = [("p", "n00"), ("p", "n01"), ("q", "n05"), ("q", "n05"), ("lost", "n29"), ("s", None), (None, "n01"), ("alone", "n25")]
    shown, linked, counts = subgraph.subgraphs(
        spark.createDataFrame(seeds, "ctx string, id string"), spark.createDataFrame(nodes, "id string, label string"), spark.createDataFrame(edges, "src string, dst string, type string"), hops, max_nodes, max_edges
    )
    want = brute(seeds, nodes, edges, hops, max_nodes, max_edges)
    told = {c.ctx: (c.nodes, c.edges, c.shown_nodes, c.shown_edges, c.cut_nodes, c.cut_edges, c.open_edges) for c in counts.collect()}
    assert told == {k: v[2] for k, v in want.items()}
    have, lines = {}, {}
    for x in sorted(shown.collect(), key=lambda x: x.place):
        have.setdefault(x.ctx, []).append(x.id)
    for x in sorted(linked.collect(), key=lambda x: x.place):
        lines.setdefault(x.ctx, []).append((x.src, x.dst, x.type))
        assert {x.src, x.dst} <= set(have[x.ctx])
    assert have == {k: v[0] for k, v in want.items()} and lines == {k: v[1] for k, v in want.items() if v[1]}
    text = {m.ctx: (m.shape, m.triples, m.text_cut) for m in subgraph.manifest(shown, linked, 60).collect()}
    for ctx, (_, kept, _, label) in want.items():
        shape = "\n".join(sorted({f"{label[s]} -{t}-> {label[d]}" for s, d, t in kept}))
        triples = "\n".join(f"{label[s]}:{s} {t} {label[d]}:{d}" for s, d, t in kept)
        assert text[ctx] == (shape[:60], triples[:60], len(shape) > 60 or len(triples) > 60)


def test_a_node_near_many_contexts_is_a_row_for_each_64(spark, monkeypatch):
    seeds = [(f"c{i:03d}", "hub" if i % 2 else f"n{i:03d}") for i in range(150)]
    nodes = [("hub", "H"), ("far", "F")] + [(f"n{i:03d}", "N") for i in range(150)]
    edges = [(f"n{i:03d}", "hub", "X") for i in range(0, 150, 2)] + [("hub", "far", "X"), ("n001", "far", "Y"), ("n000", "gone", "X")]
    kept, before = [], subgraph.stage
    monkeypatch.setattr(subgraph, "stage", lambda df, name: kept.append((name, before(df, name))) or kept[-1][1])
    frame = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    shown, linked, counts = subgraph.subgraphs(frame(seeds, ("ctx", "id")), frame(nodes, ("id", "label")), frame(edges, ("src", "dst", "type")), 2, 70, 3)
    want = brute(seeds, nodes, edges, 2, 70, 3)
    assert {c.ctx: (c.nodes, c.edges, c.shown_nodes, c.shown_edges, c.cut_nodes, c.cut_edges, c.open_edges) for c in counts.collect()} == {k: v[2] for k, v in want.items()}
    assert sorted((x.ctx, x.id) for x in shown.collect()) == sorted((k, i) for k, v in want.items() for i in v[0])
    assert sorted((x.ctx, x.src, x.dst, x.type) for x in linked.collect()) == sorted((k, *x) for k, v in want.items() for x in v[1])
    assert max(df.count() for name, df in kept if name == "near") <= 3 * len(nodes)  # 150 contexts are three blocks
