"""No link is lost between the rounds that find components."""

import random

import pytest

from skein.llm import ngram_join
from skein.operators.components import stars


def groups(ids, edges):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("rounds", [1, 2])
def test_early_stars_connect_what_the_edges_connect(spark, rounds):
    r = random.Random(rounds)
    ids = list(range(300))
    r.shuffle(ids)
    edges = [(a, b) for k in range(0, 300, 60) for a, b in zip(ids[k : k + 59], ids[k + 1 : k + 60], strict=True)]
    got = [tuple(x) for x in stars(spark.createDataFrame(edges, "src long, dst long"), rounds=rounds).collect()]
    assert groups(ids, got) == groups(ids, edges)


def test_long_chains_of_near_copies_stay_whole(spark):
    # windows of 40 words, three further each time: only neighbours share 85 of 100
    rows = [(1000 * c + i, " ".join(f"{c}w{j}" for j in range(3 * i, 3 * i + 40))) for c in range(3) for i in range(120)]
    random.Random(1).shuffle(rows)
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 1000 * 1000 for i, _ in rows}

