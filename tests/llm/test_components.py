"""Components, whole and merged with later edges, against union-find."""

import random

import pytest

from farewise.llm.components import components, merge_components


def _brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [0, 1])
def test_components_and_merged_components(spark, seed):
    r = random.Random(seed)
    first = [(r.randrange(200), r.randrange(200)) for _ in range(90)] + [(i, i + 1) for i in range(300, 340)]
    more = [(r.randrange(360), r.randrange(400)) for _ in range(40)]
    labels = components(spark.createDataFrame(first, "u long, v long"))
    assert {x.node: x.label for x in labels.collect()} == _brute(first)
    merged = merge_components(labels, spark.createDataFrame(more, "u long, v long")).collect()
    assert len(merged) == len({x.node for x in merged})
    assert {x.node: x.label for x in merged} == _brute(first + more)


def test_components_of_no_edges(spark):
    none = components(spark.createDataFrame([], "u long, v long"))
    assert none.count() == 0
    merged = merge_components(none, spark.createDataFrame([(2, 1)], "u long, v long")).collect()
    assert {x.node: x.label for x in merged} == {1: 1, 2: 1}
