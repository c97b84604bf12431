"""Connected components against union-find."""

import random

import pytest

from lendlens.llm.components import components


def union_find(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k + 1000, k + 1001) for k in range(25)]
    links += [(5000 + k, 4000 + h) for k in range(80) for h in r.sample(range(6), 4)]  # many documents, the same hubs
    links += [(7, 7), links[0]]
    got = components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    assert {x["id"]: x["root"] for x in got} == union_find(links) and len(got) == len({x["id"] for x in got})


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
