"""Components against a plain union of sets."""

import random

import pytest

from fiatscan.llm.components import components


def plain(edges):
    parent = {}

    def root(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {n: root(n) for n in parent}


DRAW = random.Random(3)
SHUFFLED = DRAW.sample(range(300), 300)
CASES = {
    "empty": [],
    "nulls, loops, repeats": [(1, None), (None, 2), (3, 3), (5, 4), (4, 5), (5, 4)],
    "path in order": [(k, k + 1) for k in range(300)],
    "path out of order": list(zip(SHUFFLED, SHUFFLED[1:])),
    "star at its smallest and at its largest": [(-9, k) for k in range(100)] + [(900, k) for k in range(200, 300)],
    "stars of stars": [(k // 7, k) for k in range(1, 400)],
    "sparse": [(DRAW.randrange(-(2**62), 2**62) % 500, DRAW.randrange(500)) for _ in range(230)],
}


@pytest.mark.parametrize("name", CASES)
def test_components_equal_union_of_sets(spark, name):
    edges = CASES[name]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert {r.node: r.component for r in got} == plain(edges) and len(got) == len(plain(edges))
