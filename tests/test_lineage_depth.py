"""Downstream closure of deep, wide and cyclic graphs against a plain breadth-first search."""

import random
from collections import deque

from tessera.operators import tracking as tr


def _bfs(edges, start):
    after = {}
    for a, b in edges:
        if a is not None and b is not None:
            after.setdefault(a, []).append(b)
    depth, queue = {s: 0 for s in start}, deque(s for s in start if s is not None)
    while queue:
        at = queue.popleft()
        for b in after.get(at, []):
            if b not in depth:
                depth[b] = depth[at] + 1
                queue.append(b)
    return depth


def _closure(spark, edges, start):
    made = tr.lineage_closure(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(s,) for s in start], "node int"))
    rows = made.collect()
    assert made.columns == ["node", "depth"] and len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["depth"] for r in rows}


def test_chain_of_a_thousand_levels(spark):
    edges = [(i, i + 1) for i in range(1000)] + [(500, 2000), (2000, 400), (3000, 3001)]
    assert _closure(spark, edges, [3]) == _bfs(edges, [3])


def test_wide_graph_with_hub_cycles_and_nulls(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(330)]
    edges += [(1000 + i, 7) for i in range(150)] + [(7, 2000 + i) for i in range(150)]            # a hub: never squared
    edges += [(5000 + i, 5001 + i) for i in range(12)] + [(2000, 5000), (5012, 1000), (None, 1), (1, None), (8, 8)] + edges[:5]
    for start in ([1000, 4, 4], [5003, None], []):
        assert _closure(spark, edges, start) == _bfs(edges, start)


def test_no_edges(spark):
    assert _closure(spark, [], [1, 2]) == {1: 0, 2: 0}
