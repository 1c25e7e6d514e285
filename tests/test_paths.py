"""Simple paths against a plain search, and through hubs of leaves."""

import random

import pytest

from quernstone.operators import graph

E = "id string, subject_id string, object_id string"


def plain(edges, pairs, depth):
    out, steps = [], [(i, a, b) for i, a, b in edges] + [(i, b, a) for i, a, b in edges]
    for start, end in set(pairs):
        todo = [([start], [])]
        while todo:
            nodes, ids = todo.pop()
            for i, a, b in steps:
                if a == nodes[-1] and b not in nodes and len(ids) < depth:
                    (out if b == end else todo).append((start, end, nodes + [b], ids + [i]) if b == end else (nodes + [b], ids + [i]))
    return sorted(out)


@pytest.mark.parametrize("seed, depth", [(1, 4), (2, 3), (3, 2), (4, 1)])
def test_paths_equal_a_plain_search(spark, seed, depth):
    rnd = random.Random(seed)
    names = "abcdefgh"
    edges = [(f"e{n}", rnd.choice(names), rnd.choice(names)) for n in range(14)]
    pairs = [(a, b) for a in "abcd" for b in "aefg"]
    got = graph.paths(spark.createDataFrame(edges, E), spark.createDataFrame(pairs, "start_id string, end_id string"), depth, 10**6)
    assert sorted((r["start_id"], r["end_id"], r["nodes"], r["edge_ids"]) for r in got.collect()) == plain(edges, pairs, depth)


def test_leaves_of_a_hub_lead_nowhere(spark):
    # from each leaf to all others of its hub and back there were 4 * 10^8 beginnings of paths, none of which arrives
    n = 20_000
    edges = spark.range(n).selectExpr("concat('s', id) AS id", "concat('leaf', id) AS subject_id", "'hub' AS object_id").unionByName(spark.createDataFrame([("r", "hub", "end"), ("q", "other", "end")], E))
    pairs = spark.range(n).selectExpr("concat('leaf', id) AS start_id", "'end' AS end_id")
    got = graph.paths(edges, pairs, 4)
    assert got.count() == n and got.where("depth <> 2").count() == 0
