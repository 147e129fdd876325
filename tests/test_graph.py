"""Walk counts, triangles and impact levels against enumeration, on graphs with loops and parallel edges."""

import random
from collections import Counter
from itertools import permutations

import pytest

from lexloom.operators import graph as g

TYPES = ("APPLIES", "REFERENCES", "REPLACES")


def made(spark, n, m, seed, ids=str):
    r = random.Random(seed)
    rows = sorted({(ids(r.randrange(n)), ids(r.randrange(n)), r.choice(TYPES)) for _ in range(m)})
    rows = [(*x, r.choice((0.5, 0.7, 0.9, 1.0))) for x in rows]
    return rows, spark.createDataFrame(rows, f"src {'string' if ids is str else 'long'}, dst {'string' if ids is str else 'long'}, rel_type string, confidence double")


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("depth", [1, 2, 3])
def test_walks_are_counted_as_trails_would_be(spark, depth, reverse):
    for n, m, seed in ((4, 22, 1), (7, 30, 2), (2, 9, 3)):
        rows, edges = made(spark, n, m, seed)
        seeds = ["0", "1"]
        want = Counter()

        def walk(start, at, trail):
            if trail:
                want[start, at, len(trail)] += 1
            if len(trail) < depth:
                for e in rows:
                    a, b = (e[1], e[0]) if reverse else (e[0], e[1])
                    if a == at and e not in trail:
                        walk(start, b, [*trail, e])

        for s in seeds:
            walk(s, s, [])
        got = g.walk_counts(edges, spark.createDataFrame([(s,) for s in [*seeds, "0"]], "node string"), depth, reverse)
        assert {(r.seed, r.node, r.length): r.walks for r in got.collect()} == want
        assert "array" not in got.schema.simpleString()


def test_walks_need_a_known_depth(spark):
    with pytest.raises(ValueError):
        g.walk_counts(made(spark, 3, 3, 1)[1], spark.createDataFrame([("0",)], "node string"), 4)


@pytest.mark.parametrize("ids", [str, int])
def test_triangles_of_hubs_and_others(spark, ids):
    rows, edges = made(spark, 12, 90, 4, ids)
    pairs = {(a, b) for a, b, *_ in rows if a != b}
    nodes = {x for p in pairs for x in p}
    want = {t for t in permutations(nodes, 3) if t[0] == min(t) and {(t[0], t[1]), (t[1], t[2]), (t[2], t[0])} <= pairs}
    got = [tuple(r) for r in g.triangles(edges).collect()]
    assert set(got) == want and len(got) == len(want) > 5


def test_impact_levels_take_ids_that_are_texts(spark):
    edges = spark.createDataFrame([("b", "a", "APPLIES", 0.9), ("c", "a", "APPLIES", 0.9), ("d", "b", "REPLACES", 0.8), ("d", "c", "APPLIES", 0.8), ("e", "d", "X", 0.2)], "src string, dst string, rel_type string, confidence double")
    got = {r.node: (r.depth, r.path, r.impact_type) for r in g.impact_by_levels(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"b": (1, ["a", "b"], "DirectApplication"), "c": (1, ["a", "c"], "DirectApplication"), "d": (2, ["a", "b", "d"], "TextReplacement")}
