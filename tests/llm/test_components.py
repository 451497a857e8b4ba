import random

import pytest

from foliant.llm.components import components

SCHEMA = "a bigint, b bigint"


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def got(spark, edges):
    return {r.node: r.group_id for r in components(spark.createDataFrame(edges, SCHEMA)).collect()}


def test_empty_loops_and_nulls(spark):
    assert got(spark, []) == {} and got(spark, [(1, 1), (None, 2), (3, None)]) == {}
    assert got(spark, [(2, 1), (1, 2), (1, 2), (5, 5), (2, None)]) == {1: 1, 2: 1}


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    rnd = random.Random(seed)
    n = rnd.choice([30, 200])
    edges = [(rnd.randrange(-n, n), rnd.randrange(-n, n)) for _ in range(rnd.choice([n // 2, n]))]
    assert got(spark, edges) == brute(edges)


def test_paths_and_stars(spark):
    ids = list(range(400))
    random.Random(1).shuffle(ids)
    for edges in (list(zip(range(300), range(1, 301))), list(zip(ids, ids[1:])), [(0, i) for i in range(1, 500)], [(999, i) for i in range(500)]):
        assert got(spark, edges) == brute(edges)


def test_other_columns_and_partitions_make_no_difference(spark):
    edges = [(i, i // 2) for i in range(1, 120)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in edges], "a bigint, b bigint, c string, p int")
    assert {r.node: r.group_id for r in components(df.repartition(13)).collect()} == brute(edges)
