import random

from lumenbib.operators.components import connected_components


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in up}


def test_against_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 90)]
    edges += [(7, None), (None, 8), (9, 9)] + edges[:40]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {tuple(x) for x in connected_components(df).collect()} == brute(edges)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
