"""Levels of deep and of random graphs."""

import random

from conftest import rows

from chronoloom.operators import graph


def brute_levels(links, nodes):
    need = {n: {v for u, v in links if u == n and v in nodes} for n in nodes}
    level = {}
    while True:
        free = [n for n in nodes if n not in level and all(v in level for v in need[n])]
        if not free:
            return sorted(level.items(), key=str)
        level |= {n: max((level[v] + 1 for v in need[n]), default=0) for n in free}


def test_levels_of_a_chain_deeper_than_a_thousand(spark):
    n = 1500
    e = spark.range(n).selectExpr("id + 1 as u", "id as v")
    got = graph.levels(e, spark.range(n + 1).withColumnRenamed("id", "node"))
    assert rows(got) == sorted(((i, i) for i in range(n + 1)), key=str)


def test_levels_of_random_graphs(spark):
    rnd = random.Random(5)
    for at, cycles in ((0, False), (1000, True)):
        links = [(at + max(a, b), at + min(a, b)) for a, b in (rnd.sample(range(60), 2) for _ in range(45))] + [(at + 100 + i, at + 99 + i) for i in range(1, 20)] + [(at + 119, at + 5), (at + 7, at + 119)]
        links += [(at + 30, at + 59), (at + 80, at + 80), (at + 81, at + 80), (at + 100, at + 81)] if cycles else []
        nodes = set(range(at, at + 130)) - {at + 3}
        df = spark.createDataFrame(links + links[:5], "u long, v long")
        assert rows(graph.levels(df, spark.createDataFrame([(i,) for i in nodes], "node long"))) == brute_levels(links, nodes)
