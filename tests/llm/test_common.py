"""Scratch tables and connected components."""

import gc
import os
import random
import time

from ledgerframe.llm import common

from .test_dedup import smallest_reachable


def test_scratch_tables_live_as_long_as_plans_do(spark):
    first = common.written(spark.range(10), "first")
    path = common._tables[-1][1]
    derived = first.where("id > 3").groupBy("id").count()
    del first

    def after_collection():
        for _ in range(3):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)
        common.written(spark.range(1), "other")
        return os.path.exists(path.removeprefix("file:"))

    assert after_collection() and derived.count() == 6
    del derived
    # Python's references are given up by a thread of their own, so the JVM may see it late
    assert any(not after_collection() for _ in range(30))


def test_components_of_random_graphs_paths_and_stars(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(300)] + [(5000, 5001 + i) for i in range(500)] + [(7, 7), (8, 9), (8, 9)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == smallest_reachable(nodes, [e for e in edges if e[0] != e[1]])
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
