import random

from strandwork.llm import common


def labels(edges):
    least = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        x, y = sorted((least.setdefault(a, a), least.setdefault(b, b)))
        least = {k: x if v == y else v for k, v in least.items()}
    return least


def test_components_against_union(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(40)] + [(7, 7), (8, None), (None, None), (3, 4), (4, 3)]
    got = common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in got} == labels(edges) and len(got) == len(labels(edges))


def test_no_edges(spark):
    assert common.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert common.connected_components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0


def test_stage_tables_are_read_back(spark):
    frame = spark.createDataFrame([(1, None), (2, "x")], "n int, t string")
    again = common.staged(frame, "test")
    assert sorted(again.collect()) == sorted(frame.collect()) and again.schema == frame.schema
