"""Communities over all levels, against known graphs, and their stability."""

import itertools

import pytest
from pyspark.sql import functions as F

#: A club of 34 members, a graph whose best modularity is known to be 0.4198.
CLUB = "1-2 1-3 2-3 1-4 2-4 3-4 1-5 1-6 1-7 5-7 6-7 1-8 2-8 3-8 4-8 1-9 3-9 3-10 1-11 5-11 6-11 1-12 1-13 4-13 1-14 2-14 3-14 4-14 6-17 7-17 1-18 2-18 1-20 2-20 1-22 2-22 24-26 25-26 3-28 24-28 25-28 3-29 24-30 27-30 2-31 9-31 1-32 25-32 26-32 29-32 3-33 9-33 15-33 16-33 19-33 21-33 23-33 24-33 30-33 31-33 32-33 9-34 10-34 14-34 15-34 16-34 19-34 20-34 21-34 23-34 24-34 27-34 28-34 29-34 30-34 31-34 32-34 33-34"


def clique(members):
    return [(a, b, 1.0) for a, b in itertools.combinations(members, 2)]


def parts(labels):
    out = {}
    for r in labels.collect():
        out.setdefault((r["run"], r["label"]), set()).add(r["node"])
    return {(run, frozenset(m)) for (run, _), m in out.items()}


def test_several_graphs_side_by_side(spark):
    from larkgraph.operators.communities import communities
    from larkgraph.operators.similarity import modularity

    ring = [e for k in range(6) for e in clique(range(10 * k, 10 * k + 5))] + [(10 * k, 10 * ((k + 1) % 6) + 1, 1.0) for k in range(6)]
    two = clique(range(5)) + clique(range(10, 15)) + [(0, 10, 1.0), (3, 3, 9.0)]
    club = [(*map(int, x.split("-")), 1.0) for x in CLUB.split()]
    rows = [(run, *e) for run, graph in enumerate((ring, two, club)) for e in graph]
    edges = spark.createDataFrame(rows, "run int, a long, b long, weight double")
    labels = communities(edges, seed=1).cache()
    got = parts(labels)
    assert {m for run, m in got if run == 0} == {frozenset(range(10 * k, 10 * k + 5)) for k in range(6)}
    assert {m for run, m in got if run == 1} == {frozenset(range(5)), frozenset(range(10, 15))}
    mine = labels.where("run = 2").select("node", "label")
    assert modularity(edges.where("run = 2"), mine).first()[0] >= 0.41
    with pytest.raises(RuntimeError):
        communities(edges.where("run = 1"), most_rounds=1)
    assert communities(edges.limit(0)).count() == 0


def test_the_nearest_of_each_node(spark):
    from larkgraph.operators.communities import nearest

    pairs = spark.createDataFrame([(0, 1, 2, 0.9), (0, 1, 3, 0.9), (0, 1, 4, 0.5), (0, 3, 4, 0.1), (1, 1, 2, 0.2)], "run int, a int, b int, weight double")
    assert {tuple(r) for r in nearest(pairs, 1).collect()} == {(0, 1, 2, 0.9), (0, 1, 3, 0.9), (0, 1, 4, 0.5), (1, 1, 2, 0.2)}


def test_cliques_are_stable_and_noise_is_not(spark):
    from larkgraph.operators.communities import stable_communities

    pairs = spark.createDataFrame(clique(range(8)) + clique(range(20, 28)) + [(0, 20, 0.2)], "a int, b int, weight double")
    labels, clusters = stable_communities(pairs, 7, runs=2, fraction=0.7)
    assert parts(labels.withColumn("run", F.lit(0))) == {(0, frozenset(range(8))), (0, frozenset(range(20, 28)))}
    got = [tuple(r) for r in clusters.orderBy("label").collect()]
    assert [g[1] for g in got] == [8, 8] and all(g[2] == 28 for g in got)
    assert all(g[4] == pytest.approx(1.0) and g[5] == pytest.approx(1.0) for g in got)


def test_nodes_with_one_neighbour_join_it_before_the_first_level(spark):
    from larkgraph.operators.communities import _leaves, _two_ways, communities

    edges = [(0, f"leaf{i}", "hub", 1.0) for i in range(5)] + [(0, "hub", "next", 1.0), (0, "next", "end", 1.0), (1, "x", "y", 1.0)]
    frame = spark.createDataFrame(edges, "run int, a string, b string, weight double")
    got = {(r["run"], r["node"], r["hub"]) for r in _leaves(_two_ways(frame)).collect()}
    assert got == {*((0, f"leaf{i}", "hub") for i in range(5)), (0, "end", "next"), (1, "y", "x")}
    label = {(r["run"], r["node"]): r["label"] for r in communities(frame).collect()}
    assert all(label[0, f"leaf{i}"] == label[0, "hub"] for i in range(5)) and label[0, "end"] == label[0, "next"] and label[1, "x"] == label[1, "y"]
