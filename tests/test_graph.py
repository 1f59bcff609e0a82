import inspect

import pytest
from pyspark.sql import functions as F

from plaitwork.operators import graph

EDGES = [(1, 2), (2, 1), (3, 1), (3, 4), (1, 4), (5, 5), (6, 5), (2, 3)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, b, 1) for a, b in EDGES], "src long, dst long, attr int")


def test_known_values_of_the_six_vertex_graph(spark, edges):
    turned = graph.canonical(edges)
    assert {r.id: r.triangles for r in graph.triangle_counts(edges).collect()} == {1: 2, 2: 1, 3: 2, 4: 1, 5: 0, 6: 0}
    assert {r.id: r.component for r in graph.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}
    assert {r.id: r.component for r in graph.strongly_connected_components(turned).collect()} == {k: k for k in range(1, 7)}
    ranks = {r.id: round(r.rank, 5) for r in graph.pagerank(turned, 2).collect()}
    assert ranks == {1: 0.29648, 2: 0.42248, 3: 1.32551, 4: 2.39654, 5: 0.77949, 6: 0.77949}


def test_strong_components_of_the_directed_graph(spark, edges):
    assert {r.id: r.component for r in graph.strongly_connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_paths(spark, edges):
    assert {r.id: r.distance for r in graph.shortest_paths_from(edges, 3).collect()} == {3: 0.0, 1: 1.0, 4: 1.0, 2: 2.0}
    far = {(r.id, r.landmark): r.hops for r in graph.landmark_distances(edges, [4, 99]).collect()}
    assert far == {(4, 4): 0, (3, 4): 1, (1, 4): 1, (2, 4): 2}


def test_two_cliques_get_two_labels(spark):
    label = {r.id: r.label for r in graph.label_propagation(graph.two_cliques(spark, 5), 10).collect()}
    assert len({label[k] for k in range(5)}) == 1 and len({label[k] for k in range(5, 11)}) == 1


def test_dynamic_pagerank_nears_the_static_one(spark, edges):
    a = {r.id: r.rank for r in graph.pagerank_until(edges, 1e-6).collect()}
    b = {r.id: r.rank for r in graph.pagerank(edges, 40).collect()}
    assert all(abs(a[k] - b[k]) < 1e-2 for k in a)


def test_loops_that_do_not_end_are_errors(spark, edges):
    with pytest.raises(RuntimeError, match="still active"):
        graph.shortest_paths_from(edges, 3, F.lit(-1.0))
    one = (graph.vertices_of(edges, F.lit(9.0)), edges, F.lit(9.0), lambda a, m: F.least(a, m), F.col("src_attr") - 1, "dst", F.min)
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        graph.pregel(*one, rounds=2)


def test_loops_have_no_cap_of_their_own():
    """Chains of over 100 hops take minutes here, so only the defaults are held."""
    assert inspect.signature(graph.pagerank_until).parameters["most"].default is None
    assert inspect.signature(graph.pregel).parameters["rounds"].default is None


def test_triplets_and_svd(spark, edges):
    v = graph.vertices_of(edges, F.lit(7))
    assert graph.triplets(v, edges).where("src_attr = 7 and dst_attr = 7").count() == len(EDGES)
    users, items = graph.svd_plus_plus(edges.withColumn("attr", F.lit(3.0)), rank=2, iterations=1)
    assert users.count() == 5 and items.count() == 5
