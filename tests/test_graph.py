import math

import numpy as np
import pytest

from lattice.operators import graph as G
from lattice.operators.components import connected_components


def graph(spark, pairs, n, directed=False):
    edges = spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "src bigint, dst bigint, weight double")
    vertices = spark.range(n).withColumnRenamed("id", "id")
    return (edges if directed else G.both_ways(edges)), vertices


def row(df):
    return df.first().asDict()


def test_triangle(spark):
    e, v = graph(spark, [(0, 1, 1), (0, 2, 1), (1, 2, 1)], 3)
    assert row(G.graphlets(e, v)) == {"triangle": 1, "wedge": 0, "triplet": 0, "edges": 3, "nodes": 3}
    assert row(G.clustering_coefficient(e, v))["clustering_coefficient"] == 1.0
    assert row(G.doubled_clustering_coefficient(e, v))["clustering_coefficient"] == 2.0
    assert row(G.diameter(e, v))["diameter"] == 1.0


def test_path(spark):
    e, v = graph(spark, [(0, 1, 1), (1, 2, 1)], 3)
    assert row(G.graphlets(e, v)) == {"triangle": 0, "wedge": 1, "triplet": 0, "edges": 2, "nodes": 3}
    assert {(r.id, r.distance) for r in G.bfs(e, v.where("id = 0")).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert row(G.diameter(e, v))["diameter"] == 2.0


def test_ring_degrees(spark):
    e, v = graph(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 0, 1)], 4)
    assert row(G.degree_stats(e, v)) == {"mean_degree": 2.0, "std_degree": 0.0, "max_degree": 2, "min_degree": 2}
    assert row(G.density(e, v))["density"] == pytest.approx(8 / 12)


def test_no_edges(spark):
    e, v = graph(spark, [], 5)
    assert row(G.graphlets(e, v)) == {"triangle": 0, "wedge": 0, "triplet": 10, "edges": 0, "nodes": 5}
    assert row(G.degree_stats(e, v)) == {"mean_degree": 0.0, "std_degree": 0.0, "max_degree": 0, "min_degree": 0}
    assert row(G.random_walk_stats(e, v)) == {"return_probability": 0.0, "path_diversity": 0.0}
    assert math.isinf(row(G.diameter(e, v))["diameter"])
    assert {r.component for r in G.components(e, v).collect()} == set(range(5))


@pytest.mark.parametrize("pairs,count", [([(0, 1), (1, 2)], 1), ([(0, 1), (2, 3)], 2), ([], 0)])
def test_component_counts(spark, pairs, count):
    e = spark.createDataFrame([*pairs], "src bigint, dst bigint")
    assert connected_components(e).select("component").distinct().count() == count


def test_components_of_a_long_path_and_random_graph(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(120)] + [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(5000, 5000), (7, None)]
    found = {r.vertex: r.component for r in connected_components(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    assert found == {x: find(x) for x in parent}


def dense(pairs, n):
    m = np.zeros((n, n))
    for a, b, w in pairs:
        m[a, b] += w
    return m


def test_pagerank_and_activation_against_matrices(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.random(40))]
    e, v = graph(spark, pairs, 12, directed=True)
    m = dense(pairs, 12)
    sums = m.sum(axis=1, keepdims=True)
    p = np.divide(m, sums, out=np.zeros_like(m), where=sums > 0)
    ranks = np.full(12, 1 / 12)
    for _ in range(7):
        ranks = 0.15 / 12 + 0.85 * p.T @ ranks
    found = {r.id: r["rank"] for r in G.pagerank(e, v, iterations=7).collect()}
    assert np.allclose([found[i] for i in range(12)], ranks)
    a = np.zeros(12)
    a[[0, 3]] = 1
    for _ in range(3):
        a = np.clip(a + 0.5 * m.T @ a, 0, 2)
    seeds = spark.createDataFrame([(0, 1.0), (3, 1.0), (99, 1.0)], "id bigint, activation double")
    got = {r.id: r.activation for r in G.spread_activation(e, seeds).collect()}
    assert {i for i in range(12) if a[i] > 0.01} == set(got) and np.allclose([got[i] for i in sorted(got)], [a[i] for i in sorted(got)])
    power = np.linalg.matrix_power(p, 5)
    stats = row(G.random_walk_stats(e, v))
    assert stats["return_probability"] == pytest.approx(np.trace(power) / 12) and stats["path_diversity"] == pytest.approx(power.sum(axis=0).std())
    ev = np.sort(np.abs(np.linalg.eigvals(m).real))[::-1]
    assert row(G.spectral(e, v))["spectral_radius"] == pytest.approx(ev[0])


def test_pagerank_with_tolerance_returns_the_ranks_before_the_last_step(spark):
    e, v = graph(spark, [(0, 1, 1), (1, 0, 1)], 2, directed=True)
    assert [r["rank"] for r in G.pagerank(e, v, iterations=50, tolerance=1e-6).collect()] == [0.5, 0.5]
    lonely = {r.id: r["rank"] for r in G.pagerank(*graph(spark, [(0, 1, 1)], 2, directed=True), iterations=60, dangling=True).collect()}
    assert sum(lonely.values()) == pytest.approx(1.0)


def test_k_rules():
    assert G.k_candidates(0.2, 0.2, 1) == [1]
    for n in (2, 3, 5, 50, 500, 5000):
        out = G.k_candidates(0.05, 0.6, n)
        assert out == sorted(set(out)) and 1 <= out[0] and out[-1] <= n - 1


def test_validation_of_a_sparse_graph(spark):
    e, v = graph(spark, [(i, j, 1) for i in range(8) for j in range(i)], 8)
    same = {r.property: r.passed for r in G.validate_approximation(G.properties(e, v), G.properties(e, v)).collect()}
    assert all(same.values()) and len(same) == 5
    thin = {r.property: r.passed for r in G.validate_approximation(G.properties(e, v), G.properties(e.where("src + dst = 1"), v)).collect()}
    assert not thin["density"] and not thin["edges_kept"]
    q = row(G.approximation_quality(e, e, v))
    assert q == {"frobenius_error": 0.0, "relative_error": 0.0, "element_accuracy": 1.0}
    assert row(G.rank_ratio(e, e, v))["rank_ratio"] == 1.0
