"""The graph of vectors alike gives what the same operators give over the list of its edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.operators import alike, attention
from lattice.operators import graph as G
from lattice.operators import similarity as S
from tests.test_operators import units_of

LEAST = 0.3


@pytest.fixture(scope="module")
def made(spark):
    x = np.random.default_rng(31).normal(size=(90, 6))
    u = units_of(spark, np.concatenate([x, [np.zeros(6)]])).cache()
    pairs = S.pairwise(u, LEAST).select("src", "dst", F.col("similarity").alias("weight")).cache()
    return u, pairs, G.both_ways(pairs).cache(), u.select(F.col("unit_id").alias("id"))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(alike, "block_count", lambda n: 3)
    monkeypatch.setattr(alike, "other_blocks", lambda n: 2)


def same(a, b):
    assert set(a) == set(b)
    assert all(a[k] == pytest.approx(b[k]) for k in a)


@pytest.mark.parametrize("query", ["clustering_coefficient", "clustering_coefficient_doubled", "adaptive_k", "graph_properties", "approximation_validation", "degree_mixing", "combined_heads", "combined_heads_adaptive", "graph_attention", "graph_attention_weights"])
def test_queries_list_no_edges(spark, monkeypatch, query):
    """Edges grow with the square of the vectors: listed, joined and shuffled they filled the disk."""
    import __spark_entry__
    from lattice.operators import clusters
    from lattice.queries import _base, graphs, search

    def refuse(*a, **k):
        raise AssertionError("edges were listed")

    for module in (_base, graphs, search):
        monkeypatch.setattr(module, "edges", refuse, raising=False)
    monkeypatch.setattr(clusters, "pairwise", refuse, raising=False)
    __spark_entry__.queries()[query](spark, "/root/testdata/sf0.001")


def test_degrees_and_mixing(made, small_blocks):
    u, _, both, v = made
    got = alike.degrees(u, LEAST).collect()
    same({r.id: r.degree for r in got}, {r.id: r.degree for r in G.degrees(both, v).collect()})
    assert {r.id: r.links for r in got if r.links} == {r.src: r.n for r in both.groupBy("src").agg(F.count("*").alias("n")).collect()}
    assert alike.degree_mixing(u, LEAST).first()[0] == pytest.approx(G.degree_mixing(both, v).first()[0])


@pytest.mark.parametrize("class_rows", [30_000, 20])
def test_local_density(made, small_blocks, class_rows):
    from lattice.operators.adjacency import common_targets

    u, _, both, v = made
    assert {r.id: r.linked for r in alike.linked_pairs(u, LEAST, class_rows=class_rows).collect()} == {r.src: r.linked for r in common_targets(both).where("linked > 0").collect()}
    same({r.id: r.local_density for r in alike.local_density(u, LEAST).collect()}, {r.id: r.local_density for r in G.local_density(both, v).collect()})


def test_properties(made, small_blocks):
    u, _, both, v = made
    same(alike.properties(u, LEAST).first().asDict(), G.properties(both, v, extremes=False).first().asDict())


def test_attention_and_its_weights(made, small_blocks):
    u, pairs, _, _ = made
    got, there = ({r.id: r.attended for r in df.collect()} for df in (alike.attention(u, LEAST), attention.graph_attention(pairs, u, key="unit_id")))
    assert set(got) == set(there) and all(np.allclose(got[k], there[k]) for k in got)
    got, there = ({(r.src, r.dst): r.weight for r in df.collect()} for df in (alike.attention_weights(u, LEAST), attention.attention_weights(pairs, u, key="unit_id")))
    same(got, there)


def test_sums_merge_over_batches_and_dimensions(spark):
    rng = np.random.default_rng(32)
    rows = [(i, float(rng.normal() * 9), 1.0, [float(i)] * (2 + i % 2)) for i in range(40) for _ in range(7)]
    parts = spark.createDataFrame(rows, "id bigint, most double, total double, attended array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {r.id: r.attended for r in alike.merge_sums(parts, ["id"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 40
    weights = {i: sum(math.exp(m) for j, m, _, _ in rows if j == i) for i in range(40)}
    for i in range(40):
        assert len(got[i]) == 2 + i % 2
        assert got[i] == pytest.approx([i * sum(math.exp(m) for j, m, _, _ in rows if j == i) / weights[i]] * (2 + i % 2))


def test_neighbours(made):
    u, _, both, _ = made
    rows = lambda df, w: {(r.src, r.rank): (r.dst, round(r[w], 9)) for r in df.collect()}
    assert rows(S.knn(u, 4, least=LEAST, places=12, block_rows=20), "similarity") == rows(G.top_neighbours(both, 4), "weight")


def test_approximation_quality(made, small_blocks):
    u, _, both, v = made
    same(alike.approximation_quality(u, LEAST, 0.5).first().asDict(), G.approximation_quality(both, both.where("weight >= 0.5"), v).first().asDict())


def test_levels(made, small_blocks):
    u, _, both, v = made
    first = v.where("id = 0")
    for least in (LEAST, 0.8):
        e = both.where(f"weight >= {least}")
        assert {(r.id, r.distance) for r in alike.bfs(u, least, first).collect()} == {(r.id, r.distance) for r in G.bfs(e, first).collect()}


@pytest.mark.parametrize("terms", [attention.TERMS, 0])
def test_attention_by_moments_equals_attention_by_blocks(spark, terms):
    """0 terms: by blocks, whose vectors and sums were sent once for every 2048 rows."""
    x = np.random.default_rng(33).normal(size=(150, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert attention._series_degree(1 / 2, 4, attention.TERMS) and attention._series_degree(30.0, 4, attention.TERMS) is None
    got = np.array([r.attended for r in sorted(attention.multi_head_attend(units_of(spark, x), 3, key="unit_id", block_rows=40, terms=terms).collect(), key=lambda r: r.id)])
    for h in range(3):
        y = x[:, 4 * h : 4 * h + 4]
        e = np.exp(y @ y.T / 2)
        assert np.abs(got[:, 4 * h : 4 * h + 4] - e @ y / e.sum(axis=1)[:, None]).max() < 1e-12


@pytest.mark.parametrize("query", ["neighbours", "approximation_quality", "bfs_levels"])
def test_more_queries_list_no_edges(spark, monkeypatch, query):
    test_queries_list_no_edges(spark, monkeypatch, query)


@pytest.mark.parametrize("least", [0.3, 0.8, 0.999])
def test_diameter_is_exact_beyond_100_rows(spark, least):
    """From 10 sampled sources it was a lower bound beyond 100 rows."""
    x = np.random.default_rng(34).normal(size=(160, 4))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hops = unit @ unit.T >= least
    far, reach, m = np.eye(160, dtype=bool), np.eye(160, dtype=bool), 0
    while True:
        far = (reach.astype(int) @ (hops | np.eye(160, dtype=bool)).astype(int)) > 0
        if (far == reach).all():
            break
        reach, m = far, m + 1
    assert alike.diameter(units_of(spark, x), least).first()[0] == (m or math.inf)


def test_diameter_of_edges_is_exact_beyond_100_vertices(spark):
    e = spark.range(149).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    e = e.where("dst < 20").unionByName(e.where("src >= 20").select("src", F.lit(20).cast("bigint").alias("dst"), "weight"))
    v = spark.range(150)
    there = G.bfs(e, v).agg(F.max("distance")).first()[0]
    assert there == 19 and G.diameter(e, v).first()[0] == there


def test_products_over_tiles(spark, made, monkeypatch):
    u, _, both, v = made
    monkeypatch.setattr(alike, "TILE_ROWS", 20)
    monkeypatch.setattr(alike.tiles, "__defaults__", (*alike.tiles.__defaults__[:-1], 20))
    same({r.id: r.rank for r in alike.pagerank(u, LEAST).collect()}, {r.id: r.rank for r in G.pagerank(both, v).collect()})
    got, there = (f.first().spectral_radius for f in (alike.spectral(u, LEAST, exact_up_to=0, iterations=15), G.spectral(both, v, exact_up_to=0, iterations=15)))
    assert got == pytest.approx(there, abs=1e-8)


@pytest.mark.parametrize("query", ["pagerank_10"])
def test_pagerank_lists_no_edges(spark, monkeypatch, query):
    test_queries_list_no_edges(spark, monkeypatch, query)


def test_walks_list_no_edges(spark, monkeypatch):
    """Each step of every walk was joined with all edges."""
    test_queries_list_no_edges(spark, monkeypatch, "simulated_walks")


def walks_of(near, length, walks):
    """Of walks that step alike: their chance to return, its deviation over all walks, and the share of distinct paths."""
    n, degree = len(near), near.sum(axis=1)
    home = np.diag(np.linalg.matrix_power(near / np.maximum(degree, 1)[:, None], length))
    distinct = 0
    for start in range(n):
        ends, p = np.array([start]), np.ones(1)
        for _ in range(length if degree[start] else 0):
            p, ends = np.repeat(p / degree[ends], degree[ends]), np.concatenate([np.flatnonzero(near[e]) for e in ends])
        distinct += (1 - (1 - p) ** walks).sum()
    return home.mean(), math.sqrt((home * (1 - home)).sum() / walks) / n, distinct / (n * walks)


@pytest.mark.parametrize("pilot", [4096, 4])
def test_walks_step_alike(spark, pilot):
    x = np.random.default_rng(32).normal(size=(150, 8))
    x[:3] = np.eye(8)[:3] - 0.2 * x[3:].mean(axis=0)
    x[100:110] = x[90:100]  # copies are neighbours
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = np.zeros((153, 153), bool)
    near[:150, :150] = (unit @ unit.T >= 0.5) & ~np.eye(150, dtype=bool)
    bad = [None, np.zeros(8), [math.nan] * 8]
    u = units_of(spark, [*x, *bad])
    row = alike.simulated_walks(u, 0.5, walks=200, length=3, pilot=pilot).first()
    home, off, distinct = walks_of(near, 3, 200)
    assert abs(row.return_probability - home) < 4 * off and home > 10 * off
    assert row.path_diversity == pytest.approx(distinct, rel=0.02)
    assert alike.simulated_walks(u, 0.5, walks=200, length=3, pilot=pilot).first() == row
    assert alike.simulated_walks(u.limit(0), 0.5).first() == (0.0, 0.0)
    assert alike.simulated_walks(u.where("unit_id >= 150"), 0.5, walks=10).first() == (0.0, 0.1)


def test_walks_of_ids_that_come_twice(spark, made):
    u, pairs, _, v = made
    twice = u.unionByName(u.where("unit_id < 4").select((F.col("unit_id") + 20).alias("unit_id"), "embedding"))
    edges = S.pairwise(twice, LEAST).select("src", "dst", F.col("similarity").alias("weight"))
    assert alike.simulated_walks(twice, LEAST, walks=20).first() == G.simulated_walks(G.both_ways(edges), v, walks=20).first()


@pytest.mark.parametrize("way", ["draw", "list", "look"])
def test_each_neighbour_is_as_likely(way):
    import pyarrow as pa

    x = np.random.default_rng(33).normal(size=(60, 5)).astype(np.float32)
    x[7] = [3, 0, 0, 0, 0]
    x[8] = [1, 1, 1, 1, 0]  # a cosine of just the least
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (unit @ unit.T >= 0.5) & ~np.eye(60, dtype=bool)
    assert near[7, 8]
    lists = [np.flatnonzero(r).tolist() if way == "list" or not r.any() else None for r in near]
    steps = alike._Steps(pa.table({"id": np.arange(60), "v": pa.array(list(x), pa.list_(pa.float32())), "near": pa.array(lists, pa.list_(pa.int64()))}), 0.5)
    rng, got = np.random.default_rng(34), np.zeros((60, 60))
    rounds = 400
    for _ in range(rounds):
        at = np.arange(60, dtype=np.int32)
        to = at.copy()
        if way == "look":
            steps._look(at, to, at, rng)
        else:
            to = steps.step(at, rng)
        got[at, to] += 1
    some = near.any(axis=1)
    assert (np.diag(got)[~some] == rounds).all()
    p = near / np.maximum(near.sum(axis=1), 1)[:, None]
    assert (got[some][~near[some]] == 0).all() and (np.abs(got - rounds * p)[some] < 5 * np.sqrt(rounds * p * (1 - p) + 1)[some]).all()
