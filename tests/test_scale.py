"""What keeps large inputs within bounds: blocks, queries, triangles in classes, walks, forests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.operators import attention, similarity
from tests.test_operators import units_of


def test_blocks_grow_once_there_are_many_rows():
    """With a block for every 4096 rows, what is shuffled would grow with the square of the rows."""
    assert [similarity.block_count(n) for n in (0, 4096, 4097, 40_000, 100_000, 600_000)] == [1, 1, 2, 10, 12, 12]
    assert similarity.block_count(10 * similarity.MOST_ROWS * 12) == 120


def test_fused_layers_equal_plain_cosines(spark):
    x = np.random.default_rng(21).normal(size=(30, 5))
    rows = units_of(spark, x).withColumnRenamed("unit_id", "id")
    got = attention.fuse_layers(rows.where("id < 3").withColumnRenamed("id", "query_id"), {"a": rows, "b": rows.where("id < 7")}, {"b": 0.5}).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert len(got) == 3 * 37
    assert all(r.similarity == pytest.approx(unit[r.query_id] @ unit[r.id]) and r.score == pytest.approx(r.similarity * (0.5 if r.layer == "b" else 1)) for r in got)


@pytest.mark.parametrize("class_rows", [1000, 7])
def test_common_targets_equal_plain_counts(spark, class_rows):
    from lattice.operators.adjacency import common_targets

    rng = np.random.default_rng(22)
    m = {g: rng.random((25, 25)) < 0.3 for g in "ab"}
    for a in m.values():
        np.fill_diagonal(a, False)
    e = spark.createDataFrame([(g, int(i), int(j)) for g, a in m.items() for i, j in np.argwhere(a)] + [("a", 3, 3)], "g string, src bigint, dst bigint")
    got = {(r.g, r.src): r.linked for r in common_targets(e.unionByName(e), by="g", class_rows=class_rows).collect()}
    for g, a in m.items():
        for i in range(25):
            out = np.flatnonzero(a[i])
            assert got.get((g, i), 0) == sum(a[x, y] for x in out for y in out)


@pytest.mark.parametrize("length", [1, 2, 5])
def test_walks_by_blocks_equal_walks_by_joins(spark, length):
    from lattice.operators import graph as G
    from tests.test_operators import edges_of, graph

    e, v = edges_of(spark, graph(150, 0.1, 23))
    few, many = (G.random_walk_stats(e, v, length, held=h).first() for h in (G.HELD, 0))
    assert few.return_probability == pytest.approx(many.return_probability) and few.return_probability > 0


def test_forests_join_what_pairs_join(spark):
    from lattice.operators import consolidation as C

    x = np.random.default_rng(24).normal(size=(60, 4))
    u = units_of(spark, np.concatenate([x, x[:20], x[:5], [np.zeros(4)]]))
    for threshold in (0.8, 0.9):
        there = {(r.unit_id, r.group_id) for r in C.groups(C.replay(u, threshold)).collect()}
        links = C.links(u, threshold)
        assert {(r.unit_id, r.group_id) for r in C.groups(links).collect()} == there and there
        assert links.count() < 2 * 86


@pytest.mark.parametrize("metric", ["cosine", "combined"])
def test_leading_vectors_equal_those_of_the_whole_matrix(spark, metric):
    from lattice.operators.clustering import leading_vectors

    x = np.random.default_rng(25).normal(size=(2100, 6))  # beyond the size up to which one matrix was taken
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    a = unit @ unit.T
    if metric == "combined":
        a = 0.7 * a + 0.3 / (1 + np.sqrt(np.maximum(((x[:, None, :] - x[None]) ** 2).sum(axis=2), 0)))
    a = np.maximum(a, 0)
    root = np.sqrt(a.sum(axis=1))
    whole = np.linalg.eigvalsh(a / root[:, None] / root[None, :])[::-1][:4]
    values, found = leading_vectors(spark, x, 4, metric)
    assert np.allclose(values, whole, atol=1e-6)
    assert np.allclose((a @ found) / root[:, None] ** 2, found * values, atol=1e-5)


def test_ranks_are_not_refused_for_many_vertices(spark):
    from lattice.operators import graph as G

    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "src bigint, dst bigint, weight double")
    import inspect

    assert inspect.signature(G.rank_ratio).parameters["most"].default is None
    assert G.rank_ratio(e, e.where("src < 2"), spark.range(6)).first().rank_ratio == 0.5


def test_replayed_classes_give_all_pairs(spark):
    """Copies of one text gave every pair of them."""
    from lattice.operators import consolidation as C

    x = np.random.default_rng(26).normal(size=(40, 3))
    u = units_of(spark, np.concatenate([x, x[:10], x[:5], np.repeat(x[:1], 30, axis=0)]))
    rows = C.replay_classes(u, 0.9).collect()
    stands = {i: i for i in range(85)} | {r.dst: r.src for r in rows if r.kind == "copy"}
    linked = {(r.src, r.dst): r.similarity for r in rows if r.kind == "link"}
    there = {(r.src, r.dst): r.similarity for r in C.replay(u, 0.9).collect()}
    pairs = {(i, j): 1.0 if stands[i] == stands[j] else linked.get((stands[i], stands[j])) for i in range(85) for j in range(85) if i != j}
    assert {k: round(s, 9) for k, s in pairs.items() if s} == {k: round(s, 9) for k, s in there.items()}
    assert len(rows) < len(there) / 2 and all(stands[a] == a and stands[b] == b for a, b in linked)
