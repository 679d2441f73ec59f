import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.llm import ann, hnsw_dedup


def frame(spark, ids, x):
    return spark.createDataFrame([(None if i is None else int(i), None if v is None else [None if e is None else float(e) for e in v], 0) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>, label int")


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[: n // 4] = x[0] + 0.02 * rng.normal(size=(n // 4, d))
    x[n // 4 : n // 3] = x[n // 4] + 0.02 * rng.normal(size=(n // 3 - n // 4, d))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def true_neighbours(x, k):
    d = np.round(np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(-1)), 6)
    np.fill_diagonal(d, np.inf)
    return [set(np.lexsort((np.arange(len(x)), row))[:k].tolist()) for row in d], d


@pytest.mark.parametrize("maker", [lambda: clustered(900, 24, 1), lambda: np.random.default_rng(2).normal(size=(900, 24)).astype(np.float32)])
def test_recall_against_brute_force(spark, maker):
    x = maker()
    true, d = true_neighbours(x, 10)
    rows = ann.neighbours(frame(spark, range(len(x)), x), bucket_rows=64).collect()
    found = [set() for _ in x]
    for r in rows:
        found[r.vec_id].add(r.neighbour_id)
        assert abs(d[r.vec_id, r.neighbour_id] - r.distance) < 1e-5
    recall = sum(len(a & b) for a, b in zip(found, true)) / (10 * len(x))
    assert recall >= 0.9
    assert max(len(f) for f in found) == 10


def test_some_rows_ask_all_rows(spark):
    """The registered form: ids divisible by 50 are the queries, every row can be a neighbour."""
    x = clustered(2000, 24, 4)
    true, d = true_neighbours(x, 10)
    asking = F.col("vec_id") % ann.QUERY_STEP == 0
    found = {q: set() for q in range(0, 2000, 50)}
    for r in ann.neighbours(frame(spark, range(len(x)), x), bucket_rows=64, asking=asking).collect():
        found[r.vec_id].add(r.neighbour_id)  # no other row asks
        assert abs(d[r.vec_id, r.neighbour_id] - r.distance) < 1e-5
    assert all(len(f) == 10 for f in found.values())
    assert sum(len(f & true[q]) for q, f in found.items()) >= 0.9 * 10 * len(found)
    assert any(n % 50 for f in found.values() for n in f)
    assert ann.neighbours(frame(spark, [1, 2], [[1, 2], [2, 1]]), asking=asking).count() == 0


def test_probe_order_is_by_expected_success():
    sets = ann.perturbations(4, 20)
    assert not sets[0].any()
    assert len({tuple(s) for s in sets}) == len(sets)
    assert all(not (s[i] and s[7 - i]) for s in sets for i in range(4))


def test_ann_edge_cases(spark):
    x = [[1, 0], [1, 0], [0, 1], None, [1, None], [float("nan"), 0], [1, 2, 3], [0, 0], [2, 2], [2, 2]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, None, 2]
    rows = ann.neighbours(frame(spark, ids, x).selectExpr("*", "1 as distance", "2 as rank", "3 as keys")).collect()
    assert {r.vec_id for r in rows} == {0, 1, 2, 7}
    first = {(r.vec_id, r.rank): (r.neighbour_id, round(r.distance, 5)) for r in rows}
    assert first[0, 1] == (1, 0.0) and first[1, 1] == (0, 0.0)
    assert len(rows) == 4 * 3
    assert ann.neighbours(frame(spark, [], [])).count() == 0
    assert ann.neighbours(frame(spark, [1], [[1, 2]])).count() == 0


def test_merge_keeps_each_neighbour_once():
    row, neighbour, distance = np.array([1, 0, 1, 1, 0, 1]), np.array([5, 2, 5, 3, 4, 9]), np.array([0.2, 0.1, 0.2, 0.2, 0.3, 0.1])
    best = ann._merge(row, neighbour, distance, 2)
    assert [(row[i], neighbour[i]) for i in best] == [(0, 2), (0, 4), (1, 9), (1, 3)]
    assert len(ann._merge(row[:0], neighbour[:0], distance[:0], 2)) == 0


@pytest.mark.parametrize("block_rows", [40, 400])
def test_large_buckets_are_tiled(spark, block_rows):
    """Few functions and small blocks: buckets fall into tiles, and nothing is lost by it."""
    x = np.random.default_rng(3).normal(size=(500, 12)).astype(np.float32)
    true, _ = true_neighbours(x, 10)
    found = [set() for _ in x]
    for r in ann.neighbours(frame(spark, range(len(x)), x), bucket_rows=250, block_rows=block_rows).collect():
        found[r.vec_id].add(r.neighbour_id)
    assert sum(len(a & b) for a, b in zip(found, true)) >= 0.9 * 5000


def test_ties_beyond_the_candidates_go_to_the_lesser_ids(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.tile(rng.normal(size=(1, 16)), (100, 1)), rng.normal(size=(100, 16))]).astype(np.float32)
    ids = rng.permutation(1000)[: len(x)]
    hot = np.sort(ids[:100])
    row, neighbour, distance = ann.nearest(x, ids, x, ids, 10)
    found = {i: neighbour[ids[row] == i].tolist() for i in ids.tolist()}
    assert all(found[i] == [j for j in hot.tolist() if j != i][:10] for i in hot.tolist())
    rows = ann.neighbours(frame(spark, ids, x)).where("rank <= 10").collect()
    best = {(r.vec_id, r.rank): r.neighbour_id for r in rows}
    assert all([best[i, n + 1] for n in range(10)] == found[i] for i in hot.tolist())


@pytest.mark.parametrize("norm, noise", [(1.0, 1e-4), (1000.0, 0.05)])
def test_dense_near_copies_are_ranked_exactly(norm, noise):
    rng = np.random.default_rng(9)
    x = (norm * np.ones((1, 16)) + noise * rng.normal(size=(400, 16))).astype(np.float32)
    true, _ = true_neighbours(x, 10)
    row, neighbour, _ = ann.nearest(x, np.arange(400), x, np.arange(400), 10)
    assert all(set(neighbour[row == i].tolist()) == true[i] for i in range(400))


def groups_by_brute_force(x, threshold):
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1), 1e-30)[:, None]
    parent = list(range(len(x)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in zip(*np.nonzero(u @ u.T >= threshold)):
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(x))]


def test_groups_equal_brute_force(spark):
    x = clustered(1500, 32, 3)
    expected = groups_by_brute_force(x, 0.95)
    found = {r.vec_id: r.group_id for r in hnsw_dedup.near_duplicate_groups(frame(spark, range(len(x)), x), shard_rows=400).collect()}
    wrong = sum(found[i] != expected[i] for i in range(len(x)))
    assert wrong <= 0.01 * len(x)


def test_graph_search_recall():
    x = clustered(3000, 32, 4)
    graph = hnsw_dedup.Graph(x)
    q = x[::10]
    ids, sims = graph.search(q, 64)
    true = np.argsort(-(q @ x.T), axis=1)[:, :10]
    spread = [i for i in range(len(q)) if i * 10 > 1000]
    recall = np.mean([len(set(ids[i, :10]) & set(true[i])) / 10 for i in spread])
    assert recall > 0.85
    assert (np.diff(sims, axis=1) <= 1e-6).all()


def test_beams_widen_for_groups_larger_than_the_beam():
    rng = np.random.default_rng(5)
    x = np.concatenate([np.tile(rng.normal(size=(1, 16)), (700, 1)) + 0.005 * rng.normal(size=(700, 16)), rng.normal(size=(700, 16))])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    graph = hnsw_dedup.Graph(x)
    r, node = hnsw_dedup.near_pairs(graph, x[:50], 0.95, beam=8)
    true = (x[:50] @ x.T >= 0.95).sum()
    assert len(r) >= 0.98 * true


def test_planted_queries_have_the_cosine_asked_for():
    x = clustered(300, 16, 6)
    asked = hnsw_dedup.planted(x, 0.95, 50)
    best = (asked.astype(float) @ x.astype(float).T).max(axis=1)
    assert (best >= 0.95 - 1e-6).all() and abs(np.linalg.norm(asked, axis=1) - 1).max() < 1e-5


def test_marks_and_beams_equal_a_plain_search():
    """With a beam as wide as a connected graph, the search gives every node by its cosine."""
    x = clustered(120, 8, 9)
    graph = hnsw_dedup.Graph(x)
    ids, sims = graph.search(x[:30], 120)
    assert all(sorted(row[row >= 0].tolist()) == sorted(set(row[row >= 0].tolist())) for row in ids)
    assert all(np.allclose(s[i >= 0], x[q] @ x[i[i >= 0]].T, atol=1e-5) for q, (i, s) in enumerate(zip(ids, sims)))
    assert (ids >= 0).mean() > 0.9


def test_leaders_in_a_graph_of_their_own():
    """Balls of which no leader is near the query: the second graph finds those that comparing all leaders finds."""
    rng = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    heads = unit(rng.normal(size=(600, 24)))
    x = np.concatenate([heads, unit(heads + 0.3 * unit(rng.normal(size=heads.shape)))]).astype(np.float32)
    asked = unit(x[600:] + 0.3 * unit(rng.normal(size=heads.shape))).astype(np.float32)
    lead = np.concatenate([np.arange(600), np.arange(600)])
    plain, by_graph = (set(zip(*(c.tolist() for c in hnsw_dedup.ball_pairs(x, lead, asked, 0.95, g)))) for g in (None, hnsw_dedup.Graph(x[:600])))
    assert by_graph <= plain and len(by_graph) >= 0.99 * len(plain) > 100


def test_dedup_edge_cases(spark):
    x = [[1, 0], [1, 0], [0, 1], None, [1, None], [float("nan"), 0], [1, 2, 3], [0, 0], [2, 2], [3, 0], [float("inf"), 1]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, None, 9, 10]
    df = frame(spark, ids, x).selectExpr("*", "1 as group_id", "2 as shard", "3 as ids")
    found = {r.vec_id: r.group_id for r in hnsw_dedup.near_duplicate_groups(df).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 9: 0, 10: 10}
    assert hnsw_dedup.near_duplicate_groups(frame(spark, [], [])).count() == 0


def beside_a_hot_group(noise, towards=0.8, seed=1, hot=3000, pairs=150):
    """Vectors and each one's partner: -1 for none, -2 in the group of `hot` copies."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    near = lambda v, n: unit(v + n * unit(rng.normal(size=v.shape)))
    one = unit(rng.normal(size=(1, 32)))
    two = unit(unit(rng.normal(size=(pairs, 32))) + towards * one)
    x = np.concatenate([near(np.repeat(one, hot, axis=0), noise), two, unit(rng.normal(size=(800, 32))), near(two, 0.1)])
    mixed = rng.permutation(len(x))
    place = np.argsort(mixed)
    partner = np.full(len(x), -1)
    partner[place[:hot]] = -2
    first, last = place[hot : hot + pairs], place[-pairs:]
    partner[first], partner[last] = last, first
    return x[mixed].astype(np.float32), partner


def test_pairs_beside_a_hot_group_are_found():
    x, partner = beside_a_hot_group(0.05, 0.0)
    rows = np.flatnonzero(partner >= 0)
    asked = np.sort(np.concatenate([rows, np.flatnonzero(partner == -2)[:40]]))
    r, node = hnsw_dedup.near_pairs(hnsw_dedup.Graph(x), x[asked], 0.95)
    found = set(zip(asked[r].tolist(), node.tolist()))
    assert np.mean([(i, partner[i]) in found for i in rows.tolist()]) >= 0.98


@pytest.mark.parametrize("noise", [0.0, 0.22])
def test_groups_beside_a_hot_group_equal_brute_force(spark, noise):
    x, _ = beside_a_hot_group(noise)
    expected = groups_by_brute_force(x, 0.95)
    found = {r.vec_id: r.group_id for r in hnsw_dedup.near_duplicate_groups(frame(spark, range(len(x)), x), shard_rows=2500).collect()}
    assert sum(found[i] != expected[i] for i in range(len(x))) <= 0.01 * 150


def test_members_of_a_ball_are_found_beyond_its_leader():
    turn = lambda degrees: [np.cos(np.radians(degrees)), np.sin(np.radians(degrees))]
    x = np.array([turn(0), turn(15), turn(90)], dtype=np.float32)
    lead = hnsw_dedup.Graph(x, threshold=0.95).lead
    assert lead[2] == 2 and lead[0] == lead[1]
    lead = np.array([0, 0, 2])
    r, node = hnsw_dedup.ball_pairs(x, lead, np.array([turn(30), turn(40)], dtype=np.float32), 0.95)
    assert (r.tolist(), node.tolist()) == ([0], [1])
