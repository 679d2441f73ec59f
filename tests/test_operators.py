"""Operators against plain loops and matrices: walks, folds, attention, mixed dimensions, indexes, clusterers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.operators import attention, clustering, clusters, consolidation, similarity, state
from lattice.operators import graph as G
from lattice.operators.index import IvfIndex


def edges_of(spark, m):
    rows = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "src bigint, dst bigint, weight double"), spark.range(len(m))


def units_of(spark, x, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [float(e) for e in v]) for i, v in zip(ids if ids is not None else range(len(x)), x)], "unit_id bigint, embedding array<double>")


def graph(n, share, seed):
    rng = np.random.default_rng(seed)
    return np.where(rng.random((n, n)) < share, rng.random((n, n)) + 0.1, 0)


def test_walks_start_everywhere_and_step_alike(spark):
    m = graph(12, 0.25, 1)
    m[3] = 0  # walks end there
    e, v = edges_of(spark, m)
    row = G.simulated_walks(e, v, walks=400, length=3).first()
    p = (m > 0) / np.maximum((m > 0).sum(axis=1), 1)[:, None]
    end = np.linalg.matrix_power(p + np.diag((m > 0).sum(axis=1) == 0), 3)  # a walk that has ended stays
    # a walk returns if it has left its start and is there at its end
    expected = np.mean([end[i, i] if (m[i] > 0).any() else 0 for i in range(12)])
    assert abs(row.return_probability - expected) < 3 * math.sqrt(0.25 / 4800)
    paths = 0
    for i in range(12):
        level = {(i,)}
        for _ in range(3):
            level = {(*w, int(j)) for w in level for j in np.flatnonzero(m[w[-1]])} | {w for w in level if not (m[w[-1]] > 0).any()}
        paths += len(level)
    assert 0.5 * paths / 4800 <= row.path_diversity <= paths / 4800
    assert G.simulated_walks(e.limit(0), spark.range(0)).first().return_probability == 0.0


def test_ranks_stop_at_the_tolerance(spark):
    m = graph(10, 0.4, 16) + np.roll(np.eye(10), 1, axis=1)
    e, v = edges_of(spark, m)
    p, ranks = m / m.sum(axis=1)[:, None], np.full(10, 0.1)
    while True:
        new = 0.015 + 0.85 * ranks @ p
        if np.abs(new - ranks).sum() < 1e-3:
            break
        ranks = new
    got = {r.id: r["rank"] for r in G.pagerank(e, v, iterations=100, tolerance=1e-3).collect()}
    assert np.allclose([got[i] for i in range(10)], ranks)


@pytest.mark.parametrize("length", [1, 2, 4, 5])
def test_walk_stats_equal_the_matrix_power(spark, length):
    m = graph(9, 0.4, 2)
    e, v = edges_of(spark, m)
    p = np.linalg.matrix_power(m / np.where(m.sum(axis=1) > 0, m.sum(axis=1), 1)[:, None], length)
    row = G.random_walk_stats(e, v, length).first()
    assert row.return_probability == pytest.approx(np.trace(p) / 9) and row.path_diversity == pytest.approx(p.sum(axis=0).std())


def test_local_density_of_a_directed_graph(spark):
    m = graph(15, 0.3, 3)
    np.fill_diagonal(m, 0)
    e, v = edges_of(spark, m)
    found = {r.id: r.local_density for r in G.local_density(e, v).collect()}
    for i in range(15):
        out = np.flatnonzero(m[i])
        linked = sum(m[a, b] > 0 for a in out for b in out if a != b)
        assert found[i] == pytest.approx(linked / (len(out) * (len(out) - 1)) if len(out) > 1 else 0.0)


def test_power_iteration_finds_the_radius(spark):
    m = graph(20, 0.3, 4)
    m = m + m.T
    e, v = edges_of(spark, m)
    assert G.spectral(e, v, exact_up_to=0).first().spectral_radius == pytest.approx(np.abs(np.linalg.eigvals(m)).max(), rel=1e-3)


def test_ranks_are_refused_for_large_graphs(spark):
    e, v = edges_of(spark, graph(6, 0.5, 5))
    with pytest.raises(ValueError):
        G.rank_ratio(e, e, v, most=5)
    m = np.diag([1.0, 2, 3, 0]) + np.diag([1.0, 1, 1], 1)
    e, v = edges_of(spark, m)
    assert G.rank_ratio(e, e.where("src <> 0"), v).first().rank_ratio == pytest.approx(np.linalg.matrix_rank(m * (np.arange(4) > 0)[:, None]) / np.linalg.matrix_rank(m))


def test_positions_equal_principal_components(spark):
    x = np.random.default_rng(6).normal(size=(40, 6)) * np.arange(1, 7)
    got = clustering.positions_3d(units_of(spark, x)).orderBy("unit_id").collect()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, _, v = np.linalg.svd(np.cov(z.T))
    pc = z @ v[:3].T
    pc *= 8 / np.abs(pc).max()
    assert np.allclose(np.abs([[r.x, r.y, r.z] for r in got]), np.abs(pc), atol=1e-6)


RAGGED = [[1, 0, 0], [1], [0, 1], [1, 0], [2, 1], None, [3], [0, 0, 1], [float("nan"), 1]]


def test_vectors_of_different_dimensions_never_meet(spark):
    u = units_of(spark, RAGGED)
    sizes = {i: len(v) for i, v in enumerate(RAGGED) if v is not None and not any(map(math.isnan, v))}
    q = u.select(F.col("unit_id").alias("query_id"), "embedding")
    found = similarity.search(q, u, 5, exclude_self=True).collect()
    assert {(r.query_id, r.unit_id) for r in found} == {(a, b) for a in sizes for b in sizes if a != b and sizes[a] == sizes[b]}
    assert next(r.similarity for r in found if (r.query_id, r.unit_id) == (1, 6)) == pytest.approx(1.0)
    pairs = {(r.src, r.dst): r.similarity for r in similarity.pairwise(u, -1.0).collect()}
    assert set(pairs) == {(a, b) for a in sizes for b in sizes if a < b and sizes[a] == sizes[b]}
    assert pairs[2, 3] == pytest.approx(0.0) and pairs[0, 7] == pytest.approx(0.0)
    assert {(r.src, r.dst) for r in similarity.knn(u, 1).collect()} == {(0, 7), (7, 0), (1, 6), (6, 1), (2, 4), (3, 4), (4, 3)}
    sums = similarity.distance_sums(u.withColumn("label", F.lit(0))).collect()
    assert {(r.i, r.n) for r in sums} == {(i, sum(s == n for n in sizes.values()) - 1) for i, s in sizes.items()}


def test_retrieval_over_mixed_dimensions(spark):
    u = units_of(spark, RAGGED)
    members = u.select(F.lit(0).alias("concept_id"), "unit_id")
    concepts = spark.createDataFrame([(0, [1.0, 1.0])], "concept_id int, centroid array<double>")
    q = u.select(F.col("unit_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    rows = attention.hierarchical(q, concepts, members, u).collect()
    assert {(r.query_id, r.unit_id) for r in rows} == {(a, b) for a in (2, 3, 4) for b in (2, 3, 4)}
    rows = attention.hierarchical(q, concepts.limit(0), members, u).collect()
    assert all(len(RAGGED[r.query_id]) == len(RAGGED[r.unit_id]) and r.unit_score >= 0.5 for r in rows)


def test_equal_vectors_rank_by_key(spark):
    u = units_of(spark, [[1.0, 2.0]] * 200, np.random.default_rng(1).permutation(200))
    q = u.select(F.col("unit_id").alias("query_id"), "embedding")
    rows = similarity.search(q, u, 10, exclude_self=True, block_rows=64).collect()
    for i in (0, 5, 150):
        assert [r.unit_id for r in sorted((r for r in rows if r.query_id == i), key=lambda r: r.rank)] == [j for j in range(11) if j != i][:10]


def test_attention_by_heads_equals_the_matrix_form(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 8))
    w = {name: rng.normal(size=(8, 8)) for name in ("query", "key", "value", "output")}
    for given in ({}, w):
        q, k, v = (x @ given[n] if n in given else x for n in ("query", "key", "value"))
        heads = []
        for h in range(2):
            part = slice(4 * h, 4 * h + 4)
            s = q[:, part] @ k[:, part].T / 2
            e = np.exp(s - s.max(axis=1, keepdims=True))
            heads.append(e / e.sum(axis=1, keepdims=True) @ v[:, part])
        expected = np.concatenate(heads, axis=1) @ given.get("output", np.eye(8))
        got = attention.multi_head_attend(units_of(spark, x), 2, given, key="unit_id", block_rows=7).collect()
        assert np.allclose([r.attended for r in sorted(got, key=lambda r: r.id)], expected)


def test_attention_over_a_hub(spark):
    x = np.random.default_rng(8).normal(size=(120, 4)) * 3
    e = spark.createDataFrame([(0, j, 1.0) for j in range(1, 120)] + [(5, 6, 1.0)], "src bigint, dst bigint, weight double")
    got = {r.id: r.attended for r in attention.graph_attention(e, units_of(spark, x), key="unit_id", salts=5).collect()}
    s = x[1:] @ x[0] / 2
    p = np.exp(s - s.max())
    assert np.allclose(got[0], p / p.sum() @ x[1:]) and np.allclose(got[5], x[6]) and set(got) == {0, 5}


def test_focus_fold_equals_plain_steps(spark):
    rng = random.Random(9)
    rows = [(s, float(t // 2), t, f"i{rng.randint(0, 12)}", rng.choice(["activate", "view"])) for s in ("a", "b", None) for t in range(150)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id string, ts double, event_id int, item string, action string")
    got = {(r.session_id, r.item): (r.weight, r.frequency, r.relevance) for r in state.focus_buffer(df, most=6).collect()}
    for s in ("a", "b", None):
        items = {}
        for _, ts, _, item, action in sorted((r for r in rows if r[0] == s), key=lambda r: r[1:3]):
            items = state.update_focus(items, ts, [item], action, 6)
        assert {k[1] for k in got if k[0] == s} == set(items)
        assert all(np.allclose(got[s, i], items[i][:3]) for i in items)


def test_ordered_folds_equal_plain_ones(spark):
    rng = np.random.default_rng(10)
    f, rating, p = rng.normal(size=(60, 10)), rng.choice([-1.0, 1.0], 60), rng.random((60, 3))
    p[7] = 0
    df = spark.createDataFrame([("m", i, float(rating[i]), f[i].tolist(), *map(float, p[i])) for i in rng.permutation(60).tolist()], "model_id string, seq int, rating double, features array<double>, semantic double, structural double, temporal double")
    w, head = np.array(state.INITIAL), None
    for i in range(60):
        w = np.clip(w + 0.1 * (rating[i] - w @ f[i]) * f[i], -10, 10)
        share = p[i] / p[i].sum() if p[i].sum() else np.full(3, 1 / 3)
        head = share if head is None else 0.9 * head + 0.1 * share
    assert np.allclose(state.update_weights(df).first().weights, w)
    r = state.head_weights(df).first()
    assert np.allclose([r.semantic, r.structural, r.temporal], head / head.sum())


def plain_chunks(sentences, vectors, least, most):
    done, now, mean, n = [], sentences[0], vectors[0], 1
    for s, v in zip(sentences[1:], vectors[1:]):
        norm = np.linalg.norm(mean) * np.linalg.norm(v)
        cosine = mean @ v / norm if norm else 0.0
        if (len(now) >= least and cosine < 0.82) or (most is not None and len(now) + 1 + len(s) > most):
            done, now, mean, n = [*done, now], s, v, 1
        else:
            now, mean, n = f"{now} {s}", (mean * n + v) / (n + 1), n + 1
    return [*done, now]


@pytest.mark.parametrize("most", [None, 90])
def test_chunks_equal_the_plain_fold(spark, most):
    import hashlib

    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 40))).strip() + "x." for _ in range(n)) for n in [0, 1, 2, 3, 4, 30, 3, 200, 7]] + [None, "", "  ", "no end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in state.chunks(df, least=50, most=most).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    import re

    for i, t in enumerate(texts):
        s = [x.strip() for x in re.split(r"(?<=[.!?])\s+", t or "") if x.strip()]
        v = [np.frombuffer(hashlib.md5(x.encode()).digest(), np.uint8) / 255 for x in s]
        assert got.get(i, []) == ([] if not s else [t] if len(s) <= 2 else plain_chunks(s, v, 50, most)), i


def test_inverted_file_index_recall(spark):
    rng = np.random.default_rng(12)
    for x in (rng.normal(size=(600, 8)), np.repeat(rng.normal(size=(30, 16)), 20, axis=0) + 0.1 * rng.normal(size=(600, 16))):
        u = units_of(spark, x)
        q = u.select(F.col("unit_id").alias("query_id"), "embedding")
        index = IvfIndex(lists=20).fit(u)
        found, true = ({(r.query_id, r.unit_id) for r in d.collect()} for d in (index.search(q, 10), similarity.search(q, u, 10)))
        assert len(found & true) >= 0.9 * len(true) and index.members.count() == 600
    assert IvfIndex().fit(units_of(spark, [[1.0, 0.0]])).search(units_of(spark, [[1.0, 0.0]]).withColumnRenamed("unit_id", "query_id"), 3).count() == 1


def separated(n=20, seed=13):
    rng = np.random.default_rng(seed)
    return np.concatenate([10 * np.eye(4)[i] + 0.1 * rng.normal(size=(n, 4)) for i in range(4)])


@pytest.mark.parametrize("make", [lambda d: clustering.spectral(d, 4), lambda d: clustering.multi_similarity(d, 4), lambda d: clustering.neighbour_graph(d, 4, 10), lambda d: clustering.kmeans(d, 4), lambda d: clustering.bisecting(d, 4), lambda d: clustering.ward(d.withColumn("grp", F.lit(0)), "grp", k=4).select("unit_id", "label"), lambda d: clustering.ward(d.withColumn("grp", F.lit(0)), "grp", distance=5.0).select("unit_id", "label"), lambda d: clustering.adaptive(d, k=4)[0]])
def test_clusterers_find_separated_clusters(spark, make):
    rows = make(units_of(spark, separated())).collect()
    found = {}
    for r in rows:
        found.setdefault(r.label, set()).add(r.unit_id // 20)
    assert len(rows) == 80 and all(len(s) == 1 for s in found.values())
    assert len(found) >= 3  # power iteration may leave two clusters together


def test_ward_equals_exhaustive_merging():
    x = np.random.default_rng(14).normal(size=(25, 3))
    centre, size = {i: x[i] for i in range(25)}, dict.fromkeys(range(25), 1)
    costs = []
    while len(centre) > 1:
        cost, a, b = min((math.sqrt(2 * size[a] * size[b] / (size[a] + size[b]) * ((centre[a] - centre[b]) ** 2).sum()), a, b) for a in centre for b in centre if a < b)
        costs.append(cost)
        centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
        size[a] += size.pop(b)
        del centre[b]
    assert np.allclose(sorted(m[0] for m in clustering.ward_merges(x)), costs)


def test_incremental_clustering_labels_both_sides(spark):
    x = separated()
    old, new = clustering.incremental(units_of(spark, x[:60]), units_of(spark, x[60:], range(60, 80)), 4)
    assert old.count() == 60 and new.count() == 20 and new.select("label").distinct().count() == 1


def test_concepts_and_the_whole_job(spark):
    x = np.concatenate([separated(), np.repeat(separated()[[0]], 3, axis=0)])
    u = units_of(spark, x).withColumn("content", F.concat(F.lit("t"), F.col("unit_id").cast("string"))).withColumn("is_archived", F.lit(False))
    concepts, members = consolidation.form_concepts(u)
    assert sum(r["size"] for r in concepts.collect()) == members.count() == 83
    out = consolidation.consolidate(u, threshold=0.9999999)
    row = out["summary"].first()
    assert (row.units_archived, row.units_merged, row.units_live) == (4, 1, 80)
    assert row.compression_ratio == pytest.approx(0.8)
    merged = out["units"].where("not is_archived and unit_id < 0").first()
    assert merged.content == "t0 t80 t81 t82" and np.allclose(merged.embedding, x[0])


def test_lsh_pairs_are_exact_ones(spark):
    u = units_of(spark, np.random.default_rng(15).normal(size=(80, 6)))
    exact = {(r.src, r.dst): r.similarity for r in similarity.pairwise(u, 0.6).collect()}
    found = {(r.src, r.dst): r.similarity for r in clustering.lsh_pairs(u, 0.6).collect()}
    assert all(exact[p] == pytest.approx(s) for p, s in found.items()) and len(found) >= 0.8 * len(exact)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from lattice.session import checkpoint_dir

    unset = N(get=lambda *_: None)
    far = N(conf=unset, sparkContext=N(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        checkpoint_dir(far)
    assert checkpoint_dir(N(conf=N(get=lambda *_: "hdfs://x/y/"), sparkContext=None)) == "hdfs://x/y"


def test_tables_of_the_application_can_be_dropped(spark):
    import os

    from lattice.session import drop_tables, table_path

    path = table_path(spark, "t").removeprefix("file:")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path)
    drop_tables(spark)
    assert not os.path.isdir(path)


def test_store_updates_leave_what_they_lack(spark, tmp_path):
    from lattice.sources.store import Store

    store = Store(spark, str(tmp_path))
    store.append("settings", spark.createDataFrame([("a", "w", "k", "1")], "id string, workspace_id string, key string, value string"))
    store.update("settings", spark.createDataFrame([("a", "2"), ("b", "3")], "id string, value string"))
    assert [(r.id, r.key, r.value) for r in store.scan("settings").collect()] == [("a", "k", "2")]


def test_silhouette_of_separated_clusters(spark):
    df = units_of(spark, separated()).withColumn("label", F.floor(F.col("unit_id") / 20))
    assert clusters.silhouette(df).first()[0] > 0.9
