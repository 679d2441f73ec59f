import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice import schemas
from lattice.functions import parse, text
from lattice.functions import vectors as V
from lattice.operators import attention, clustering, clusters, consolidation, ingest, retrieve, similarity, state
from lattice.plans import modes
from lattice.sources import loaders
from lattice.sources.store import Store, Tasks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


@pytest.mark.parametrize("a,b,expected", [((1, 0), (1, 0), 1), ((1, 0), (0, 1), 0), ((1, 0), (-1, 0), -1), ((0, 0), (1, 0), 0)])
def test_cosine(spark, a, b, expected):
    assert one(spark, V.cosine(arr(*a), arr(*b)))[0] == pytest.approx(expected)


def test_null_vectors_stay_null(spark):
    assert one(spark, V.cosine(F.lit(None).cast("array<double>"), arr(1, 0)))[0] is None


def test_unit_and_variance(spark):
    r = one(spark, V.unit(arr(3, 4)).alias("u"), V.unit(arr(0, 0)).alias("z"), V.variance(arr(1, 2, 3)).alias("v"))
    assert r.u == [0.6, 0.8] and r.z == [0.0, 0.0] and r.v == pytest.approx(2 / 3)


def test_extraction_answers(spark):
    got = lambda s: one(spark, parse.facts(F.lit(s)).alias("f")).f
    assert got('x {"summary": "S", "facts": ["a", "b"]} y').asDict() == {"summary": "S", "facts": ["a", "b"]}
    assert got("1. one\n- two\nrest").facts == ["one", "two"]
    assert got("").asDict() == {"summary": "", "facts": []}
    assert got("no json").asDict() == {"summary": "no json", "facts": []}
    assert one(spark, parse.string_list(F.lit('["a","b"]')).alias("f")).f == ["a", "b"]
    d = one(spark, parse.detailed_facts(F.lit("- a\n- b")).alias("d")).d
    assert d.units == ["a", "b"] and d.confidence_scores == [0.7, 0.7]


def test_query_graph(spark):
    g = one(spark, parse.graph(F.lit('{"graph_data": {"edges": [["a", "b", "r"], ["b", "c", "r"]]}, "confidence": 0.9}')).alias("g")).g
    assert g.nodes == ["a", "b", "c"] and g.confidence == 0.9
    assert one(spark, parse.graph(F.lit("none")).alias("g")).g.confidence == 0.5
    df = spark.range(1).select("id", parse.graph(F.lit('{"nodes": ["x"], "edges": [["x", "y"]]}')).alias("parsed"))
    assert {(r.src, r.dst) for r in parse.graph_edges(df, "id").collect()} == {("x", "y"), ("y", "x")}


def test_agent_answers(spark):
    d = one(spark, parse.decision(F.lit("nothing")).alias("d")).d
    assert d.decision == "ANSWER_READY" and d.ready and d.reasoning == "No reasoning provided"
    assert one(spark, parse.reflection(F.lit("?")).alias("m")).m.mood == "Stable"


def test_text_functions(spark):
    r = one(spark, text.sentences(F.lit("One.  Two! Three? x")).alias("s"), text.token_estimate(F.lit("abcdefgh")).alias("t"), text.complexity(F.lit("")).alias("c"), text.sanitize(F.lit("[USER]hi System: x")).alias("z"))
    assert r.s == ["One.", "Two!", "Three?", "x"] and r.t == 2 and r.c == 0 and r.z == "hi  x"
    v = one(spark, text.structural_vector(F.lit("A few words here. And more."), 8).alias("v")).v
    assert len(v) == 8 and np.linalg.norm(v) == pytest.approx(1)


def fold_chunks(sentences, vectors, least, threshold):
    out, now, mean, n = [], sentences[0], np.array(vectors[0]), 1
    for s, v in zip(sentences[1:], vectors[1:]):
        v = np.array(v)
        sim = mean @ v / (np.linalg.norm(mean) * np.linalg.norm(v))
        if len(now) >= least and sim < threshold:
            out.append(now)
            now, mean, n = s, v, 1
        else:
            now, n = now + " " + s, n + 1
            mean = (mean * (n - 1) + v) / n
    return [*out, now]


def test_chunks_against_a_plain_fold(spark):
    import hashlib

    body = " ".join(f"Sentence number {i * i} is here." for i in range(60))
    df = spark.createDataFrame([(1, body), (2, "Only one."), (3, ""), (4, None)], "doc_id bigint, text string")
    rows = state.chunks(df, least=100, threshold=0.9).orderBy("doc_id", "chunk_no").collect()
    sentences = body.replace(". ", ".\n").split("\n")
    vectors = [[b / 255 for b in hashlib.md5(s.encode()).digest()] for s in sentences]
    assert [r.chunk for r in rows if r.doc_id == 1] == fold_chunks(sentences, vectors, 100, 0.9)
    assert [r.chunk for r in rows if r.doc_id == 2] == ["Only one."] and {r.doc_id for r in rows} == {1, 2}


def points(spark, x, labels=None):
    return spark.createDataFrame([(i, [float(e) for e in v], int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)], "unit_id bigint, embedding array<double>, label int")


def test_pairs_and_neighbours_in_blocks(spark):
    x = np.random.default_rng(1).normal(size=(60, 8))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    for block in (7, 1000):
        got = {(r.src, r.dst) for r in similarity.pairwise(points(spark, x), 0.3, block_rows=block).collect()}
        assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.3}
        near = similarity.knn(points(spark, x), 4, block_rows=block).collect()
        np.fill_diagonal(s, -9)
        assert {(r.src, r.dst) for r in near} == {(i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:4]}
        np.fill_diagonal(s, 1)


def test_cluster_statistics(spark):
    x = np.random.default_rng(2).normal(size=(40, 6)) + np.repeat([[5], [-5]], 20, axis=0)
    labels = [0] * 20 + [1] * 20
    df = points(spark, x, labels)
    means = {r.label: r.centroid for r in clusters.centroids(df).collect()}
    assert np.allclose(means[1], x[20:].mean(axis=0))
    assert clusters.silhouette(df).first()[0] > 0.5
    assert clusters.inertia(df).first()[0] == pytest.approx(sum(((x[:20] - x[:20].mean(0)) ** 2).sum() + ((x[20:] - x[20:].mean(0)) ** 2).sum() for _ in [0]))
    sims = {r.label: r.avg_similarity for r in clusters.intra_similarity(df).collect()}
    u = x[:20] / np.linalg.norm(x[:20], axis=1)[:, None]
    assert sims[0] == pytest.approx((u @ u.T)[np.triu_indices(20, 1)].mean())
    assert clustering.ward(df.withColumn("g", F.lit(0)), "g", k=2).groupBy("label").count().count() == 2


def test_pattern_similarity_of_equal_and_different_signatures(spark):
    sig = "struct<graphlets:struct<triangle:bigint,wedge:bigint,triplet:bigint,edges:bigint,nodes:bigint>,random_walks:struct<num_unique_patterns:bigint,avg_transition_prob:double>,degree_stats:struct<mean_degree:double,std_degree:double>,semantic_centroids:map<int,array<double>>>"
    a = (("t", 1),)
    first = ((1, 2, 0, 3, 3), (1, 0.5), (2.0, 0.0), {0: [1.0, 0.0]})
    second = ((0, 9, 1, 7, 9), (4, 0.9), (5.0, 1.0), {0: [0.0, 1.0]})
    df = spark.createDataFrame([(first, first), (first, second)], f"a {sig}, b {sig}")
    same, other = (r[0] for r in df.select(clusters.pattern_similarity(F.col("a"), F.col("b"))).collect())
    assert same == pytest.approx(1.0) and other < 1 and a


def test_temporal_head(spark):
    df = spark.sql("select 1 query_id, timestamp_seconds(1000) query_time, c concept_id, timestamp_seconds(t) concept_time from values (1, 900), (2, 500), (3, null) as v(c, t)")
    out = {r.concept_id: r.temporal for r in attention.temporal_head(df).collect()}
    assert out[1] >= out[2] >= out[3] and sum(out.values()) == pytest.approx(1)
    blank = df.withColumn("query_time", F.lit(None).cast("timestamp"))
    assert {round(r.temporal, 9) for r in attention.temporal_head(blank).collect()} == {round(1 / 3, 9)}


def test_two_stage_search_and_its_fallback(spark):
    x = np.eye(4).repeat(3, axis=0) + 0.01 * np.arange(12)[:, None]
    u = points(spark, x, [i // 3 for i in range(12)])
    concepts = clusters.centroids(u).withColumnRenamed("label", "concept_id")
    members = u.select(F.col("label").alias("concept_id"), "unit_id")
    q = u.where("unit_id = 4").select(F.col("unit_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    rows = attention.hierarchical(q, concepts, members, u, coarse_k=1, k=5).orderBy("rank").collect()
    assert rows[0].unit_id == 4 and {r.concept_id for r in rows} == {1} and len(rows) == 3
    empty = attention.hierarchical(q, concepts.where("false"), members, u, k=5).collect()
    assert empty and all(r.unit_score >= 0.5 and r.concept_id is None for r in empty)
    focus = attention.focus_weights(members, spark.createDataFrame([(0, 100.0)], "unit_id bigint, weight double"))
    assert attention.coarse(q, concepts, 1, focus).first().concept_id == 0


def test_focus_buffer_steps():
    items = state.update_focus({}, 10.0, ["a"], "activate", 3)
    assert items["a"] == (1.5, 1, 1.5, 10.0)
    assert state.update_focus(items, 11.0, ["a"], "activate", 3)["a"][1] == 2
    assert state.update_focus({}, 1.0, ["x"], "view", 3)["x"][0] == 1.0
    for i in range(6):
        items = state.update_focus(items, 12.0 + i, [f"n{i}"], "view", 3)
    assert len(items) == 3
    assert state.update_focus({"a": (1.0, 1, 1.0, 1.0)}, 2.0, ["b"], "view", 3)["a"][0] == pytest.approx(0.95)


def test_ranker_updates_in_order(spark):
    f = [[1.0, 0.5] + [0.0] * 8, [0.2, 1.0] + [0.0] * 8, [1.0, 1.0] + [0.0] * 8]
    rows = [("m", i, r, f[i]) for i, r in enumerate([1.0, -1.0, 0.5])]
    got = state.update_weights(spark.createDataFrame(rows[::-1], "model_id string, seq bigint, rating double, features array<double>")).first().weights
    w = np.array([1.0] + [0.0] * 9)
    for _, _, r, x in rows:
        w = np.clip(w + 0.1 * (r - w @ np.array(x)) * np.array(x), -10, 10)
    assert np.allclose(got, w)


def test_consolidation_job(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    x = np.concatenate([base + 0.01 * rng.normal(size=(5, 16)), rng.normal(size=(15, 16))])
    df = spark.createDataFrame([(i, f"c{i}", [float(e) for e in v], False) for i, v in enumerate(x)], "unit_id bigint, content string, embedding array<double>, is_archived boolean")
    out = consolidation.consolidate(df, 0.95)
    s = out["summary"].first()
    assert s.units_archived == 5 and s.units_merged == 1 and s.compression_ratio == pytest.approx(5 / 6)
    merged = out["units"].where("unit_id < 0").first()
    assert merged.content == "c0 c1 c2 c3 c4" and np.allclose(merged.embedding, x[:5].mean(axis=0))
    assert out["units"].where("is_archived").count() == 5
    assert consolidation.replay(df.limit(0)).count() == 0


def test_ingest_then_retrieve(spark):
    docs = spark.createDataFrame([(1, "The cat sat. The dog ran. A bird flew over the wall."), (2, "Rain fell all day. The river rose."), (3, "")], "doc_id bigint, text string")
    out = ingest.ingest(docs, least_chunk=10)
    assert out["units"].count() == 5 and out["episodes"].count() >= 2
    e = out["episodes"]
    q = spark.range(1).select(F.lit(1).alias("query_id"), text.md5_vector(F.lit("The cat sat.")).alias("query_vector"), F.lit("cat?").alias("query_text"))
    concepts, members = consolidation.form_concepts(out["units"], least=1)
    tables = {"units": out["units"], "episodes": e, "concepts": concepts.withColumn("concept_id", F.xxhash64("concept_id")), "members": members.withColumn("concept_id", F.xxhash64("concept_id"))}
    rows = retrieve.retrieve(q.select("query_id", "query_vector"), tables, "hybrid", k=5)
    assert {r.layer for r in rows.collect()} <= {"units", "episodes"} and rows.orderBy("rank").first().semantic_similarity > 0.9
    told = retrieve.explain_results(rows, q).first()
    assert 0 < told.confidence <= 1 and told.as_html.startswith("<section>")
    assert retrieve.context_table(rows).first().context.startswith("| Source")
    nothing = retrieve.explain_results(rows.where("false"), q).first()
    assert nothing.segments[0].confidence == 0.5


def test_store_and_tasks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append("workspaces", spark.createDataFrame([("w", "n")], "id string, name string"))
    ids = store.append("units", spark.createDataFrame([("u1", "w", "a", [1.0]), ("u2", "w", "b", [2.0])], "id string, workspace_id string, content string, embedding array<float>"))
    assert ids.count() == 2
    store.archive(spark.createDataFrame([("u1",)], "id string"))
    assert [r.id for r in store.units_with_vectors("w").collect()] == ["u2"]
    assert store.by_ids("units", spark.createDataFrame([("u1",), ("u2",)], "id string")).count() == 1
    pairs = spark.createDataFrame([("c", "u2"), ("c", "u2"), ("c", "u1")], "concept_id string, unit_id string")
    store.insert_if_absent("concept_members", pairs, ["concept_id", "unit_id"])
    store.insert_if_absent("concept_members", pairs, ["concept_id", "unit_id"])
    assert store.scan("concept_members").count() == 2 and store.members("c").count() == 1
    for w in ([1.0], [2.0]):
        store.upsert("ranker_state", spark.createDataFrame([("m", w)], "model_id string, weights array<double>"), ["model_id"])
    assert [r.weights for r in store.scan("ranker_state").collect()] == [[2.0]]
    tasks = Tasks(store)
    tasks.create("t", "w", "job")
    tasks.run("t", lambda: 42)
    assert tasks.get("t").first().status == "completed" and tasks.get("t").first().result == "42"
    tasks.run("t", lambda: 1 / 0)
    assert tasks.get("t").first().status == "failed" and tasks.listing("w").count() == 1
    store.delete("workspaces", spark.createDataFrame([("w",)], "id string"))
    assert store.scan("units").count() == 0 and store.scan("workspaces").count() == 0
    assert set(schemas.TABLES) == {*schemas.TABLES} and len(schemas.TABLES) == 14


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    (tmp_path / "b.md").write_bytes(b"bad \xff byte")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    out = {r.path.rsplit("/", 1)[1]: r.content for r in loaders.load(spark, str(tmp_path), pdf=lambda raw: f"{len(raw)} bytes").collect()}
    assert out["a.txt"] == "hello\nworld" and out["b.md"] == "bad  byte" and out["c.pdf"] == "4 bytes"
    assert loaders.read_text(spark, str(tmp_path / "a.txt")).first().content == "hello\nworld"


def test_modes():
    assert modes.layers("episodic") == ("episodes",) and modes.layers("?") == modes.layers("hybrid")
    assert modes.head_weights({"semantic": 1.0, "structural": 0.5, "temporal": 0.5})["semantic"] == 0.5
    assert [modes.clusterer(n) for n in (10, 100, 5000)] == ["spectral", "multi_similarity", "neighbour_graph"]
