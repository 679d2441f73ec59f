import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.engine import Engine
from lattice.functions import providers
from lattice.operators import graph as G
from lattice.operators import patterns
from lattice.operators.index import VectorIndex, map_batches


def test_train_consolidate_retrieve(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    engine.create_workspace("w", "notes")
    docs = spark.createDataFrame([(i, f"Fact {i} about topic {i % 3}. Another fact {i * 7}. The river is long.") for i in range(6)], "doc_id bigint, text string")
    first = engine.train("w", docs, least_chunk=10).first()
    assert first.units > 10 and first.episodes >= 6
    stored = engine.store.scan("units").count()
    engine.train("w", docs, least_chunk=10)
    assert engine.store.scan("units").count() == stored
    questions = {"q": "Fact 3 about topic 0."}
    before = engine.retrieve("w", questions, k=5)
    assert before.orderBy("rank").first().semantic_similarity == pytest.approx(1.0)
    summary = engine.consolidate("w", threshold=0.9999, support=3).first()
    assert summary.units_merged == 1 and summary.units_archived == 6
    after = engine.retrieve("w", questions, k=5)
    rows = after.orderBy("rank").collect()
    assert {r.layer for r in rows} == {"units", "episodes"} or {r.layer for r in rows} == {"units"}
    assert engine.explain(questions, after).first().confidence > 0
    unit = next(r.id for r in rows if r.layer == "units")
    weights = engine.feedback("w", spark.createDataFrame([(1, "q", unit, -1.0)], "seq bigint, query_id string, unit_id string, rating double"), questions)
    assert weights[0] < 1.0 and engine.weights("w") == weights
    engine.delete_workspace("w")
    assert engine.store.scan("units").count() == 0


def test_signature_of_one_graph_equals_the_dense_form(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b), 1.0) for a, b in rng.integers(0, 8, (12, 2)) if a != b]
    pairs = sorted({(min(a, b), max(a, b), w) for a, b, w in pairs})
    edges = G.both_ways(spark.createDataFrame(pairs, "src bigint, dst bigint, weight double"))
    ids = sorted({x for a, b, _ in pairs for x in (a, b)})
    big = patterns.signature(edges, spark.createDataFrame([(i,) for i in ids], "id bigint")).first().asDict(recursive=True)
    small = patterns.signatures(edges.withColumn("g", F.lit("x")), "g").first().asDict(recursive=True)
    small.pop("g")
    assert big["graphlets"] == small["graphlets"] and big["degree_stats"] == small["degree_stats"] and big["graph_properties"] == small["graph_properties"]
    assert big["random_walks"] == pytest.approx(small["random_walks"])


def test_query_signatures_and_the_empty_pattern(spark):
    df = spark.createDataFrame([(1, '{"edges": [["a","b"],["b","c"],["c","a"]]}'), (2, "nothing")], "q bigint, answer string")
    out = {r.q: r for r in patterns.query_signatures(df, "q", "answer").collect()}
    assert out[1].graphlets.triangle == 1 and out[1].degree_stats.mean_degree == 2.0
    assert out[2].graphlets.nodes == 0 and out[2].random_walks.return_probability == 0.0


def test_index(spark):
    units = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(10)], "unit_id bigint, embedding array<double>")
    index = VectorIndex().add(units)
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert index.search(q, 3).first().unit_id == 0
    index.remove(spark.createDataFrame([(0,)], "unit_id bigint"))
    assert 0 not in {r.unit_id for r in index.search(q, 9).collect()}
    rows, info = index.page(q, 9, 2, 4)
    assert rows.count() == 4 and info.first().total_pages == 3
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame([(1, [1.0])], "unit_id bigint, embedding array<double>"))
    assert index.reset().rows is None


def test_batches_turn_errors_into_nulls(spark):
    df = spark.createDataFrame([(1, "2"), (2, "x"), (3, "5")], "id bigint, v string")
    out = {r.id: r.result_value for r in map_batches(df, lambda s: s.astype(float), "v").collect()}
    assert out == {1: 2.0, 2: None, 3: 5.0}


def test_providers(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    embed = providers.embedder(lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert [r[0] for r in df.select(embed(F.col("t"))).collect()] == [[2.0, 1.0], [0.0, 1.0]]
    say = providers.generator(lambda p: p.upper())
    assert [r[0] for r in df.select(say(F.col("t"))).collect()] == ["AB", None]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError
        return "ok"

    assert providers.with_retries(flaky, 3, 0)() == "ok"
    with pytest.raises(ZeroDivisionError):
        providers.with_retries(lambda: 1 / 0, 2, 0)()


def test_agent(spark, tmp_path):
    from lattice.agent import Agent

    engine = Engine(spark, str(tmp_path / "a"))
    engine.create_workspace("w")
    engine.train("w", spark.createDataFrame([(1, "Cats sleep a lot. Dogs bark at night. Rain falls in spring.")], "doc_id bigint, text string"), least_chunk=10)
    judged = F.lit("<decision>SEARCH</decision><query>Dogs bark at night.</query>")
    agent = Agent(engine, "w", generate=lambda p: F.concat(F.lit("re: "), F.substring(p, 1, 4)), decide=lambda q: F.lit("Episodic, I think"), evaluate=lambda p: judged)
    assert agent.mode("Cats?") == "episodic"
    assert agent.chat("s", "Cats sleep a lot.") == "re: Cats"
    agent.decide = None
    assert agent.chat("s", "Dogs bark at night.").startswith("re: ")
    focus = agent.focus("s")
    assert focus and max(v[0] for v in focus.values()) == 1.5
    agent.chat("s", "Rain?")
    assert agent.history("s").count() == 6
    found = agent.research("Cats?", rounds=2)
    assert {r["round"] for r in found.select("round").distinct().collect()} == {1, 2}
    assert agent.reflect("s")["mood"] == "Stable" and engine.store.latest("consciousness", ["workspace_id"]).count() == 1
