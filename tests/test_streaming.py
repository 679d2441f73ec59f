import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.operators import state
from lattice.streaming import stateful

SF = "/root/testdata/sf0.001"


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return q.sparkSession.table(name) if hasattr(q, "sparkSession") else stream.sparkSession.table(name)


@pytest.fixture
def events(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", "event_type", "value").orderBy("ts", "event_id").limit(200)
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    return e, stateful.read_events(spark, str(tmp_path / "e"), e.schema)


def test_windows(spark, events):
    batch, stream = events
    out = run(stateful.windowed(stream), "windows", "complete")
    assert out.agg(F.sum("n")).first()[0] == 200
    assert run(stateful.sessions(stream), "sessions", "append").count() >= 0


def test_focus_stream_equals_the_fold(spark, events):
    batch, stream = events
    out = run(stateful.focus_stream(stream), "focus", "update")
    got = {(r.session, r.item): r.weight for r in out.collect()}
    rows = batch.select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("double").alias("ts"), "event_id", F.col("event_type").alias("item"), F.lit("activate").alias("action"))
    want = {(r.session_id, r.item): r.weight for r in state.focus_buffer(rows).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_ranker_stream_equals_the_fold(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("m", i, float(rng.choice([-1, 1])), [float(x) for x in rng.random(10)]) for i in range(30)]
    df = spark.createDataFrame(rows, "model_id string, seq bigint, rating double, features array<double>")
    df.coalesce(1).write.parquet(str(tmp_path / "f"))
    out = run(stateful.ranker_stream(stateful.read_events(spark, str(tmp_path / "f"), df.schema)), "ranker", "update").orderBy(F.desc("seen")).first()
    assert out.seen == 30 and np.allclose(out.weights, state.update_weights(df).first().weights)


def test_change_feed(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    df.coalesce(1).write.parquet(str(tmp_path / "c"))
    seen = []
    q = stateful.change_feed(stateful.read_events(spark, str(tmp_path / "c"), df.schema), "k", ["k", "v"], lambda batch, _: seen.extend(batch.collect()), str(tmp_path / "checkpoint"))
    q.awaitTermination(60)
    q.stop()
    assert sorted(r.key for r in seen) == ["a", "b"]
