"""Streaming forms of the ordered state, and windowed views of an event stream. Extensions: the batch folds are the reference form.

Event times are cast to timestamp first, as watermarks refuse timestamp_ntz. State is kept per key; a key that is idle
for `ttl` is dropped by an event-time timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lattice.operators.state import update_focus


def read_events(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and key; rows later than the watermark are dropped."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return e.groupBy(window, key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Session windows by key."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def focus_stream(events: DataFrame, session: str = "user_id", time: str = "ts", item: str = "event_type", action: str = "activate", most: int = 20, decay: float = 0.05, late: str = "10 minutes") -> DataFrame:
    """(session, item, weight, frequency, relevance): the focus buffer of each session after each batch. Update mode."""
    e = events.select(F.col(session).cast("string").alias("session"), F.col(time).cast("timestamp").alias("ts"), F.col(item).cast("string").alias("item")).withWatermark("ts", late)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        items = {i: (w, f, r, t) for i, w, f, r, t in zip(*state.get)} if state.exists else {}
        rows = pd.concat(list(parts)).sort_values(["ts", "item"])
        for ts, i in zip(rows["ts"], rows["item"]):
            items = update_focus(items, ts.timestamp(), [i], action, most, decay)
        kept = [(i, *v) for i, v in items.items()]
        state.update(tuple(list(c) for c in zip(*kept)))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + 86_400_000)
        yield pd.DataFrame([(key[0], i, w, f, r) for i, w, f, r, _ in kept], columns=["session", "item", "weight", "frequency", "relevance"])

    kept = "items array<string>, weights array<double>, frequencies array<bigint>, relevances array<double>, times array<double>"
    return e.groupBy("session").applyInPandasWithState(step, "session string, item string, weight double, frequency bigint, relevance double", kept, "update", GroupStateTimeout.EventTimeTimeout)


def ranker_stream(feedback: DataFrame, model: str = "model_id", order: str = "seq", rate: float = 0.1, bound: float = 10.0) -> DataFrame:
    """(model, seen, weights) after each batch of (model, seq, rating, features). Update mode; within a batch rows are taken in order of seq."""
    import numpy as np

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, w = (state.get[0], np.array(state.get[1])) if state.exists else (0, np.array([1.0] + [0.0] * 9))
        rows = pd.concat(list(parts)).sort_values(order)
        for rating, f in zip(rows["rating"], rows["features"]):
            f = np.asarray(f, dtype=float)
            w = np.clip(w + rate * (rating - w @ f) * f, -bound, bound)
        seen += len(rows)
        state.update((seen, w.tolist()))
        yield pd.DataFrame({"model": [key[0]], "seen": [seen], "weights": [w.tolist()]})

    f = feedback.select(F.col(model).cast("string").alias("model"), F.col(order).alias(order), "rating", "features")
    return f.groupBy("model").applyInPandasWithState(step, "model string, seen bigint, weights array<double>", "seen bigint, weights array<double>", "update", GroupStateTimeout.NoTimeout)


def change_feed(stream: DataFrame, key: str, columns: list[str], sink, checkpoint: str):
    """Starts a query that hands sink(batch, id) only rows whose content changed since the key's last batch (and once within it)."""
    digest = F.md5(F.to_json(F.struct(*columns)))

    def step(key_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for part in parts:
            for row in part.itertuples(index=False):
                if row.digest != last:
                    out.append(row)
                    last = row.digest
        if last is not None:
            state.update((last,))
        if out:
            yield pd.DataFrame(out)

    rows = stream.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("content"), digest.alias("digest"))
    changed = rows.groupBy("key").applyInPandasWithState(step, "key string, content string, digest string", "last string", "append", GroupStateTimeout.NoTimeout)
    return changed.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
