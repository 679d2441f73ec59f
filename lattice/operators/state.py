"""Order-dependent state: ranker weights, focus buffer, head weights, chunks.

Folds run over sorted batches with the state carried from one to the next, so a key's rows are never gathered; where a
closed form exists it takes the fold's place. The streaming forms in lattice.streaming keep the same state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lattice.functions import text as T
from lattice.functions import vectors as V

FEATURES = ("semantic", "focus", "recency", "frequency", "score", "diversity", "length", "complexity", "relevance", "contextual")
INITIAL = [1.0] + [0.0] * 9


def ordered(df: DataFrame, key: list[str], order: list[str], values: list[str], name: str = "events") -> DataFrame:
    """(key, events): an array of structs in order."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias(name))


def ranker_features(pairs: DataFrame, query: str = "query_vector", vector: str = "embedding", content: str = "content", by: str = "query_id") -> DataFrame:
    """pairs (query_id, query_vector, unit_id, embedding, content, optional focus, recency, frequency, score, semantic_similarity, relevance) with an array `features`.

    Diversity is 1 minus the mean cosine to the other candidates of the query: from the sum of unit vectors, without a self join.
    """
    have = lambda c, default: F.coalesce(F.col(c).cast("double"), F.lit(default)) if c in pairs.columns else F.lit(default)
    sim = F.coalesce(V.cosine(F.col(vector), F.col(query)), F.lit(0.0))
    first = F.coalesce(*[F.col(c).cast("double") for c in ("score", "semantic_similarity") if c in pairs.columns], F.lit(0.5))
    parts = [sim, have("focus", 0.0), have("recency", 0.5), have("frequency", 0.5), first, F.col("_diversity"), T.length_score(F.col(content)), T.complexity(F.col(content)), have("relevance", 0.5), sim]
    return diversity(pairs, by, vector, "_diversity").withColumn("features", F.array(*[p.cast("double") for p in parts])).drop("_diversity")


def diversity(pairs: DataFrame, by: str = "query_id", vector: str = "embedding", name: str = "diversity") -> DataFrame:
    """1 - mean cosine to the other candidates; 1 for a single one, 0.5 without a vector."""
    u = V.unit(F.col(vector))
    sums = pairs.where(F.col(vector).isNotNull()).select(by, F.posexplode(u).alias("p", "x")).groupBy(by, "p").agg(F.sum("x").alias("x")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("_sum"))
    count = pairs.where(F.col(vector).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    own = V.dot(u, u)
    value = 1 - (V.dot(u, F.col("_sum")) - own) / (F.col("_n") - 1)
    out = pairs.join(sums, by, "left").join(count, by, "left")
    return out.withColumn(name, F.when(F.col(vector).isNull(), 0.5).when(F.col("_n") <= 1, 1.0).otherwise(value)).drop("_sum", "_n")


def rerank(pairs: DataFrame, weights: list[float] | Column = None, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Adds rl_score, the dot product of features and weights, with seeded Gaussian exploration noise where it is wanted."""
    w = F.array(*[F.lit(float(x)) for x in (INITIAL if weights is None else weights)]) if not isinstance(weights, Column) else weights
    score = V.dot(F.col("features"), w)
    return pairs.withColumn("rl_score", score + noise * F.randn(seed) if noise else score)


def fold_sorted(df: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, dict[str, np.ndarray]], Any], finish: Callable[[Any], list[tuple]], schema: str) -> DataFrame:
    """Folds each key's rows in order, batch by batch: only the state is carried, however many rows a key has.

    step(state, columns of a run of one key's rows) -> state; finish(state) -> rows of schema without the key, which
    comes first. Rows of a key are sorted (and spilled) by Spark; null keys are a key of their own.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))
    names = kind.names
    columns = [c for c in df.columns if c != key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, any_ = None, None, False

        def close() -> pa.RecordBatch:
            rows = [(at, *r) for r in finish(state)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind.field(i).type) for i in range(len(names))], names=names)

        for batch in batches:
            if not len(batch):
                continue
            coded = batch.column(0).dictionary_encode()
            codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            for low, high in zip(starts, np.append(starts[1:], len(codes))):
                now = batch.column(0)[int(low)].as_py()
                if not any_ or now != at:
                    if any_:
                        yield close()
                    at, state, any_ = now, start(), True
                part = batch.slice(int(low), int(high - low))
                state = step(state, {c: part.column(i + 1) for i, c in enumerate(columns)})
        if any_:
            yield close()

    return df.select(key, *columns).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def update_weights(feedback: DataFrame, model: str = "model_id", order: str = "seq", rate: float = 0.1, bound: float = 10.0, start: list[float] | None = None) -> DataFrame:
    """(model, weights): w <- clip(w + rate * (rating - w.f) * f, +-bound), folded over each model's feedback in order."""
    first = np.array(INITIAL if start is None else start, dtype=float)

    def step(w: np.ndarray, rows: dict) -> np.ndarray:
        features = rows["features"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(w))
        for f, rating in zip(features, rows["rating"].to_numpy(zero_copy_only=False)):
            w = np.clip(w + rate * (rating - w @ f) * f, -bound, bound)
        return w

    rows = feedback.where(F.col("rating").isNotNull() & (F.size("features") == len(first))).select(model, order, F.col("rating").cast("double").alias("rating"), V.doubles(F.col("features")).alias("features"))
    return fold_sorted(rows, model, [order], lambda: first, step, lambda w: [(w.tolist(),)], f"{model} {dict(feedback.dtypes)[model]}, weights array<double>")


def feedback_metrics(feedback: DataFrame, model: str = "model_id", order: str = "seq", last: int = 10) -> DataFrame:
    """(model, count, mean, population variance, mean of the last ratings)."""
    place = F.row_number().over(Window.partitionBy(model).orderBy(F.desc(order)))
    return feedback.withColumn("_p", place).groupBy(model).agg(F.count(F.lit(1)).alias("total_feedback"), F.avg("rating").alias("average_rating"), F.var_pop("rating").alias("rating_variance"), F.avg(F.when(F.col("_p") <= last, F.col("rating"))).alias("recent_average"))


def decayed_mean(history: DataFrame, key: str, order: str, value: str, decay: float = 0.95, keep: int = 100) -> DataFrame:
    """history with decayed_mean: the mean of the last `keep` scores, each decayed once for every later one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(keep - 1), 0)
    row = history.withColumn("_h", F.collect_list(value).over(w))
    n = F.size("_h")
    total = F.aggregate(F.transform("_h", lambda x, i: x * F.pow(F.lit(decay), (n - 1 - i).cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return row.withColumn("decayed_mean", total / n).drop("_h")


def head_weights(performance: DataFrame, key: str = "model_id", order: str = "seq", heads: tuple[str, ...] = ("semantic", "structural", "temporal"), momentum: float = 0.9) -> DataFrame:
    """(key, one weight a head): first the normalised performance, then momentum * old + (1 - momentum) * new, normalised again.

    Shares sum to 1 and so does every mixture of them, so the fold is a weighted sum: a row's share counts by
    momentum ** (number of later rows), times 1 - momentum for all but the first. Only that number needs an order.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    total = sum((F.col(h) for h in heads), F.lit(0.0))
    share = lambda h: F.when(total > 0, F.col(h) / F.when(total > 0, total).otherwise(1.0)).otherwise(1 / len(heads))
    rows = performance.select(key, order, *[share(h).alias(h) for h in heads]).withColumn("_later", place - 1)
    power = F.pow(F.lit(momentum), F.col("_later").cast("double"))
    sums = rows.groupBy(key).agg(*[F.sum(power * F.col(h)).alias(f"_{h}") for h in heads], *[F.max_by(F.struct(power.alias("p"), F.col(h).alias("h")), "_later").alias(f"_first_{h}") for h in heads])
    return sums.select(key, *[((1 - momentum) * F.col(f"_{h}") + momentum * F.col(f"_first_{h}.p") * F.col(f"_first_{h}.h")).alias(h) for h in heads])


def update_focus(items: dict, ts: float, touched: list[str], action: str, most: int = 20, decay: float = 0.05) -> dict:
    """One focus-buffer step over {item: (weight, frequency, relevance, last)}; used by the batch and the streaming form.

    Items not touched decay; a touched one gains frequency and relevance and its weight is restored; a new one starts at
    the boost (1.5 for 'activate', else 1). Beyond `most` items those of the least 0.7 weight + 0.3 age share go.
    """
    boost = 1.5 if action == "activate" else 1.0
    out = {i: (w if i in touched else w * (1 - decay), f, r, t) for i, (w, f, r, t) in items.items()}
    for i in touched:
        if i in out:
            _, f, r, _ = out[i]
            r += 0.2 * boost
            out[i] = (r, f + 1, r, ts)
        else:
            out[i] = (boost, 1, boost, ts)
    if len(out) > most:
        order = sorted(out, key=lambda i: (-(0.7 * out[i][0] + 0.3 * (out[i][3] / ts if ts else 0.0)), i))
        out = {i: out[i] for i in order[:most]}
    return out


class _Focus:
    """The fold of update_focus for single items: decay is counted in steps and worked out only where weights are compared."""

    def __init__(self, most: int, decay: float):
        self.items: dict = {}  # item: [weight at the step it was touched, frequency, relevance, last, step]
        self.at, self.most, self.keep = 0, most, 1 - decay

    def touch(self, ts: float, item, boost: float) -> None:
        self.at += 1
        old = self.items.get(item)
        if old is None:
            self.items[item] = [boost, 1, boost, ts, self.at]
            if len(self.items) > self.most:
                order = sorted(self.items, key=lambda i: (-(0.7 * self.weight(i) + 0.3 * (self.items[i][3] / ts if ts else 0.0)), i))
                del self.items[order[-1]]
        else:
            r = old[2] + 0.2 * boost
            self.items[item] = [r, old[1] + 1, r, ts, self.at]

    def weight(self, item) -> float:
        w, _, _, _, step = self.items[item]
        return w * self.keep ** (self.at - step)


def focus_buffer(events: DataFrame, session: str = "session_id", order: list[str] = ("ts", "event_id"), item: str = "item", action: str = "action", most: int = 20, decay: float = 0.05) -> DataFrame:
    """(session, item, weight, frequency, relevance) after all events of a session in order; ts are seconds."""
    kinds = dict(events.dtypes)

    def step(focus: _Focus, rows: dict) -> _Focus:
        for ts, i, a in zip(*(rows[c].to_pylist() for c in (order[0], item, action))):
            focus.touch(float(ts), i, 1.5 if a == "activate" else 1.0)
        return focus

    rows = events.select(session, *order, item, action).where(F.col(item).isNotNull() & F.col(order[0]).isNotNull())
    return fold_sorted(rows, session, list(order), lambda: _Focus(most, decay), step, lambda f: [(i, f.weight(i), v[1], v[2]) for i, v in f.items.items()], f"{session} {kinds[session]}, item {kinds[item]}, weight double, frequency bigint, relevance double")


def top_focus(focus: DataFrame, session: str = "session_id", n: int = 3) -> DataFrame:
    w = Window.partitionBy(session).orderBy(F.desc("weight"), "item")
    return focus.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def last_n(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each key, with their place counted from the oldest of them."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    kept = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, by: list[str], order: str) -> DataFrame:
    """The latest row of each key; a new row wins over an old one of the same time."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, by, [order, "_new"]).drop("_new")


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 512, threshold: float = 0.82, most: int | None = None, embed=None) -> DataFrame:
    """(key, chunk_no, chunk): semantic chunks. Up to two sentences make one chunk of the whole text.

    A chunk closes before a sentence once it has `least` characters and the running mean of its sentence vectors has a
    cosine below the threshold to the sentence's. embed: text -> vector column (default the MD5 vector). most: an
    optional cap on the characters of a chunk. Sentences and vectors are made in Catalyst; only lengths and vectors go to
    Python, where all documents of a batch advance together, and only the places of the cuts come back.
    """
    embed = embed or T.md5_vector

    @F.arrow_udf("array<int>")
    def cuts(lengths: pa.Array, vectors: pa.Array) -> pa.Array:
        count = lengths.value_lengths().to_numpy(zero_copy_only=False)
        size = lengths.flatten().to_numpy(zero_copy_only=False)
        flat = vectors.flatten().flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(len(size), -1) if len(size) else np.zeros((0, 1))
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))
        first = np.cumsum(count) - count
        begins = np.zeros(len(size), dtype=bool)
        begins[first[count > 0]] = True
        mean, n, length = x[np.minimum(first, max(0, len(x) - 1))].copy() if len(x) else x, np.ones(len(count)), size[np.minimum(first, max(0, len(size) - 1))].copy() if len(size) else size
        going = np.flatnonzero(count > 2)
        for i in range(1, int(count.max()) if len(count) else 0):
            going = going[count[going] > i]
            if not len(going):
                break
            at = first[going] + i
            m, v = mean[going], x[at]
            both = np.sqrt(np.einsum("ij,ij->i", m, m)) * norms[at]
            cosine = np.where(both > 0, np.einsum("ij,ij->i", m, v) / np.where(both > 0, both, 1), 0.0)
            close = (length[going] >= least) & (cosine < threshold)
            if most is not None:
                close |= length[going] + size[at] + 1 > most
            begins[at] = close
            k = n[going, None]
            mean[going] = np.where(close[:, None], v, (m * k + v) / (k + 1))
            n[going] = np.where(close, 1, n[going] + 1)
            length[going] = np.where(close, size[at], length[going] + 1 + size[at])
        of = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(size)) - np.repeat(first, count) + 1
        ends = np.concatenate([[0], np.cumsum(np.bincount(of[begins], minlength=len(count)))]) if len(count) else np.zeros(1)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[begins].astype(np.int32)))

    rows = docs.select(key, F.col(text).alias("_t"), T.sentences(F.col(text)).alias("_s")).where("size(_s) > 0")
    placed = rows.withColumn("_b", cuts(F.transform("_s", F.length), F.transform("_s", lambda s: V.doubles(embed(s)))))
    cut_ = placed.select(key, "_t", "_s", "_b", F.posexplode("_b").alias("chunk_no", "_from"))
    upto = F.coalesce(F.try_element_at("_b", F.col("chunk_no") + 2), F.size("_s") + 1)
    whole = F.array_join(F.slice("_s", F.col("_from"), upto - F.col("_from")), " ")
    return cut_.select(key, "chunk_no", F.when(F.size("_s") <= 2, F.col("_t")).otherwise(whole).alias("chunk"))
