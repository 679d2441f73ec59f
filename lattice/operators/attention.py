"""Scoring heads over concepts and their combination, two-stage retrieval, layer fusion, attention over edges.

All take many queries at once: a row per (query, concept), softmax and normalisation as windows by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattice.functions import vectors as V
from lattice.operators.alike import merge_sums
from lattice.operators.similarity import BLOCK_ROWS, block_count, meeting, numbers, other_blocks, ranked, search, usable

EPS = 1e-8
TERMS = 20_000  # monomials of a series: 160 kB a row, of 128 rows at a time
FIXED = {"semantic": 0.4, "structural": 0.4, "temporal": 0.2}
ADAPTIVE = {"semantic": 8 / 21, "structural": 7 / 21, "temporal": 6 / 21}


def softmax_over(df: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """exp(x - max) over its sum, within by."""
    w = Window.partitionBy(*by)
    shifted = df.withColumn("_e", F.exp(F.col(column) - F.max(column).over(w)))
    return shifted.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def normalise(df: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """x / (sum of x + 1e-8) within by."""
    return df.withColumn(name, F.col(column) / (F.sum(column).over(Window.partitionBy(*by)) + EPS))


def semantic_head(pairs: DataFrame, query: str = "query_vector", concept: str = "centroid", by: str = "query_id") -> DataFrame:
    """pairs with semantic: softmax of the floored cosine."""
    return softmax_over(pairs.withColumn("_s", V.cosine_floored(F.col(query), F.col(concept))), "_s", [by], "semantic").drop("_s")


def temporal_head(pairs: DataFrame, query_time: str = "query_time", concept_time: str = "concept_time", by: str = "query_id") -> DataFrame:
    """pairs with temporal: softmax of exp(-age / 30 days); a missing concept time counts as twice the greatest age.

    Without a query time, or where no concept has a time, all are alike.
    """
    w = Window.partitionBy(by)
    age = F.abs(F.unix_timestamp(F.col(query_time).cast("timestamp")) - F.unix_timestamp(F.col(concept_time).cast("timestamp"))).cast("double")
    aged = pairs.withColumn("_age", age).withColumn("_age", F.coalesce("_age", 2 * F.max("_age").over(w)))
    return softmax_over(aged.withColumn("_t", F.coalesce(V.time_decay(F.col("_age")), F.lit(0.0))), "_t", [by], "temporal").drop("_age", "_t")


def structural_head(pairs: DataFrame, similarity: str = "pattern_similarity", by: str = "query_id") -> DataFrame:
    return softmax_over(pairs, similarity, [by], "structural")


def combine_heads(scored: DataFrame, weights: dict[str, float] | None = None, k: int | None = None, by: str = "query_id", key: str = "concept_id") -> DataFrame:
    """Normalises each head, adds them by weight, normalises again (score), ranks, and keeps the top k."""
    weights = FIXED if weights is None else weights
    for head in weights:
        scored = normalise(scored, head, [by], f"{head}_normalised")
    total = sum((F.lit(w) * F.col(f"{head}_normalised") for head, w in weights.items()), F.lit(0.0))
    out = ranked(normalise(scored.withColumn("_c", total), "_c", [by], "score").drop("_c"), [by], [F.desc(F.round("score", 12)), F.col(key)])
    return out if k is None else out.where(F.col("rank") <= k)


def head_contributions(top: DataFrame, by: str = "query_id") -> DataFrame:
    """(query, mean of each head over its top concepts, primary factor)."""
    means = top.groupBy(by).agg(*[F.avg(h).alias(f"mean_{h}") for h in ("semantic", "structural", "temporal")])
    return means.withColumn("primary_factor", F.when(F.col("mean_semantic") > F.col("mean_structural"), "semantic").otherwise("structural"))


def focus_weights(members: DataFrame, focus: DataFrame) -> DataFrame:
    """(concept_id, focus): the sum of the focus weights of a concept's units."""
    return members.join(focus.select("unit_id", "weight"), "unit_id", "left").groupBy("concept_id").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("focus"))


def coarse(queries: DataFrame, concepts: DataFrame, k: int = 5, focus: DataFrame | None = None, factor: float = 0.5) -> DataFrame:
    """Stage one: (query_id, concept_id, concept_score, concept_rank) of the k best concepts."""
    bonus = None
    if focus is not None:
        bonus = "_bonus"
        concepts = concepts.join(focus.select("concept_id", (factor * F.coalesce("focus", F.lit(0.0))).alias(bonus)), "concept_id", "left")
    found = search(queries.select("query_id", F.col("query_vector").alias("embedding")), concepts, k, metric="cosine_padded", key="concept_id", vector="centroid", bonus=bonus)
    return found.select("query_id", "concept_id", F.col("similarity").alias("concept_score"), F.col("rank").alias("concept_rank"))


def hierarchical(queries: DataFrame, concepts: DataFrame, members: DataFrame, units: DataFrame, coarse_k: int = 5, k: int = 10, focus: DataFrame | None = None) -> DataFrame:
    """Two-stage retrieval: the members of the best concepts, ranked by similarity to the query.

    (query_id, unit_id, concept_id, concept_score, concept_rank, unit_score, rank). A unit in several chosen concepts
    stays with the best ranked. Where there is no concept at all, units of similarity 0.5 or more are returned, of no concept.
    """
    if concepts.isEmpty():
        found = search(queries.select("query_id", F.col("query_vector").alias("embedding")), units, k, 0.5)
        return found.select("query_id", "unit_id", F.lit(None).cast(dict(members.dtypes)["concept_id"]).alias("concept_id"), F.lit(0.0).alias("concept_score"), F.lit(None).cast("int").alias("concept_rank"), F.col("similarity").alias("unit_score"), "rank")
    chosen = coarse(queries, concepts, coarse_k, focus)
    scored = _members_of(chosen, queries, members, units, k)
    first = ranked(scored, ["query_id", "unit_id"], [F.col("concept_rank")], "_n").where("_n = 1").drop("_n")
    return ranked(first, ["query_id"], [F.desc(F.round("unit_score", 12)), F.col("unit_id")]).where(F.col("rank") <= k)


def _members_of(chosen: DataFrame, queries: DataFrame, members: DataFrame, units: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """chosen with unit_id and unit_score of the k best units of each chosen concept (and ties at the edge).

    A query's best units are among the best of each concept that holds them, so no more need leave a concept. Blocks of the
    queries of a concept meet blocks of its units, a matrix product each.
    """
    held = members.join(usable(units.select(F.col("unit_id").alias("id"), numbers(units, "embedding").alias("v"))).withColumnRenamed("id", "unit_id"), "unit_id")
    most = members.groupBy("concept_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    blocks, parts = block_count(most, block_rows), block_count(queries.count(), block_rows)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    right = held.select("concept_id", F.size("v").alias("dim"), spread(parts).alias("a"), F.pmod(F.xxhash64("unit_id"), F.lit(blocks)).alias("b"), "unit_id", "v")
    left = chosen.join(queries.select("query_id", numbers(queries, "query_vector").alias("w")), "query_id").select("query_id", F.col("concept_id").alias("concept_id"), "concept_score", "concept_rank", "w", F.size("w").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("a"), spread(blocks).alias("b"))

    def meet(asked: pa.Table, stored: pa.Table) -> pa.Table:
        columns = ["query_id", "concept_id", "concept_score", "concept_rank"]
        if not len(asked) or not len(stored):
            return pa.table({c: pa.array([], t) for c, t in zip([*columns, "unit_id", "unit_score"], types)})
        q, u = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1).astype(float) for t, c in ((asked, "w"), (stored, "v")))
        length = np.sqrt((u * u).sum(axis=1))
        rows, at, values = [], [], []
        step = max(32, (1 << 22) // len(u))
        for cut_ in range(0, len(q), step):
            x = q[cut_ : cut_ + step]
            s = (x @ u.T) / (np.sqrt((x * x).sum(axis=1))[:, None] * length[None, :] + EPS)
            keep = s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] - 1e-9 if k < len(u) else np.ones(s.shape, dtype=bool)
            i, j = np.nonzero(keep)
            rows.append(cut_ + i)
            at.append(j)
            values.append(s[i, j])
        taken = asked.select(columns).take(pa.array(np.concatenate(rows)))
        return taken.append_column("unit_id", stored.column("unit_id").take(pa.array(np.concatenate(at)))).append_column("unit_score", pa.array(np.concatenate(values)))

    known = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    kinds = [dict(chosen.dtypes)["query_id"], dict(chosen.dtypes)["concept_id"], "double", "int", dict(members.dtypes)["unit_id"], "double"]
    types = [known[x] for x in kinds]
    names = ["query_id", "concept_id", "concept_score", "concept_rank", "unit_id", "unit_score"]
    return meeting(left, right, ["concept_id", "dim", "a", "b"], 12 * blocks * parts).applyInArrow(meet, ", ".join(f"{n} {t}" for n, t in zip(names, kinds)))


def item_scores(hits: DataFrame, weight: float = 0.7) -> DataFrame:
    """hits with score = 0.7 cosine(query, unit) + 0.3 concept score; a missing vector counts as cosine 0."""
    return hits.withColumn("score", weight * F.coalesce("cosine", F.lit(0.0)) + (1 - weight) * F.col("concept_score"))


def coarse_scores(query: Column, vectors: DataFrame, k: int = 5, connectivity: str | None = None, key: str = "concept_id", vector: str = "centroid") -> DataFrame:
    """Inner products, not normalised, optionally weighed by a connectivity column; the k best."""
    score = V.dot(F.col(vector), query)
    return vectors.withColumn("score", score * F.col(connectivity) if connectivity else score).orderBy(F.desc("score"), key).limit(k)


_PARTIAL = "most double, total double, attended array<double>"


def graph_attention(edges: DataFrame, values: DataFrame, key: str = "id", vector: str = "embedding", scale: float | None = None, salts: int = 32) -> DataFrame:
    """(id, attended): for each source of an edge, softmax over its targets of q.k / scale, then the weighted sum of their vectors.

    scale defaults to the root of the dimension. This is sparse attention over the edges, without learned projections. The
    targets of a source are summed in `salts` parts that are joined afterwards, so a hub is not one task.
    """
    q = values.select(F.col(key).alias("src"), V.doubles(F.col(vector)).alias("q"))
    v = values.select(F.col(key).alias("dst"), V.doubles(F.col(vector)).alias("v"))
    by = F.sqrt(F.size("q").cast("double")) if scale is None else F.lit(scale)
    scored = edges.select("src", "dst").distinct().join(q, "src").join(v, "dst").select("src", F.pmod(F.xxhash64("dst"), F.lit(salts)).alias("salt"), (V.dot(F.col("q"), F.col("v")) / by).alias("s"), "v").where("s is not null")
    kind = dict(scored.dtypes)["src"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            at, s = coded.indices.to_numpy(), batch.column(2).to_numpy()
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(s), -1) if len(s) else np.zeros((0, 0))
            n = len(coded.dictionary)
            most = np.full(n, -np.inf)
            np.maximum.at(most, at, s)
            w = np.exp(s - most[at])
            sums = np.zeros((n, x.shape[1]))
            np.add.at(sums, at, w[:, None] * x)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(most), pa.array(np.bincount(at, weights=w, minlength=n)), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["src", "most", "total", "attended"])

    parts = scored.repartition("src", "salt").mapInArrow(part, f"src {kind}, {_PARTIAL}")
    return merge_sums(parts, ["src"]).withColumnRenamed("src", "id")


def multi_head_attend(values: DataFrame, heads: int = 8, projections: dict[str, np.ndarray] | None = None, key: str = "id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, terms: int = TERMS) -> DataFrame:
    """(id, attended): scaled dot-product attention of every row to all rows, by heads, which are then joined again.

    projections: matrices query, key, value and output (vector times matrix); what is missing is the identity.

    Where the scores are small enough for a series of exp of at most `terms` monomials to be exact in doubles (a relative
    remainder under 1e-12), the keys come in by their moments, so the work grows with the rows. Else blocks of queries meet
    blocks of keys and send on partial softmax sums; nothing of rows x rows is held or shuffled either way.
    """
    given = {name: np.asarray(m, dtype=float) for name, m in (projections or {}).items()}
    base = usable(values.select(F.col(key).alias("id"), V.doubles(F.col(vector)).alias("v"))).select("id", "v", F.size("v").alias("dim"))

    def project(x: np.ndarray, name: str) -> np.ndarray:
        return x @ given[name] if name in given else x

    def matrix(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        c = t.column("v")
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        return c.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The greatest norms of queries and keys of a head, by dimension."""
        for batch in batches:
            for dim in pc.unique(batch.column("dim")).to_pylist():
                x = matrix(batch.filter(pc.equal(batch.column("dim"), dim)))
                size = [project(x, n) for n in ("query", "key")]
                size = [np.sqrt((m[:, : m.shape[1] // heads * heads].reshape(len(m), heads, -1) ** 2).sum(axis=2).max(initial=0)) for m in size]
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "q": [float(size[0])], "k": [float(size[1])], "w": pa.array([project(x[:1], "query").shape[1] // heads], pa.int32())})

    found = base.mapInArrow(longest, "dim int, q double, k double, w int").groupBy("dim").agg(F.max("q").alias("q"), F.max("k").alias("k"), F.max("w").alias("w")).collect()
    whole = None
    if len(found) == 1 and found[0]["w"]:
        degree = _series_degree(found[0]["q"] * found[0]["k"] / math.sqrt(found[0]["w"]), found[0]["w"], terms)
        if degree is not None:
            whole = _attend_by_moments(base, heads, project, matrix, found[0]["w"], degree)
    if whole is None:
        whole = _attend_by_blocks(base, values.count(), heads, project, matrix, block_rows)
    if "output" not in given:
        return whole
    columns = [F.array(*[F.lit(float(x)) for x in column]) for column in given["output"].T]
    return whole.select("id", F.array(*[V.dot(F.col("attended"), c) for c in columns]).alias("attended"))


def _series_degree(most: float, size: int, terms: int) -> int | None:
    """The least degree at which the series of exp over [-most, most] has a remainder under 1e-12 of its sum, if it has few enough terms."""
    degree = 1
    while math.comb(size + degree, degree) <= terms:
        if most ** (degree + 1) / math.factorial(degree + 1) * math.exp(min(2 * most, 700)) < 1e-12:
            return degree
        degree += 1
    return None


def _monomials(size: int, degree: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each degree the place of the factor of one degree less and of the variable it is multiplied by; and 1 / (product of factorials)."""
    level, steps, exponents, first = [((0,) * size, 0)], [], [(0,) * size], 0
    for _ in range(degree):
        parents, by, new = [], [], []
        for place, (e, least) in enumerate(level):
            for i in range(least, size):
                parents.append(first + place)
                by.append(i)
                new.append((e[:i] + (e[i] + 1,) + e[i + 1 :], i))
        first += len(level)
        steps.append((np.array(parents), np.array(by)))
        exponents += [e for e, _ in new]
        level = new
    return steps, np.array([1 / math.prod(math.factorial(x) for x in e) for e in exponents])


def _attend_by_moments(base: DataFrame, heads: int, project, matrix, size: int, degree: int, parts: int = 24) -> DataFrame:
    """exp(q.k) is the sum over monomials a of q**a k**a / a!: the sums of k**a (1, v) over all rows are all that a query needs."""
    steps, over = _monomials(size, degree)
    kind = dict(base.dtypes)["id"]

    def powers(x: np.ndarray) -> np.ndarray:
        out = np.ones((len(over), len(x)))
        at, x = 1, np.ascontiguousarray(x.T)
        for parents, by in steps:
            np.multiply(out[parents], x[by], out=out[at : at + len(by)])
            at += len(by)
        return out

    def pieces(n: int) -> Iterator[slice]:
        return (slice(at, at + 128) for at in range(0, n, 128))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            x = matrix(batch)
            k, v = project(x, "key"), project(x, "value")
            wide = v.shape[1] // heads
            sums = np.zeros((heads, len(over), wide + 1)) if sums is None else sums
            for part in pieces(len(x)):
                for h in range(heads):
                    one = np.column_stack([np.ones(len(x[part])), v[part, h * wide : (h + 1) * wide]])
                    sums[h] += powers(k[part, h * size : (h + 1) * size]) @ one
        if sums is not None:
            yield pa.RecordBatch.from_pydict({"head": pa.array(range(heads), pa.int32()), "m": pa.array([s.ravel().tolist() for s in sums], pa.list_(pa.float64()))})

    def add(t: pa.Table) -> pa.Table:
        m = t.column("m").combine_chunks().flatten().to_numpy().reshape(len(t), -1).sum(axis=0)
        return pa.table({"head": t.column("head").slice(0, 1), "m": pa.array([m.tolist()], pa.list_(pa.float64()))})

    # fewer, larger parts only where there are more: each sends on all moments
    n = base.sparkSession.sparkContext.defaultParallelism
    summed = base.repartition(max(parts, n)).mapInArrow(moments, "head int, m array<double>").groupBy("head").applyInArrow(add, "head int, m array<double>").orderBy("head").toArrow()
    sent = base.sparkSession.sparkContext.broadcast(summed.column("m").combine_chunks().flatten().to_numpy().reshape(heads, len(over), -1) * over[None, :, None])

    def attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        wide = m.shape[2] - 1
        for batch in batches:
            q = project(matrix(batch), "query") / math.sqrt(size)
            out = np.zeros((len(q), heads * wide))
            for part in pieces(len(q)):
                for h in range(heads):
                    s = powers(q[part, h * size : (h + 1) * size]).T @ m[h]
                    out[part, h * wide : (h + 1) * wide] = s[:, 1:] / s[:, :1]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, heads * wide, dtype=np.int32)), pa.array(out.ravel()))], names=["id", "attended"])

    return base.repartition(max(parts, n)).mapInArrow(attend, f"id {kind}, attended array<double>")


def _attend_by_blocks(base: DataFrame, n: int, heads: int, project, matrix, block_rows: int) -> DataFrame:
    blocks, others = block_count(n, block_rows), other_blocks(n, block_rows)
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    home = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    left = base.select("dim", home(blocks, 0).alias("a"), spread(others).alias("b"), "id", "v")
    right = base.select(F.col("dim").alias("dim"), spread(blocks).alias("a"), home(others, 1).alias("b"), F.col("id").alias("id"), F.col("v").alias("v"))
    kind = dict(base.dtypes)["id"]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(a) and len(b):
            q, k = matrix(a), matrix(b)
            q, k, v = project(q, "query"), project(k, "key"), project(k, "value")
            size, wide = q.shape[1] // heads, v.shape[1] // heads
            step = max(32, (1 << 22) // len(k))
            for h in range(heads):
                kh, vh = k[:, h * size : (h + 1) * size], v[:, h * wide : (h + 1) * wide]
                parts = []
                for at in range(0, len(q), step):
                    s = q[at : at + step, h * size : (h + 1) * size] @ kh.T / np.sqrt(size)
                    most = s.max(axis=1)
                    w = np.exp(s - most[:, None])
                    parts.append((most, w.sum(axis=1), w @ vh))
                out.append((h, *(np.concatenate(c) for c in zip(*parts))))
        ids = a.column("id").combine_chunks()
        return pa.table({
            "id": pa.concat_arrays([ids] * len(out)) if out else ids.slice(0, 0),
            "head": pa.array(np.repeat([o[0] for o in out], len(a)).astype(np.int32)),
            "most": pa.array(np.concatenate([np.zeros(0), *(o[1] for o in out)])),
            "total": pa.array(np.concatenate([np.zeros(0), *(o[2] for o in out)])),
            "attended": pa.array([row for o in out for row in o[3].tolist()], pa.list_(pa.float64())),
        })

    parts = meeting(left, right, ["dim", "a", "b"], blocks * others).applyInArrow(meet, f"id {kind}, head int, {_PARTIAL}")
    return merge_sums(parts, ["id", "head"]).groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("head", "attended"))), lambda x: x["attended"])).alias("attended"))


def attention_weights(edges: DataFrame, values: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(src, dst, weight): the softmax weights of graph_attention."""
    q = values.select(F.col(key).alias("src"), V.doubles(F.col(vector)).alias("q"))
    v = values.select(F.col(key).alias("dst"), V.doubles(F.col(vector)).alias("v"))
    scored = edges.select("src", "dst").distinct().join(q, "src").join(v, "dst").withColumn("_s", V.dot(F.col("q"), F.col("v")) / F.sqrt(F.size("q").cast("double")))
    return softmax_over(scored, "_s", ["src"], "weight").select("src", "dst", "weight")


def multi_head(values: DataFrame, heads: int = 8, mask: DataFrame | None = None, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(src, dst, head, weight): scaled dot-product attention of every row to every row, the vector cut into heads.

    mask: (src, dst) pairs that may not attend (their score is lowered by 1e9). Without learned projections.
    """
    v = V.doubles(F.col(vector))
    part = (F.size(v) / heads).cast("int")
    cut_ = values.select(F.col(key).alias("id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice(v, h * part + 1, part))).alias("head", "x"))
    pairs = cut_.select(F.col("id").alias("src"), "head", F.col("x").alias("q")).join(cut_.select(F.col("id").alias("dst"), "head", F.col("x").alias("k")), "head")
    pairs = pairs.withColumn("_s", V.dot(F.col("q"), F.col("k")) / F.sqrt(F.size("k").cast("double"))).drop("q", "k")
    if mask is not None:
        pairs = pairs.join(mask.select("src", "dst", F.lit(-1e9).alias("_m")).distinct(), ["src", "dst"], "left").withColumn("_s", F.col("_s") + F.coalesce("_m", F.lit(0.0))).drop("_m")
    return softmax_over(pairs, "_s", ["src", "head"], "weight").select("src", "dst", "head", "weight")


def layer_fusion(layers: dict[str, DataFrame], query: Column, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of all layers with layer, similarity to the query and score (similarity times the layer's weight), best first."""
    parts = [df.withColumn("layer", F.lit(name)).withColumn("similarity", V.cosine(F.col("embedding"), query)).withColumn("score", F.col("similarity") * F.lit((weights or {}).get(name, 1.0))) for name, df in layers.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.orderBy(F.desc("score"), "layer")


def fuse_layers(queries: DataFrame, layers: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, layer, id, similarity, score) of every query (query_id, embedding) to every row (id, embedding) of all layers, in no order.

    The same as layer_fusion for many queries: each layer is searched in blocks.
    """
    out = None
    for name, rows in layers.items():
        found = search(queries, rows, key="id").select("query_id", F.lit(name).alias("layer"), "id", "similarity", (F.col("similarity") * F.lit((weights or {}).get(name, 1.0))).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


def layer_distribution(results: DataFrame) -> DataFrame:
    """(layer, n) of the final rows."""
    return results.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def debug_report(scored: DataFrame, by: str = "query_id", key: str = "concept_id") -> DataFrame:
    """(query, concept, head, raw, normalized): one row for each head."""
    long = scored.select(by, key, F.expr("stack(3, 'semantic', semantic, 'structural', structural, 'temporal', temporal) as (head, raw)"))
    return normalise(long, "raw", [by, "head"], "normalized")


def validate_weights(weights: DataFrame, by: list[str], column: str = "weight", tolerance: float = 1e-6) -> DataFrame:
    """Sum, whether it is 1, least, greatest and range of the weights by group."""
    return weights.groupBy(*by).agg(F.sum(column).alias("sum"), F.min(column).alias("min"), F.max(column).alias("max")).withColumn("is_normalized", F.abs(F.col("sum") - 1) < tolerance).withColumn("range", F.col("max") - F.col("min"))
