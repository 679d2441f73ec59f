"""Graph analytics over edge lists (graph columns optional): never an N x N matrix.

Edges are (src, dst, weight); vertices are (id). Iterations cut their lineage with a reliable checkpoint every few
rounds, and each round is a join on the vertex and an aggregation with map-side partial sums.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattice.functions import vectors as V
from lattice.operators.adjacency import common_targets
from lattice.operators.components import connected_components
from lattice.session import cut

CUT_EVERY = 5
HELD = 8_000_000  # entries of a matrix that is sent to tasks: 192 MB


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def sum_duplicates(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def composite_weights(relations: DataFrame, semantic: float = 0.5, temporal: float = 0.3, causal: float = 0.2, reverse: float = 0.1) -> DataFrame:
    """Edges weighed from three weights (null counts as 0); a reverse edge of a tenth; the greater of duplicates."""
    zero = F.lit(0.0)
    total = semantic + temporal + causal
    w = (semantic * F.coalesce("semantic_similarity", zero) + temporal * F.coalesce("temporal_proximity", zero) + causal * F.coalesce("causal_weight", zero)) / total
    one = relations.select("src", "dst", w.alias("weight"))
    back = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * reverse).alias("weight"))
    return one.unionByName(back).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def spread_activation(edges: DataFrame, seeds: DataFrame, rounds: int = 3, decay: float = 0.5, high: float = 2.0, keep: float = 0.01) -> DataFrame:
    """(id, activation): a <- clip(a + decay * A'a, 0, high), then those above keep. Seeds outside the graph are dropped; an empty graph gives the seeds."""
    if edges.isEmpty():
        return seeds.select("id", F.col("activation").cast("double").alias("activation"))
    base = vertices_of(edges).join(seeds.groupBy("id").agg(F.max(F.col("activation").cast("double")).alias("activation")), "id", "left").select("id", F.coalesce("activation", F.lit(0.0)).alias("activation"))
    for i in range(rounds):
        inflow = edges.join(base.where("activation <> 0"), edges["src"] == base["id"]).groupBy(edges["dst"].alias("id")).agg(F.sum(F.col("weight") * F.col("activation")).alias("inflow"))
        base = base.join(inflow, "id", "left").select("id", V.clip(F.col("activation") + decay * F.coalesce("inflow", F.lit(0.0)), 0.0, high).alias("activation"))
        if i % CUT_EVERY == CUT_EVERY - 1 and i + 1 < rounds:
            base = cut(base)
    return base.where(F.col("activation") > keep)


def neighbours(edges: DataFrame, node: Column, limit: int = 100) -> DataFrame:
    return sum_duplicates(edges).where(F.col("src") == node).select(F.col("dst").alias("id"), "weight").orderBy(F.desc("weight"), "id").limit(limit)


def top_neighbours(edges: DataFrame, limit: int = 100) -> DataFrame:
    """(src, dst, weight, rank): the neighbours of every vertex, heaviest first."""
    w = Window.partitionBy("src").orderBy(F.desc(F.round("weight", 12)), "dst")
    return sum_duplicates(edges).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def pagerank(edges: DataFrame, vertices: DataFrame | None = None, damping: float = 0.85, iterations: int = 10, tolerance: float | None = None, dangling: bool = False) -> DataFrame:
    """(id, rank): rank <- (1-d)/n + d * P'rank from 1/n. Mass of vertices without out-edges leaks unless dangling.

    With a tolerance, it stops once the L1 change falls below it and returns the ranks before that last step.
    """
    ids = cut(vertices_of(edges) if vertices is None else vertices.select("id").distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    summed = sum_duplicates(edges)
    steps = cut(summed.withColumn("p", F.col("weight") / F.nullif(F.sum("weight").over(Window.partitionBy("src")), F.lit(0.0))).select("src", "dst", "p"))
    ranks = ids.withColumn("rank", F.lit(1.0 / n))
    ends = steps.select(F.col("src").alias("id")).distinct()
    for i in range(iterations):
        flow = steps.join(ranks, steps["src"] == ranks["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("rank")).alias("flow"))
        leak = F.lit(0.0)
        if dangling:
            leak = F.lit(ranks.join(ends, "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0] / n)
        new = ids.join(flow, "id", "left").select("id", (F.lit((1 - damping) / n) + damping * (F.coalesce("flow", F.lit(0.0)) + leak)).alias("rank"))
        if tolerance is None:
            ranks = cut(new) if i % CUT_EVERY == CUT_EVERY - 1 else new
            continue
        both = cut(new.join(ranks.withColumnRenamed("rank", "old"), "id"))
        if both.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0))).first()[0] < tolerance:
            return both.select("id", F.col("old").alias("rank"))
        ranks = both.select("id", "rank")
    return ranks


def degrees(edges: DataFrame, vertices: DataFrame | None = None, by: str = "src") -> DataFrame:
    """(id, degree): weighted sums by source (or target); vertices without edges get 0."""
    ids = vertices_of(edges) if vertices is None else vertices.select("id").distinct()
    sums = edges.groupBy(F.col(by).alias("id")).agg(F.sum("weight").alias("degree"))
    return ids.join(sums, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).cast("double").alias("degree"))


def degree_stats(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """One row: mean, population std, max and min (truncated to int) of the weighted degree."""
    zero = F.lit(0.0)
    return degrees(edges, vertices).agg(F.coalesce(F.avg("degree"), zero).alias("mean_degree"), F.coalesce(F.stddev_pop("degree"), zero).alias("std_degree"), F.coalesce(F.max("degree"), zero).cast("int").alias("max_degree"), F.coalesce(F.min("degree"), zero).cast("int").alias("min_degree"))


def degree_distribution(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    return degrees(edges, vertices).groupBy(F.col("degree").cast("int").alias("degree")).agg(F.count(F.lit(1)).alias("n"))


def density(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: stored entries over n(n-1); 0 for n <= 1."""
    m = edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("entries"))
    n = vertices.agg(F.countDistinct("id").alias("n"))
    return m.crossJoin(n).select(F.when(F.col("n") > 1, F.col("entries") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"))


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected pairs a < b, once each."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c. Each pair is kept at its end of lesser degree, so a hub opens no more wedges than its neighbours."""
    pairs = canonical(edges)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    rank = pairs.join(degree.withColumnsRenamed({"id": "a", "d": "da"}), "a").join(degree.withColumnsRenamed({"id": "b", "d": "db"}), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    led = rank.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedges = led.join(led.withColumnRenamed("v", "w"), "u").where("v < w")
    closed = wedges.join(pairs, (wedges["v"] == pairs["a"]) & (wedges["w"] == pairs["b"]))
    return closed.select(F.array_sort(F.array("u", "v", "w")).alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def graphlets(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: triangles, induced wedges, the other triples, edges and nodes; fewer than 3 vertices give no triples."""
    pairs = canonical(edges)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count()
    open_ = ends.agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0)).alias("paths"))
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    corners = common_targets(both).agg(F.expr("coalesce(sum(linked), 0) div 6").alias("triangle"))
    row = corners.crossJoin(open_).crossJoin(pairs.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(vertices.agg(F.countDistinct("id").alias("nodes")))
    wedge = F.col("paths") - 3 * F.col("triangle")
    triples = F.expr("nodes * (nodes - 1) * (nodes - 2) div 6")
    return row.select("triangle", wedge.alias("wedge"), F.greatest(F.lit(0), triples - F.col("triangle") - wedge).cast("bigint").alias("triplet"), "edges", "nodes")


def random_walk_stats(edges: DataFrame, vertices: DataFrame, length: int = 5, held: int = HELD) -> DataFrame:
    """One row: the mean diagonal of P**length (return probability) and the population std of its column sums (path diversity).

    Column sums take one vector product a step; the diagonal comes from the halves of the power, for blocks of vertices that
    hold P. Where P has more than `held` entries it is not sent to tasks: the same halves are then joined.
    """
    summed = sum_duplicates(edges)
    p = cut(summed.withColumn("p", F.col("weight") / F.nullif(F.sum("weight").over(Window.partitionBy("src")), F.lit(0.0))).where("p is not null").select("src", "dst", "p"))
    ids = vertices.select("id").distinct()
    home = _home_by_blocks(p, length) if p.count() <= held else _home_by_joins(p, length)
    sums = p.groupBy(F.col("dst").alias("id")).agg(F.sum("p").alias("s"))
    for _ in range(length - 1):
        sums = p.join(sums, p["src"] == sums["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("s")).alias("s"))
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    spread = ids.join(sums, "id", "left").agg(F.coalesce(F.stddev_pop(F.coalesce("s", F.lit(0.0))), F.lit(0.0)).alias("path_diversity"))
    return home.crossJoin(n).crossJoin(spread).select(F.coalesce(F.col("home") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)).alias("return_probability"), "path_diversity")


def _home_by_blocks(p: DataFrame, length: int, columns: int = 64, products: int = 1 << 21) -> DataFrame:
    """One row, home: the trace of P**length; each task takes blocks of vertices through P and through its transpose."""
    spark, half = p.sparkSession, length // 2
    table = p.toArrow()
    src, dst, w = (table.column(c).to_numpy() for c in ("src", "dst", "p"))
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n, src, dst = len(ids), at[: len(w)], at[len(w) :]

    def rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(a, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]), b[order].astype(np.int32), w[order]

    sent = spark.sparkContext.broadcast((rows(src, dst), rows(dst, src)))

    def times(m: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        first, to, weight = m
        out, low = np.zeros(x.shape), 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(first, first[low] + products // columns, "right")) - 1)
            some = low + np.flatnonzero(np.diff(first[low : high + 1]))
            if len(some):
                part = slice(first[low], first[high])
                out[some] = np.add.reduceat(weight[part, None] * x[to[part]], first[some] - first[low], axis=0)
            low = high
        return out

    def trace(parts):
        on, back = sent.value
        for part in parts:
            for start in (part["id"] * columns).tolist():
                wide = min(columns, n - start)
                x = np.zeros((n, wide))
                x[start + np.arange(wide), np.arange(wide)] = 1
                y = x
                for _ in range(half):
                    x = times(on, x)
                for _ in range(length - half):
                    y = times(back, y)
                yield pd.DataFrame({"home": [float((x * y).sum())]})

    blocks = -(-n // columns)
    found = spark.range(0, blocks, 1, max(1, min(blocks, 96))).mapInPandas(trace, "home double")
    return found.agg(F.coalesce(F.sum("home"), F.lit(0.0)).alias("home"))


def _home_by_joins(p: DataFrame, length: int) -> DataFrame:
    power, half = p, p if length // 2 == 1 else None
    for i in range(2, length - length // 2 + 1):
        step = power.alias("l").join(p.alias("r"), F.col("l.dst") == F.col("r.src")).groupBy(F.col("l.src").alias("src"), F.col("r.dst").alias("dst")).agg(F.sum(F.col("l.p") * F.col("r.p")).alias("p"))
        power = cut(step)
        half = power if i == length // 2 else half
    if half is None:
        return power.where("src = dst").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("home"))
    back = half.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("p").alias("q"))
    return power.join(back, ["src", "dst"]).agg(F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0.0)).alias("home"))


def numbered_neighbours(edges: DataFrame, cells: int = 64) -> DataFrame:
    """(src, dst, i): the distinct targets of positive weight of each source, numbered from 0; a hub is numbered in cells."""
    e = edges.where("weight > 0").select("src", "dst").distinct().withColumn("cell", F.pmod(F.xxhash64("dst"), F.lit(cells)))
    sizes = e.groupBy("src", "cell").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("src", "cell", (F.sum("size").over(Window.partitionBy("src").orderBy("cell")) - F.col("size")).alias("before"))
    inside = e.withColumn("inside", F.row_number().over(Window.partitionBy("src", "cell").orderBy("dst")) - 1)
    return inside.join(before, ["src", "cell"]).select("src", "dst", (F.col("before") + F.col("inside")).alias("i"))


def simulated_walks(edges: DataFrame, vertices: DataFrame, walks: int = 100, length: int = 5, seed: int = 42) -> DataFrame:
    """One row: the share of walks that return to their start and of distinct paths, of `walks` seeded walks from every vertex.

    A step goes to any neighbour of positive weight alike; a vertex without one ends the walk. Each step is one join by
    vertex and number of the neighbour, so walks that meet in a hub spread over its neighbours.
    """
    steps = numbered_neighbours(edges)
    degree = steps.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    steps = cut(steps.join(degree.withColumnsRenamed({"src": "dst", "degree": "onward"}), "dst", "left").select("src", "i", "dst", F.coalesce("onward", F.lit(0)).alias("onward")))
    starts = vertices.select("id").distinct().join(degree, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    paths = starts.select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), F.col("id").alias("at"), "degree", F.array("id").alias("path"))
    for step in range(length):
        number = F.when(F.col("degree") > 0, F.pmod(F.xxhash64("start", "walk", F.lit(step), F.lit(seed)), F.col("degree")))
        drawn = paths.withColumn("n", number).join(steps, (F.col("at") == F.col("src")) & (F.col("n") == F.col("i")), "left")
        on = F.col("dst").isNotNull()
        paths = drawn.select("start", "walk", F.coalesce("dst", "at").alias("at"), F.coalesce("onward", F.lit(0)).alias("degree"), F.when(on, F.concat("path", F.array("dst"))).otherwise(F.col("path")).alias("path"))
    one = F.lit(1)
    back = F.sum(((F.size("path") > 1) & (F.col("at") == F.col("start"))).cast("int"))
    return paths.agg(F.coalesce(back / F.nullif(F.count(one), F.lit(0)), F.lit(0.0)).alias("return_probability"), F.coalesce(F.countDistinct("path") / F.nullif(F.count(one), F.lit(0)), F.lit(0.0)).alias("path_diversity"))


def local_density(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, local_density): linked ordered pairs of out-neighbours over all such pairs; 0 for fewer than 2."""
    linked = common_targets(edges)
    k = edges.where("src <> dst").groupBy("src").agg(F.countDistinct("dst").alias("k"))
    joined = vertices.select("id").distinct().join(k, F.col("id") == k["src"], "left").drop("src").join(linked, F.col("id") == linked["src"], "left").drop("src")
    return joined.select("id", F.when(F.col("k") >= 2, F.coalesce("linked", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("local_density"))


def mean_positive(local: DataFrame) -> DataFrame:
    """One row: the mean local density over the vertices where it is positive; 0 for fewer than 3 vertices."""
    return local.agg(F.when(F.count(F.lit(1)) < 3, 0.0).otherwise(F.coalesce(F.avg(F.when(F.col("local_density") > 0, F.col("local_density"))), F.lit(0.0))).alias("clustering_coefficient"))


def mean_doubled(local: DataFrame) -> DataFrame:
    """One row: twice the mean local density over all vertices (0 to 2)."""
    return local.agg(F.coalesce(F.avg(2 * F.col("local_density")), F.lit(0.0)).alias("clustering_coefficient"))


def clustering_coefficient(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return mean_positive(local_density(edges, vertices))


def doubled_clustering_coefficient(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return mean_doubled(local_density(edges, vertices))


def degree_mixing(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: (sum of d_i d_j over edges / total weight - E[d]**2) / (E[d**2] - E[d]**2), d by target; 0 where undefined."""
    d = degrees(edges, vertices, by="dst")
    e = edges.join(d.withColumnsRenamed({"id": "src", "degree": "di"}), "src").join(d.withColumnsRenamed({"id": "dst", "degree": "dj"}), "dst")
    top = e.agg(F.sum(F.col("di") * F.col("dj")).alias("s"), F.sum("weight").alias("w"))
    mean = d.agg(F.avg("degree").alias("m"), F.avg(F.col("degree") * F.col("degree")).alias("m2"))
    spread = F.col("m2") - F.col("m") * F.col("m")
    return top.crossJoin(mean).select(F.coalesce((F.col("s") / F.nullif(F.col("w"), F.lit(0.0)) - F.col("m") * F.col("m")) / F.nullif(spread, F.lit(0.0)), F.lit(0.0)).alias("degree_mixing"))


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component): the least id of each weakly connected component; vertices without edges are their own."""
    found = connected_components(edges)
    return vertices.select("id").distinct().join(found, F.col("id") == found["vertex"], "left").select("id", F.coalesce("component", "id").alias("component"))


def bfs(edges: DataFrame, sources: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(source, id, distance) of every vertex reachable along edges; frontiers grow level by level for all sources together."""
    hops = edges.where("src <> dst").select("src", "dst").distinct()
    seen = cut(sources.select(F.col("id").alias("source"), "id").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(hops, frontier["id"] == hops["src"]).select("source", F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen, ["source", "id"], "left_anti").withColumn("distance", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % CUT_EVERY == 0:
            seen = cut(seen)
    return seen


def diameter(edges: DataFrame, vertices: DataFrame, sources: int = 512) -> DataFrame:
    """One row: the greatest finite distance from any vertex, exact at every size; so many sources at a time. No vertex: inf. One: 0. No vertex reaches another: inf."""
    ids = cut(vertices.select("id").distinct())
    n = ids.count()
    most = 0
    if n > 1:
        hops = cut(edges.where("src <> dst").select("src", "dst").distinct()).withColumn("weight", F.lit(1.0))
        rounds = -(-n // sources)
        for at in range(rounds):
            most = max(most, bfs(hops, ids.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == at), max_depth=n).agg(F.max("distance")).first()[0] or 0)
    return edges.sparkSession.range(1).select(F.lit(float(most) if most or n == 1 else math.inf).alias("diameter"))


def spectral(edges: DataFrame, vertices: DataFrame, exact_up_to: int = 1000, iterations: int = 100) -> DataFrame:
    """One row: spectral_radius and spectral_gap.

    Up to exact_up_to vertices: eigenvalues of one dense matrix in one task, largest absolute real parts. Beyond: power
    iteration by joins; the gap is then null.
    """
    ids = vertices.select("id").distinct()
    n = ids.count()
    if n <= exact_up_to:
        numbered = ids.withColumn("at", F.row_number().over(Window.orderBy("id")) - 1)
        placed = edges.join(numbered.withColumnsRenamed({"id": "src", "at": "i"}), "src").join(numbered.withColumnsRenamed({"id": "dst", "at": "j"}), "dst").select("i", "j", "weight")

        def eigen(parts):
            m = np.zeros((n, n))
            for part in parts:
                np.add.at(m, (part["i"].to_numpy(), part["j"].to_numpy()), part["weight"].to_numpy())
            top = np.sort(np.abs(np.linalg.eigvals(m).real))[::-1] if n else np.zeros(0)
            yield pd.DataFrame({"spectral_radius": [float(top[0]) if n else 0.0], "spectral_gap": [float(top[0] - top[1]) if n > 1 else 0.0]})

        return placed.repartition(1).mapInPandas(eigen, "spectral_radius double, spectral_gap double")
    summed = cut(sum_duplicates(edges))
    x, length = ids.withColumn("x", F.lit(1.0 / math.sqrt(n))), 0.0
    size = F.sqrt(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)))
    for i in range(iterations):
        y = summed.join(x, summed["dst"] == x["id"]).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
        if i % CUT_EVERY < CUT_EVERY - 1 and i + 1 < iterations:
            x = y  # lengths are taken, and vectors scaled, once every few products
            continue
        x, y = cut(x), cut(y)
        before, own, length = length, x.agg(size).first()[0], y.agg(size).first()[0]
        if not own or not length:
            length = 0.0
            break
        length /= own
        if abs(length - before) < 1e-10:
            break
        x = y.select("id", (F.col("x") / (length * own)).alias("x"))
    return edges.sparkSession.range(1).select(F.lit(length).alias("spectral_radius"), F.lit(None).cast("double").alias("spectral_gap"))


def adaptive_k(density_: Column, coefficient: Column, n: Column, base: int = 20, low: int = 5, high: int = 100) -> Column:
    """The number of neighbours suited to a graph's density, clustering and size."""
    raw = (base * (1 + (density_ - 0.5) * 0.5) * (1 - 0.3 * coefficient) * (F.least(F.lit(1.0), 20.0 / F.greatest(n, F.lit(1))) * 5)).cast("int")
    most = F.when(n > 1, (n - 1).cast("int")).otherwise(F.lit(low))
    return F.when(n == 0, F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), raw, most)))


def k_candidates(density_: float, coefficient: float, n: int, fewest: int = 5, most: int = 50) -> list[int]:
    """Candidate neighbour counts from fixed values and from density, clustering and size; thinned or filled to fewest..most."""
    if n <= 1:
        return [1]
    by_density = math.floor(10 * (1 - density_)) if density_ < 0.1 else math.floor(30 * density_) if density_ > 0.5 else 15
    by_clustering = math.floor(15 * (1 - coefficient)) if coefficient > 0.5 else math.floor(20 * (1 + coefficient))
    by_size = [math.floor(10 * math.log(n))] if n > 1000 else [math.floor(2 * math.sqrt(n))] if n > 100 else []
    out = sorted({max(1, min(k, n - 1)) for k in [5, 10, 20, 50, by_density, by_clustering, *by_size]})
    while len(out) < fewest:
        middles = [(a + b) // 2 for a, b in zip(out, out[1:]) if b - a > 1]
        if not middles:
            break  # a tiny graph has no more
        out = sorted({*out, *middles})
    return out if len(out) <= most else [out[round(i * (len(out) - 1) / (most - 1))] for i in range(most)]


def export(units: DataFrame, members: DataFrame, relations: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """(kind, source, target, weight): nodes (unit, concept; target null), typed edges and memberships of a graph, in one table.

    relations: (src, dst, type, weight). positions: (unit_id, x, y, z), which are then added to the units.
    """
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def part(df: DataFrame, kind, source, target=text, weight=number, place=(number,) * 3) -> DataFrame:
        where = [p.alias(a) for a, p in zip("xyz", place)] if positions is not None else []
        return df.select(kind.alias("kind"), source.cast("string").alias("source"), target.cast("string").alias("target"), weight.cast("double").alias("weight"), *where)

    placed = units if positions is None else units.join(positions, "unit_id", "left")
    place = (number,) * 3 if positions is None else tuple(F.col(a) for a in "xyz")
    return (
        part(placed, F.lit("unit"), F.col("unit_id"), place=place)
        .unionByName(part(members.select("concept_id").distinct(), F.lit("concept"), F.col("concept_id")))
        .unionByName(part(relations, F.col("type"), F.col("src"), F.col("dst"), F.col("weight")))
        .unionByName(part(members, F.lit("member"), F.col("concept_id"), F.col("unit_id")))
    )


def counts(units: DataFrame, members: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: units, concepts, edges."""
    one = F.lit(1)
    return units.agg(F.count(one).alias("units")).crossJoin(members.agg(F.countDistinct("concept_id").alias("concepts"))).crossJoin(relations.agg(F.count(one).alias("edges")))


def properties(edges: DataFrame, vertices: DataFrame, extremes: bool = True) -> DataFrame:
    """One row of graph properties: size, density, degrees, clustering, mixing, components and, as extremes, diameter and spectrum."""
    ids = vertices.select("id").distinct()
    parts = [
        ids.agg(F.count(F.lit(1)).alias("num_nodes")), edges.agg(F.count(F.lit(1)).alias("num_edges")), density(edges, ids), degree_stats(edges, ids), doubled_clustering_coefficient(edges, ids),
        degree_mixing(edges, ids), components(edges, ids).agg(F.countDistinct("component").alias("num_connected_components")),
        *([diameter(edges, ids), spectral(edges, ids)] if extremes else []),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)
    return row


COMPARED = ("density", "mean_degree", "clustering_coefficient", "num_connected_components")


def validate_approximation(original: DataFrame, sparse: DataFrame, tolerance: float = 0.1, least_kept: float = 0.1) -> DataFrame:
    """(property, original, approximated, difference, passed) from two one-row property tables, and a row for the edges kept."""
    pick = lambda df, side: df.select(F.expr(f"stack({len(COMPARED)}, " + ", ".join(f"'{p}', cast({p} as double)" for p in COMPARED) + f") as (property, {side})"))
    both = pick(original, "original").join(pick(sparse, "approximated"), "property")
    o, s = F.col("original"), F.col("approximated")
    gap = F.when(o != 0, F.abs(o - s) / F.abs(o)).otherwise(F.abs(o - s))
    rows = both.select("property", "original", "approximated", gap.alias("difference"), (gap <= tolerance).alias("passed"))
    kept = original.select(F.col("num_edges").cast("double").alias("original")).crossJoin(sparse.select(F.col("num_edges").cast("double").alias("approximated")))
    ratio = F.coalesce(F.col("approximated") / F.nullif(F.col("original"), F.lit(0.0)), F.lit(1.0))
    return rows.unionByName(kept.select(F.lit("edges_kept").alias("property"), "original", "approximated", (1 - ratio).alias("difference"), (ratio >= least_kept).alias("passed")))


def approximation_quality(original: DataFrame, sparse: DataFrame, vertices: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """One row: Frobenius error, its share of the original's norm, and the share of the n**2 entries that are close."""
    a = sum_duplicates(original).withColumnRenamed("weight", "a")
    b = sum_duplicates(sparse).withColumnRenamed("weight", "b")
    both = a.join(b, ["src", "dst"], "full").select(F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    gap = F.col("a") - F.col("b")
    far = F.abs(gap) > atol + rtol * F.abs("b")
    sums = both.agg(F.sum(gap * gap).alias("e"), F.sum(F.col("a") * F.col("a")).alias("t"), F.sum(far.cast("int")).alias("far"))
    n = vertices.agg(F.countDistinct("id").alias("n"))
    e, t = F.sqrt(F.coalesce("e", F.lit(0.0))), F.sqrt(F.coalesce("t", F.lit(0.0)))
    return sums.crossJoin(n).select(e.alias("frobenius_error"), F.coalesce(e / F.nullif(t, F.lit(0.0)), F.lit(0.0)).alias("relative_error"), F.coalesce(1 - F.coalesce("far", F.lit(0)) / F.nullif(F.col("n") * F.col("n"), F.lit(0)), F.lit(1.0)).alias("element_accuracy"))


def rank_ratio(original: DataFrame, sparse: DataFrame, vertices: DataFrame, most: int | None = None) -> DataFrame:
    """One row: the rank of the approximation over the rank of the original, each of one dense matrix in a task of its own.

    Ranks are exact: a task holds vertices x vertices. With `most`, graphs of more vertices raise an error.
    """
    n = vertices.select("id").distinct().count()
    if most is not None and n > most:
        raise ValueError(f"ranks are exact and dense: {n} vertices are more than {most}")
    ids = vertices.select("id").distinct().withColumn("at", F.row_number().over(Window.orderBy("id")) - 1)

    def rank(e: DataFrame, name: str) -> DataFrame:
        placed = e.join(ids.withColumnsRenamed({"id": "src", "at": "i"}), "src").join(ids.withColumnsRenamed({"id": "dst", "at": "j"}), "dst").select("i", "j", "weight")

        def run(parts):
            m = np.zeros((n, n))
            for part in parts:
                np.add.at(m, (part["i"].to_numpy(), part["j"].to_numpy()), part["weight"].to_numpy())
            alike = all(np.array_equal(m[at : at + 512], m[:, at : at + 512].T) for at in range(0, n, 512))
            yield pd.DataFrame({name: [int(np.linalg.matrix_rank(m, hermitian=alike)) if n else 0]})

        return placed.repartition(1).mapInPandas(run, f"{name} bigint")

    both = rank(original, "a").crossJoin(rank(sparse, "b"))
    return both.select(F.when(F.col("a") > 0, F.col("b") / F.nullif(F.col("a"), F.lit(0))).otherwise(1.0).alias("rank_ratio"))


def edge_types(relations: DataFrame) -> DataFrame:
    """(src, dst, type, weight): the greatest of semantic, causal and temporal weights, in that priority, rounded to 3 places."""
    zero = F.lit(0.0)
    s, c, t = (F.coalesce(x, zero) for x in ("semantic_similarity", "causal_weight", "temporal_proximity"))
    kind = F.when((c > s) & ~(t > c), "causal").when((t > s) & (t > c), "temporal").otherwise("semantic")
    return relations.select("src", "dst", kind.alias("type"), F.round(F.greatest(s, c, t), 3).alias("weight"))
