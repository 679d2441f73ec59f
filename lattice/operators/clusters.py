"""Cluster statistics: centroids, uncertainty, exact quality measures, signatures. Input rows: (unit_id, embedding, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.functions import vectors as V
from lattice.operators import alike
from lattice.operators.similarity import distance_sums
from lattice.session import cut

EPS = 1e-8


def centroids(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, centroid): element-wise means."""
    return V.mean_vector(df, [label])


def sizes(df: DataFrame, least: int = 1, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)


def weighted_centroids(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, centroid): weights are cosines to the mean (with 1e-8), scaled to sum 1; they may be negative."""
    mean = centroids(df, label).withColumnRenamed("centroid", "mean")
    weighed = df.join(mean, label).withColumn("_a", V.cosine_padded(F.col("embedding"), F.col("mean"), EPS))
    total = weighed.groupBy(label).agg(F.sum("_a").alias("_t"))
    weighed = weighed.join(total, label).withColumn("w", F.col("_a") / (F.col("_t") + EPS))
    return V.weighted_mean_vector(weighed, [label], "w")


def uncertainty(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, uncertainty): the mean distance to the weighted centroid."""
    return df.join(weighted_centroids(df, label), label).groupBy(label).agg(F.avg(V.l2(F.col("embedding"), F.col("centroid"))).alias("uncertainty"))


def inertia(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: the sum of squared distances to the means."""
    return df.join(centroids(df, label), label).agg(F.coalesce(F.sum(V.squared_l2(F.col("embedding"), F.col("centroid"))), F.lit(0.0)).alias("inertia"))


def silhouette(df: DataFrame, label: str = "label", key: str = "unit_id") -> DataFrame:
    """One row: the exact Euclidean silhouette (0 for rows alone in their cluster, and unless 1 < clusters < rows).

    Distances of all pairs in blocks, summed by cluster there. For bounded inputs, as the measure itself is quadratic.
    """
    far = distance_sums(df, label, key).withColumn("d", F.col("total") / F.col("n"))
    two = far.groupBy("i", "li").agg(F.min(F.when(F.col("li") == F.col("lj"), F.col("d"))).alias("own"), F.min(F.when(F.col("li") != F.col("lj"), F.col("d"))).alias("other"))
    value = F.when(F.col("own").isNull() | F.col("other").isNull(), 0.0).otherwise((F.col("other") - F.col("own")) / F.nullif(F.greatest("own", "other"), F.lit(0.0)))
    return two.agg(F.coalesce(F.avg(F.coalesce(value, F.lit(0.0))), F.lit(0.0)).alias("silhouette"))


def calinski_harabasz(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: between-cluster over within-cluster dispersion, by their degrees of freedom; 0 where undefined."""
    own = centroids(df, label).join(sizes(df, label=label), label)
    whole = V.mean_vector(df.withColumn("_all", F.lit(1)), ["_all"], name="mean").drop("_all")
    between = own.crossJoin(whole).agg(F.sum(F.col("size") * V.squared_l2(F.col("centroid"), F.col("mean"))).alias("between"), F.count(F.lit(1)).alias("k"), F.sum("size").alias("n"))
    k, n = F.col("k"), F.col("n")
    value = (F.col("between") / F.nullif(k - 1, F.lit(0))) / F.nullif(F.col("inertia") / F.nullif(n - k, F.lit(0)), F.lit(0.0))
    return between.crossJoin(inertia(df, label)).select(F.coalesce(value, F.lit(0.0)).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: the mean over clusters of the greatest (s_i + s_j) / d_ij; infinite where centroids coincide."""
    means = centroids(df, label)
    s = df.join(means, label).groupBy(label).agg(F.avg(V.l2(F.col("embedding"), F.col("centroid"))).alias("s")).join(means, label)
    i = s.select(F.col(label).alias("i"), F.col("s").alias("si"), F.col("centroid").alias("ci"))
    j = s.select(F.col(label).alias("j"), F.col("s").alias("sj"), F.col("centroid").alias("cj"))
    d = V.l2(F.col("ci"), F.col("cj"))
    worst = i.join(j, F.col("i") != F.col("j")).select("i", F.when(d == 0, F.lit(float("inf"))).otherwise((F.col("si") + F.col("sj")) / F.when(d == 0, 1.0).otherwise(d)).alias("r")).groupBy("i").agg(F.max("r").alias("r"))
    return worst.agg(F.coalesce(F.avg("r"), F.lit(float("inf"))).alias("davies_bouldin"))


def quality(df: DataFrame, label: str = "label", key: str = "unit_id") -> DataFrame:
    """One row: silhouette, Calinski-Harabasz, Davies-Bouldin, inertia and the number of clusters."""
    k = df.agg(F.countDistinct(label).alias("n_clusters"))
    return silhouette(df, label, key).crossJoin(calinski_harabasz(df, label)).crossJoin(davies_bouldin(df, label)).crossJoin(inertia(df, label)).crossJoin(k)


def intra_similarity(df: DataFrame, label: str = "label", key: str = "unit_id") -> DataFrame:
    """(label, avg_similarity): the mean cosine over pairs; 1 for a single row.

    From the length of the sum of unit vectors, so no pair is formed: sum over i<j = (|S|^2 - n') / 2, n' the non-zero rows.
    """
    rows = df.select(label, V.unit(F.col("embedding")).alias("u"), (V.norm(F.col("embedding")) > 0).cast("int").alias("some"))
    count = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum("some").alias("m"))
    square = rows.select(label, F.posexplode("u").alias("p", "x")).groupBy(label, "p").agg(F.sum("x").alias("x")).groupBy(label).agg(F.sum(F.col("x") * F.col("x")).alias("q"))
    value = (F.col("q") - F.col("m")) / (F.col("n") * (F.col("n") - 1))
    return count.join(square, label).select(label, F.when(F.col("n") < 2, 1.0).otherwise(value).alias("avg_similarity"))


def norm_stats(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, mean_embedding_norm, std_embedding_norm, intra_cluster_similarity): the last is the mean of the whole cosine matrix, diagonal included."""
    rows = df.select(label, V.unit(F.col("embedding")).alias("u"), V.norm(F.col("embedding")).alias("norm"))
    stats = rows.groupBy(label).agg(F.avg("norm").alias("mean_embedding_norm"), F.stddev_pop("norm").alias("std_embedding_norm"), F.count(F.lit(1)).alias("n"))
    square = rows.select(label, F.posexplode("u").alias("p", "x")).groupBy(label, "p").agg(F.sum("x").alias("x")).groupBy(label).agg(F.sum(F.col("x") * F.col("x")).alias("q"))
    return stats.join(square, label).select(label, "mean_embedding_norm", "std_embedding_norm", (F.col("q") / (F.col("n") * F.col("n"))).alias("intra_cluster_similarity"))


def enhanced_signature(df: DataFrame, label: str = "label", key: str = "unit_id", threshold: float = 0.5) -> DataFrame:
    """One row a cluster: graphlets and degrees of its graph of cosines above threshold, walk constants, norm statistics."""
    d = cut(alike.degrees(df, threshold, key, by=label, strict=True)).select("g", F.col("links").cast("double").alias("d"))
    tri = alike.linked_pairs(df, threshold, key, by=label, strict=True).groupBy("g").agg(F.expr("sum(linked) div 6").alias("triangles"))
    stats = d.groupBy("g").agg(F.count(F.lit(1)).alias("nodes"), (F.sum("d") / 2).cast("bigint").alias("edges"), F.avg("d").alias("mean_degree"), F.stddev_pop("d").alias("std_degree"), F.max("d").cast("int").alias("max_degree"), F.min("d").cast("int").alias("min_degree"))
    n = F.col("nodes")
    out = stats.join(tri, "g", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    out = out.withColumn("avg_transition_prob", F.when(n > 1, 0.5).otherwise(1.0)).withColumn("stationary_distribution_entropy", F.least(F.log(n.cast("double")), F.lit(1.0)))
    norms = norm_stats(df, label).withColumnRenamed(label, "g")
    return out.join(norms, "g").withColumnRenamed("g", label)


def pattern_similarity(a: Column, b: Column) -> Column:
    """The similarity of two signatures (structs with the optional fields graphlets, random_walks, degree_stats: structs, semantic_centroids: map).

    Weights .3, .2, .2 and .3, over the features that both have; 0 if there is none. Fields missing on either side are not compared.
    """
    return combine_features([(0.3, graphlet_similarity(a["graphlets"], b["graphlets"])), (0.2, walk_similarity(a["random_walks"], b["random_walks"])), (0.2, degree_similarity(a["degree_stats"], b["degree_stats"])), (0.3, centroid_similarity(a["semantic_centroids"], b["semantic_centroids"]))])


def combine_features(parts: list[tuple[float, Column]]) -> Column:
    zero = F.lit(0.0)
    top = sum((F.coalesce(F.lit(w) * s, zero) for w, s in parts), zero)
    weight = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(zero) for w, s in parts), zero)
    return F.when(weight > 0, top / F.when(weight > 0, weight).otherwise(1.0)).otherwise(0.0)


def graphlet_similarity(a: Column, b: Column, keys: tuple[str, ...] = ("triangle", "wedge", "triplet", "edges", "nodes")) -> Column:
    """Sum of minima over sum of maxima of the shared counts; 0 for an empty sum, null if a side is null."""
    low = sum((F.coalesce(F.least(a[k] * 1.0, b[k] * 1.0), F.lit(0.0)) for k in keys), F.lit(0.0))
    high = sum((F.coalesce(F.greatest(a[k] * 1.0, b[k] * 1.0), F.lit(0.0)) for k in keys), F.lit(0.0))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(high > 0, low / F.when(high > 0, high).otherwise(1.0)).otherwise(0.0))


def walk_similarity(a: Column, b: Column) -> Column:
    n, m = (F.coalesce(x["num_unique_patterns"], F.lit(0)) * 1.0 for x in (a, b))
    most = F.greatest(n, m)
    ratio = F.when(most == 0, 1.0).otherwise(F.least(n, m) / F.when(most == 0, 1.0).otherwise(most))
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.coalesce(a["avg_transition_prob"], F.lit(0.0)) - F.coalesce(b["avg_transition_prob"], F.lit(0.0))))
    return F.when(a.isNotNull() & b.isNotNull(), 0.5 * ratio + 0.5 * near)


def degree_similarity(a: Column, b: Column) -> Column:
    def near(k: str) -> Column:
        return 1 - F.abs(a[k] - b[k]) / F.greatest(a[k], b[k], F.lit(1.0))

    return F.when(a.isNotNull() & b.isNotNull(), 0.6 * near("mean_degree") + 0.4 * near("std_degree"))


def centroid_similarity(a: Column, b: Column) -> Column:
    """The mean cosine over shared ids of non-zero centroids; no shared id 0, both empty 1, one empty 0; null if a side is null."""
    shared = F.filter(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda k: (V.norm(F.element_at(a, k)) > 0) & (V.norm(F.element_at(b, k)) > 0))
    mean = F.aggregate(F.transform(shared, lambda k: V.cosine(F.element_at(a, k), F.element_at(b, k))), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(shared), F.lit(0))
    return F.when(a.isNotNull() & b.isNotNull(), F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.coalesce(mean, F.lit(0.0))))


def target_k(n: Column) -> Column:
    """The number of clusters that the adaptive clusterer aims at."""
    n = n.cast("int")
    third, tenth = F.floor(n / 3).cast("int"), F.floor(n / 10).cast("int")
    return F.when(n < 10, F.greatest(F.lit(1), F.least(n, F.lit(2)))).when(n < 50, F.greatest(F.lit(2), F.least(third, F.lit(5)))).otherwise(F.greatest(F.lit(2), F.least(tenth, F.lit(50)))).cast("int")
