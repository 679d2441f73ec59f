"""Vector arithmetic as column expressions over array<double>. For one-to-many scoring; all-pairs work uses blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0
MONTH_SECONDS = 2_592_000


def bind(value: Column, f) -> Column:
    """f(value) with value computed once: a lambda's body is run for each element, and with it whatever it mentions."""
    return F.transform(F.array(value), f)[0]


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where the dimensions differ."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(ZERO), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(ZERO), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a norm is 0."""
    product = norm(a) * norm(b)
    return F.coalesce(dot(a, b) / F.nullif(product, F.lit(ZERO)), F.when(product == 0, F.lit(ZERO)))


def cosine_padded(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """dot / (|a||b| + eps), the form of the retrieval stages."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def cosine_floored(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Each norm at least eps, the form of the semantic head."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(ZERO), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def from_distance(d: Column) -> Column:
    """A similarity in (0, 1] from a distance: 1 / (1 + d)."""
    return F.lit(1.0) / (F.lit(1.0) + d)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """metric: cosine (raw), inverse_l2, inverse_squared_l2, inverse_cosine or inner."""
    kinds = {
        "cosine": lambda: cosine(a, b),
        "inverse_l2": lambda: from_distance(l2(a, b)),
        "inverse_squared_l2": lambda: from_distance(squared_l2(a, b)),
        "inverse_cosine": lambda: from_distance(cosine_distance(a, b)),
        "inner": lambda: dot(a, b),
    }
    return kinds[metric]()


def combined_similarity(a: Column, b: Column) -> Column:
    """0.7 cosine + 0.3 / (1 + Euclidean distance)."""
    return 0.7 * cosine(a, b) + 0.3 * from_distance(l2(a, b))


def scale(a: Column, by: Column) -> Column:
    return F.transform(doubles(a), lambda x: x * by)


def unit(a: Column) -> Column:
    """The vector over its norm; a zero vector stays."""

    def scaled(v: Column) -> Column:
        return F.zip_with(v, F.array_repeat(F.coalesce(F.nullif(norm(v), F.lit(ZERO)), F.lit(1.0)), F.size(v)), lambda x, n: x / n)

    return bind(doubles(a), scaled)


def variance(a: Column) -> Column:
    """Population variance of the entries."""
    v = doubles(a)
    mean = F.aggregate(v, F.lit(ZERO), lambda s, x: s + x) / F.size(v)
    return bind(mean, lambda m: F.aggregate(v, F.lit(ZERO), lambda s, x: s + (x - m) * (x - m)) / F.size(v))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def time_decay(seconds: Column) -> Column:
    """exp(-|seconds| / 30 days)."""
    return F.exp(-F.abs(seconds) / F.lit(float(MONTH_SECONDS)))


def mean_vector(df, keys: list[str], vector: str = "embedding", name: str = "centroid"):
    """Element-wise mean by keys: one exploded aggregation with partial sums, then an ordered collect of dim values."""
    parts = df.select(*keys, F.posexplode(doubles(F.col(vector))).alias("_pos", "_x")).groupBy(*keys, "_pos").agg(F.avg("_x").alias("_x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda s: s["_x"]).alias(name))


def weighted_mean_vector(df, keys: list[str], weight: str, vector: str = "embedding", name: str = "centroid"):
    """Sum of weight times vector over the sum of weights."""
    parts = df.select(*keys, F.col(weight).alias("_w"), F.posexplode(doubles(F.col(vector))).alias("_pos", "_x")).groupBy(*keys, "_pos").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda s: s["_x"]).alias(name))
