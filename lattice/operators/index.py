"""A vector index over a DataFrame, result paging, and batch processing with errors as nulls."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.functions import vectors as V
from lattice.operators import attention, clustering, similarity
from lattice.session import cut


class VectorIndex:
    """Exact search over (unit_id, embedding); a vector of another dimension than the first raises. Removal removes.

    It holds a plan, not data: persist the DataFrame given to it to keep vectors in memory.
    """

    def __init__(self, dim: int | None = None):
        self.dim, self.rows = dim, None

    def add(self, units: DataFrame) -> VectorIndex:
        sizes = [r[0] for r in units.where("embedding is not null").select(F.size("embedding")).distinct().limit(2).collect()]
        self.dim = self.dim if self.dim is not None or not sizes else sizes[0]
        if any(s != self.dim for s in sizes):
            raise ValueError(f"vectors of {sizes} dimensions in an index of {self.dim}")
        part = units.select("unit_id", "embedding")
        self.rows = part if self.rows is None else self.rows.unionByName(part)
        return self

    def remove(self, ids: DataFrame) -> VectorIndex:
        self.rows = self.rows.join(ids.select("unit_id").distinct(), "unit_id", "left_anti")
        return self

    def reset(self) -> VectorIndex:
        self.rows, self.dim = None, None
        return self

    def search(self, queries: DataFrame, k: int, threshold: float | None = None, metric: str = "cosine") -> DataFrame:
        """(query_id, unit_id, similarity, rank) of queries (query_id, embedding)."""
        return similarity.search(queries, self.rows, k, threshold, metric)

    def page(self, queries: DataFrame, k: int, number: int, size: int) -> tuple[DataFrame, DataFrame]:
        """A page of the k results, and its metadata."""
        found = self.search(queries, k)
        return similarity.page(found, ["query_id", "rank"], number, size), similarity.page_info(found, number, size)

    def near(self, threshold: float) -> DataFrame:
        """Approximate pairs by random-projection LSH."""
        return clustering.lsh_pairs(self.rows, threshold)


class IvfIndex:
    """An inverted-file index: rows in lists around k-means centres, of which a query visits the nearest few.

    The centres are fitted on a bounded sample (`sample_rows`, in the order of a hash of the id); every row is indexed. How
    many lists a query visits is measured: the fewest by which `target` of the true neighbours of `audit_rows` queries,
    found by the exact search, are in a visited list.
    """

    def __init__(self, lists: int | None = None, target: float = 0.95, sample_rows: int = 50_000, audit_rows: int = 200, seed: int = 42):
        self.lists, self.target, self.sample_rows, self.audit_rows, self.seed = lists, target, sample_rows, audit_rows, seed

    def fit(self, units: DataFrame, k: int = 10) -> IvfIndex:
        """units: (unit_id, embedding); rows without a vector are not indexed. k: the neighbours that the audit looks for."""
        self.units = cut(units.where("embedding is not null").select("unit_id", V.doubles(F.col("embedding")).alias("embedding")))
        n, spark = self.units.count(), units.sparkSession
        order = F.xxhash64("unit_id", F.lit(self.seed))
        lists = min(n, self.lists or max(1, round(n**0.5)))
        if lists <= 1:
            centres = self.units.limit(1).select(F.lit(0).alias("concept_id"), F.col("embedding").alias("centroid"))
        else:
            sample = self.units.orderBy(order, "unit_id").limit(self.sample_rows)
            ready = sample.select(array_to_vector(V.unit(F.col("embedding"))).alias("features"))
            found = KMeans(k=lists, seed=self.seed, maxIter=10).fit(ready).clusterCenters()
            centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "concept_id int, centroid array<double>")
        self.centres = cut(centres)
        near = similarity.search(self.units.select(F.col("unit_id").alias("query_id"), "embedding"), self.centres, 1, metric="cosine_padded", key="concept_id", vector="centroid")
        self.members = cut(near.select("concept_id", F.col("query_id").alias("unit_id")))
        asked = self.units.orderBy(order, "unit_id").limit(self.audit_rows).select(F.col("unit_id").alias("query_id"), "embedding")
        places = similarity.search(asked, self.centres, metric="cosine_padded", key="concept_id", vector="centroid").select("query_id", "concept_id", F.col("rank").alias("place"))
        true = similarity.search(asked, self.units, k, exclude_self=True).join(self.members, "unit_id")
        need = true.join(places, ["query_id", "concept_id"]).agg(F.percentile("place", F.lit(self.target)).alias("p")).first()["p"]
        self.probes = max(1, math.ceil(need or 1))
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, unit_id, similarity, rank) of queries (query_id, embedding)."""
        asked = queries.select("query_id", F.col("embedding").alias("query_vector"))
        hits = attention.hierarchical(asked, self.centres, self.members, self.units, self.probes, k)
        return hits.select("query_id", "unit_id", F.col("unit_score").alias("similarity"), "rank")


def map_batches(df: DataFrame, process: Callable[[pd.Series], pd.Series], column: str, result: str = "double") -> DataFrame:
    """df with `result_value`: process over batches of a column; a row whose batch fails is tried alone, and is null if it fails."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            try:
                out = list(process(part[column]))
            except Exception:  # noqa: BLE001 - an item's error is its null
                out = []
                for i in range(len(part)):
                    try:
                        out.append(process(part[column].iloc[i : i + 1]).iloc[0])
                    except Exception:  # noqa: BLE001
                        out.append(None)
            yield part.assign(result_value=pd.Series(out, index=part.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, result_value {result}")
