"""The facade: train, retrieve, feedback, focus and consolidation over the tables of a store, by workspace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.functions import text as T
from lattice.functions import vectors as V
from lattice.operators import consolidation, ingest, retrieve, state
from lattice.session import cut
from lattice.sources.store import Store


class Engine:
    """embed: text -> vector column; generate: chunk -> model answer column (see lattice.functions.providers)."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] = T.md5_vector, generate: Callable[[Column], Column] = ingest.template_answer):
        self.spark, self.store, self.embed, self.generate = spark, Store(spark, path), embed, generate

    def create_workspace(self, workspace: str, name: str = "") -> None:
        self.store.insert_if_absent("workspaces", self.spark.createDataFrame([(workspace, name)], "id string, name string"), ["id"])

    def train(self, workspace: str, docs: DataFrame, **options) -> DataFrame:
        """Ingests docs (doc_id, text); one row of counts. Units and episodes of the same content keep their ids, and are stored once."""
        out = ingest.ingest(docs, self.embed, self.generate, **options)
        here = F.lit(workspace).alias("workspace_id")
        text = lambda c: F.col(c).cast("string")
        self.store.insert_if_absent("episodes", out["episodes"].select(text("episode_id").alias("id"), here, "summary", "content", "embedding"), ["id"])
        self.store.insert_if_absent("units", out["units"].select(text("unit_id").alias("id"), here, text("episode_id").alias("episode_id"), "content", "embedding"), ["id"])
        self.store.insert_if_absent("unit_edges", out["edges"].select(F.concat_ws(">", "src", "dst", "temporal_proximity").alias("id"), here, text("src").alias("src"), text("dst").alias("dst"), "semantic_similarity", "temporal_proximity", "causal_weight"), ["id"])
        one = F.lit(1)
        return out["episodes"].agg(F.count(one).alias("episodes")).crossJoin(out["units"].agg(F.count(one).alias("units"))).crossJoin(out["edges"].agg(F.count(one).alias("edges")))

    def _units(self, workspace: str) -> DataFrame:
        return self.store.units_with_vectors(workspace).select(F.col("id").alias("unit_id"), "content", "embedding", "created_at", "is_archived")

    def tables(self, workspace: str) -> dict[str, DataFrame]:
        """The tables a retrieval reads; of the concepts the latest generation."""
        all_ = self.store.scan("concepts", F.col("workspace_id") == workspace)
        newest = all_.agg(F.max("generation").alias("newest"))
        concepts = all_.join(F.broadcast(newest), F.col("generation") == F.col("newest")).select(F.col("id").alias("concept_id"), "centroid")
        episodes = self.store.scan("episodes", (F.col("workspace_id") == workspace) & F.col("embedding").isNotNull())
        return {"units": self._units(workspace), "concepts": concepts, "members": self.store.scan("concept_members"), "episodes": episodes.select(F.col("id").alias("episode_id"), "content", "embedding")}

    def weights(self, workspace: str) -> list[float]:
        row = self.store.scan("ranker_state", F.col("model_id") == workspace).first()
        return row["weights"] if row else state.INITIAL

    def retrieve(self, workspace: str, questions: dict[str, str], mode: str = "hybrid", k: int = 10, focus: DataFrame | None = None) -> DataFrame:
        """questions: query_id -> text. Results as of lattice.operators.retrieve."""
        queries = self.queries(questions).select("query_id", "query_vector")
        return retrieve.retrieve(queries, self.tables(workspace), mode, k, focus=focus, weights=self.weights(workspace))

    def queries(self, questions: dict[str, str]) -> DataFrame:
        asked = self.spark.createDataFrame(list(questions.items()), "query_id string, query_text string")
        return asked.withColumn("query_vector", self.embed(F.col("query_text")))

    def explain(self, questions: dict[str, str], results: DataFrame) -> DataFrame:
        return retrieve.explain_results(results, self.queries(questions))

    def feedback(self, workspace: str, ratings: DataFrame, questions: dict[str, str]) -> list[float]:
        """Folds ratings (seq, query_id, unit_id, rating) into the workspace's ranker weights, and returns them."""
        pairs = ratings.join(self.queries(questions), "query_id").join(self._units(workspace), "unit_id")
        rows = state.ranker_features(pairs).select(F.lit(workspace).alias("model_id"), "seq", "rating", "features")
        new = cut(state.update_weights(rows, start=self.weights(workspace)))
        self.store.upsert("ranker_state", new, ["model_id"])
        return self.weights(workspace)

    def consolidate(self, workspace: str, threshold: float = consolidation.REPLAY, support: int = consolidation.SUPPORT) -> DataFrame:
        """Merges repeated units, archives them and forms a new generation of concepts; one row of counts and ratios."""
        units = cut(self._units(workspace).select("unit_id", "content", V.doubles(F.col("embedding")).alias("embedding"), "is_archived"))
        numbered = units.withColumn("key", F.col("unit_id")).withColumn("unit_id", F.xxhash64("unit_id"))
        out = consolidation.consolidate(numbered, threshold, support)
        after, here = out["units"], F.lit(workspace).alias("workspace_id")
        gone = cut(after.where("is_archived and key is not null").select(F.col("key").alias("id")))
        names = after.select("unit_id", F.coalesce("key", F.concat(F.lit("merged-"), F.col("unit_id").cast("string"))).alias("name"))
        last = self.store.scan("concepts", F.col("workspace_id") == workspace).agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0] + 1
        concept = F.concat(F.lit(f"{workspace}-{last}-"), F.col("concept_id"))
        made = cut(out["concepts"].select(concept.alias("id"), here, F.col("concept_id").alias("name"), "centroid", F.lit(last).alias("generation")))
        links = cut(out["members"].join(names, "unit_id").select(concept.alias("concept_id"), F.col("name").alias("unit_id")))
        self.store.append("units", after.where("key is null").select(F.concat(F.lit("merged-"), F.col("unit_id").cast("string")).alias("id"), here, "content", "embedding"))
        self.store.archive(gone)
        self.store.append("concepts", made)
        self.store.insert_if_absent("concept_members", links, ["concept_id", "unit_id"])
        return out["summary"]

    def delete_workspace(self, workspace: str) -> None:
        self.store.delete("workspaces", self.spark.createDataFrame([(workspace,)], "id string"))
