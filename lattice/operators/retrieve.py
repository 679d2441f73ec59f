"""Unified retrieval: layers by mode, union, re-ranking, top k, explanation, context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.functions import text as T
from lattice.functions import vectors as V
from lattice.operators import attention, state
from lattice.operators.similarity import ranked, search

#: Layers of a mode; an unknown mode is hybrid.
LAYERS = {"episodic": ("episodes",), "causal": ("units",), "hybrid": ("units", "episodes")}


def unit_layer(queries: DataFrame, concepts: DataFrame, members: DataFrame, units: DataFrame, k: int, coarse_k: int = 5, focus: DataFrame | None = None) -> DataFrame:
    """(query_id, id, content, embedding, concept_id, layer, semantic_similarity, score) of the two-stage search."""
    hits = attention.hierarchical(queries, concepts, members, units, coarse_k, k, focus)
    rows = hits.join(units.select("unit_id", "content", "embedding", *[c for c in ("created_at",) if c in units.columns]), "unit_id").join(queries.select("query_id", "query_vector"), "query_id")
    rows = rows.withColumn("cosine", V.cosine(F.col("embedding"), F.col("query_vector")))
    scored = attention.item_scores(rows)
    return ranked(scored, ["query_id"], [F.desc(F.round("score", 12)), F.col("unit_id")], "_r").where(F.col("_r") <= k).select("query_id", F.col("unit_id").alias("id"), "content", F.col("embedding").cast("array<double>").alias("embedding"), "concept_id", F.lit("units").alias("layer"), F.col("cosine").alias("semantic_similarity"), "score")


def episode_layer(queries: DataFrame, episodes: DataFrame, k: int, threshold: float = 0.3) -> DataFrame:
    """The k episodes most similar to each query, at least threshold."""
    q = queries.select("query_id", F.col("query_vector").alias("embedding"))
    hits = search(q, episodes, k, threshold, key="episode_id")
    rows = hits.join(episodes.select("episode_id", "content", "embedding"), "episode_id")
    return rows.select("query_id", F.col("episode_id").alias("id"), "content", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(None).alias("concept_id"), F.lit("episodes").alias("layer"), F.col("similarity").alias("semantic_similarity"), F.col("similarity").alias("score"))


def retrieve(queries: DataFrame, tables: dict[str, DataFrame], mode: str = "hybrid", k: int = 10, coarse_k: int = 5, focus: DataFrame | None = None, weights: list[float] | None = None, rerank: bool = True) -> DataFrame:
    """queries (query_id, query_vector); tables: concepts, members, units, episodes as the mode needs them.

    (query_id, id, content, layer, concept_id, semantic_similarity, score, rl_score, rank): the k best of all layers by the
    ranker's score, else by score, falling back to the similarity.
    """
    parts, layers = [], LAYERS.get(mode, LAYERS["hybrid"])
    if "units" in layers:
        parts.append(unit_layer(queries, tables["concepts"], tables["members"], tables["units"], k, coarse_k, focus))
    if "episodes" in layers:
        parts.append(episode_layer(queries, tables["episodes"], k))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    order = F.coalesce("score", "semantic_similarity", F.lit(0.0))
    if rerank:
        featured = state.ranker_features(rows.join(queries, "query_id"))
        rows = state.rerank(featured, weights).drop("features", "query_vector")
        order = F.col("rl_score")
    else:
        rows = rows.withColumn("rl_score", F.lit(None).cast("double"))
    out = ranked(rows, ["query_id"], [F.desc(F.round(order, 12)), F.col("layer"), F.col("id")]).where(F.col("rank") <= k)
    return out.select("query_id", "id", "content", "layer", "concept_id", "semantic_similarity", "score", "rl_score", "rank")


def context_table(results: DataFrame) -> DataFrame:
    """(query_id, context): a markdown table of the results, or a fixed sentence for none."""
    head = "| Source | Recency | Content |\n| :--- | :--- | :--- |\n"
    line = T.context_row(F.coalesce(F.col("concept_id").cast("string"), F.lit("Unknown")), F.lit(None).cast("string"), F.col("content"))
    rows = results.select("query_id", "rank", line.alias("line")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("p"))
    return rows.select("query_id", F.concat(F.lit(head), F.array_join(F.transform("p", lambda s: s["line"]), "\n"), F.lit("\n")).alias("context"))


def explain_results(results: DataFrame, queries: DataFrame, text: str = "query_text") -> DataFrame:
    """(query_id, segments, confidence, as_text, as_json, as_html); a query without results gets a summary of 0.5."""
    top = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.array_sort(F.collect_list(F.struct("rank", "id", "layer", "score", "content", "semantic_similarity"))).alias("rows"))
    q = queries.select("query_id", F.col(text).alias("_q")).join(top, "query_id", "left")
    n, mean = F.coalesce("n", F.lit(0)), F.coalesce("mean", F.lit(0.0))
    segment = lambda title, content, confidence: F.struct(title.alias("title"), content.alias("content"), confidence.cast("double").alias("confidence"))
    none = F.format_string("No results were found for '%s'.", "_q")
    some = F.format_string("%d results were found for '%s'; their mean score is %.3f.", n.cast("int"), F.col("_q"), mean)
    overall = segment(F.lit("Summary"), F.when(n == 0, none).otherwise(some), F.when(n == 0, 0.5).otherwise(F.least(F.lit(0.9), mean + 0.1)))
    preview = lambda c: F.when(F.length(c) > 200, F.concat(F.substring(c, 1, 200), F.lit("..."))).otherwise(c)
    each = F.transform(F.slice(F.coalesce("rows", F.array().cast(dict(top.dtypes)["rows"])), 1, 3), lambda r: segment(F.concat(F.lit("Result "), r["rank"].cast("string")), F.format_string("%s (%s), score %.3f: %s", r["id"].cast("string"), r["layer"], r["score"], preview(r["content"])), F.greatest(F.lit(0.1), F.least(F.lit(1.0), r["score"]))))
    heads = segment(F.lit("Heads"), F.lit("Scores combine semantic similarity with the concept's score."), F.lit(0.8))
    method = segment(F.lit("Method"), F.lit("Concepts are ranked first, then the units of the best ones, then all layers together."), F.lit(0.9))
    segments = F.concat(F.array(overall), each, F.when(n > 0, F.array(heads)).otherwise(F.array().cast("array<struct<title:string,content:string,confidence:double>>")), F.array(method))
    out = q.select("query_id", segments.alias("segments"))
    mean_confidence = F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["confidence"]) / F.size("segments")
    lines = F.transform("segments", lambda s: F.format_string("%s (%.2f)\n%s", s["title"], s["confidence"], s["content"]))
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.array_join(F.transform("segments", lambda s: F.concat(F.lit("<section><h3>"), escape(s["title"]), F.lit("</h3><p>"), escape(s["content"]), F.lit("</p></section>"))), "")
    return out.withColumn("confidence", mean_confidence).withColumn("as_text", F.array_join(lines, "\n\n")).withColumn("as_json", F.to_json("segments")).withColumn("as_html", html)


def answer(queries: DataFrame, results: DataFrame, generate: Callable[[Column], Column], most_tokens: int = 2000) -> DataFrame:
    """(query_id, answer): context cut to a token budget, then the injected generator over question and context."""
    prompt = F.concat(F.col("query_text"), F.lit("\n\n"), F.coalesce(T.truncate_tokens(F.col("context"), most_tokens), F.lit("No relevant context found.")))
    return queries.join(context_table(results), "query_id", "left").select("query_id", generate(prompt).alias("answer"))


def iterate(queries: DataFrame, tables: dict[str, DataFrame], evaluate: Callable[[Column], Column], embed: Callable[[Column], Column], rounds: int = 3, **options) -> DataFrame:
    """Retrieval with follow-up queries: evaluate judges question and context in tagged text; unready queries go on with their follow-up.

    (query_id, round, id, content, ...) of all rounds; rounds is a small fixed number.
    """
    from lattice.functions import parse
    from lattice.session import cut

    asked, out = queries.select("query_id", "query_text"), None
    for i in range(1, rounds + 1):
        rows = cut(retrieve(asked.withColumn("query_vector", embed(F.col("query_text"))), tables, **options).withColumn("round", F.lit(i)))
        out = rows if out is None else out.unionByName(rows)
        judged = asked.join(context_table(rows), "query_id", "left").withColumn("_d", parse.decision(evaluate(F.concat_ws("\n\n", "query_text", "context"))))
        asked = cut(judged.where("not _d.ready and _d.follow_up_query <> ''").select("query_id", F.col("_d.follow_up_query").alias("query_text")))
        if asked.isEmpty():
            break
    return out
