"""A conversational agent over the engine: mode decision, retrieval with focus, context, generation; the state lives in the store.

The model is injected as column functions (see lattice.functions.providers): decide and evaluate judge a prompt,
generate answers one. All of a turn's retrieval is Spark; what comes to the driver is a session's state and one answer.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.engine import Engine
from lattice.functions import parse
from lattice.functions import text as T
from lattice.operators import retrieve, state
from lattice.session import cut


class Agent:
    def __init__(self, engine: Engine, workspace: str, generate: Callable[[Column], Column], decide: Callable[[Column], Column] | None = None, evaluate: Callable[[Column], Column] | None = None, most_tokens: int = 2000):
        self.engine, self.workspace, self.generate, self.decide, self.evaluate, self.most_tokens = engine, workspace, generate, decide, evaluate, most_tokens

    def focus(self, session: str) -> dict[str, tuple]:
        row = self.engine.store.scan("chat_sessions", F.col("id") == session).first()
        return {i: tuple(v) for i, v in json.loads(row["focus_state"] or "{}").items()} if row else {}

    def history(self, session: str, last: int = 10) -> DataFrame:
        """The last messages, oldest first."""
        return self.engine.store.recent("chat_messages", F.col("session_id") == session, last).orderBy("created_at", "id")

    def mode(self, question: str) -> str:
        if self.decide is None:
            return "hybrid"
        return self.engine.spark.createDataFrame([(question,)], "q string").select(T.mode_of(self.decide(F.col("q")))).first()[0]

    def chat(self, session: str, question: str, k: int = 10) -> str:
        """Answers one question; keeps both messages, and moves the session's focus to the units found."""
        engine, spark, mode, items = self.engine, self.engine.spark, self.mode(question), self.focus(session)
        kept = spark.createDataFrame([(i, float(v[0])) for i, v in items.items()], "unit_id string, weight double")
        results = cut(engine.retrieve(self.workspace, {"q": question}, mode, k, focus=self._concept_focus(kept) if items else None))
        asked = spark.createDataFrame([("q", question)], "query_id string, query_text string")
        reply = retrieve.answer(asked, results, self.generate, self.most_tokens).first()["answer"]
        found = [r["id"] for r in results.where("layer = 'units'").orderBy("rank").select("id").collect()]  # at most k
        items = state.update_focus(items, time.time(), found, "activate")
        engine.store.upsert("chat_sessions", spark.createDataFrame([(session, self.workspace, question[:30], json.dumps(items))], "id string, workspace_id string, name string, focus_state string"), ["id"])
        for role, content in (("user", question), ("assistant", reply)):
            engine.store.append("chat_messages", spark.createDataFrame([(f"{session}-{time.time_ns()}", session, role, content, mode)], "id string, session_id string, role string, content string, mode_used string"))
        return reply

    def _concept_focus(self, kept: DataFrame) -> DataFrame:
        from lattice.operators.attention import focus_weights

        return focus_weights(self.engine.tables(self.workspace)["members"], kept)

    def research(self, question: str, rounds: int = 3, k: int = 10) -> DataFrame:
        """Rounds of retrieval with follow-up questions until evaluate is satisfied; the rows of all rounds."""
        queries = self.engine.queries({"q": question}).select("query_id", "query_text")
        return retrieve.iterate(queries, self.engine.tables(self.workspace), self.evaluate, self.engine.embed, rounds, k=k)

    def reflect(self, session: str) -> dict:
        """The model's reflection on the last messages, kept in the consciousness table."""
        said = self.history(session, 5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", F.concat_ws(": ", F.upper("role"), "content").alias("line")))), lambda s: s["line"]), "\n").alias("history"))
        row = said.select(parse.reflection(self.generate(F.col("history"))).alias("r")).select("r.*").first()
        self.engine.store.append("consciousness", self.engine.spark.createDataFrame([(self.workspace, row["mood"], row["thought_summary"], list(row["focus_topics"]))], "workspace_id string, mood string, thought_summary string, focus_topics array<string>"))
        return row.asDict()
