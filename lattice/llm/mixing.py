"""7. Mixing sources to target weights by min-cost flow.

Sources may overlap: a document belongs to every source in its membership array. Documents are aggregated by membership
pattern (the sorted set); a pattern offers its tokens once at no cost, a second time at a cost, a third at a greater one
and so on, which is the convex cost of repetition. A min-cost flow routes these capacities to the quotas of the sources
(weight x total). What a pattern sends in all, over its tokens, is how often its documents are drawn: whole passes, and
the documents first in a seeded order for the remainder.

The flow network has a node for each pattern and source and is solved on the driver; it grows with the number of
patterns, not of documents, and more than `max_patterns` raise an error. The seeded order is never sorted whole: token
sums over hash cells find the cell in which a pattern's remainder ends, and only that cell is ranked. Selection is then
a comparison of a hash with the pattern's bound.

Defined results: null texts, empty ones and texts with no source weigh nothing or have no pattern and are not drawn
(except that `keep_unmatched` passes the latter through once). A null source is no source. Quotas beyond what all
passes of the matching documents hold stay unfilled; a source without a weight has the quota 0, and its documents are drawn only
for another source. Repeated rows and null doc_ids are documents like others; rows that draw the same hash are drawn
together. Empty tables give no rows. Other columns are kept by `draw`.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattice.llm._shared import table, written

SEED, PASSES, CELLS, MAX_PATTERNS = "lattice", 4, 4096, 20_000
#: Weight of a language beside the sources: a document of it counts towards either.
LANGUAGE_WEIGHTS = {"lang:de": 0.08, "lang:es": 0.08, "lang:fr": 0.08}


@dataclass
class _Network:
    """Primal-dual min-cost flow: Dijkstra for the next path cost, then all flow of that cost at once. Integers only.

    There are as few phases as different path costs (a handful: passes have few prices), however many patterns there are.
    """

    heads: list[list[int]] = field(default_factory=list)
    to: list[int] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)

    def node(self) -> int:
        self.heads.append([])
        return len(self.heads) - 1

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.heads[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> None:
        potential = [0] * len(self.heads)
        while True:
            far: list[int | None] = [None] * len(self.heads)
            far[source] = 0
            queue = [(0, source)]
            while queue:
                d, x = heapq.heappop(queue)
                if d > far[x]:
                    continue
                for e in self.heads[x]:
                    if self.room[e] > 0:
                        y, z = self.to[e], d + self.cost[e] + potential[x] - potential[self.to[e]]
                        if far[y] is None or z < far[y]:
                            far[y] = z
                            heapq.heappush(queue, (z, y))
            if far[sink] is None:
                return
            potential = [p + (far[sink] if d is None or d > far[sink] else d) for p, d in zip(potential, far)]
            while self._block(source, sink, potential):
                pass

    def _block(self, source: int, sink: int, potential: list[int]) -> bool:
        """One blocking flow over arcs of no reduced cost, level by level; whether any was found."""

        def tight(e: int, x: int) -> bool:
            return self.room[e] > 0 and self.cost[e] + potential[x] == potential[self.to[e]]

        level = [-1] * len(self.heads)
        level[source], queue = 0, [source]
        for x in queue:
            for e in self.heads[x]:
                if level[self.to[e]] < 0 and tight(e, x):
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        if level[sink] < 0:
            return False
        at = [0] * len(self.heads)
        x, path = source, []
        while True:
            if x == sink:
                push = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= push
                    self.room[e ^ 1] += push
                x, path = source, []
                continue
            while at[x] < len(self.heads[x]):
                e = self.heads[x][at[x]]
                if level[self.to[e]] == level[x] + 1 and tight(e, x):
                    break
                at[x] += 1
            if at[x] < len(self.heads[x]):
                path.append(self.heads[x][at[x]])
                x = self.to[path[-1]]
            elif x == source:
                return True
            else:
                level[x] = -1
                x = self.to[path.pop() ^ 1]
                at[x] += 1


def route(tokens: dict[tuple[str, ...], int], quotas: dict[str, int], passes: int = PASSES) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each pattern sends to each of its sources: the most in all, at the least cost of repetition.

    The k-th pass (k = 0, 1, ...) of a pattern costs k * (k + 1) / 2 a token.
    """
    net = _Network()
    start, end = net.node(), net.node()
    sources = {s: net.node() for s in sorted(quotas)}
    for s, node in sources.items():
        net.arc(node, end, quotas[s], 0)
    links = {}
    for pattern in sorted(tokens):
        node = net.node()
        for k in range(passes):
            net.arc(start, node, tokens[pattern], k * (k + 1) // 2)
        for s in pattern:
            if s in sources:
                links[pattern, s] = net.arc(node, sources[s], tokens[pattern] * passes, 0)
    net.solve(start, end)
    return {key: net.room[e ^ 1] for key, e in links.items() if net.room[e ^ 1]}


def memberships() -> Column:
    """The sources of a row of documents: its source, and its language as a source of its own."""
    return F.array_sort(F.array_compact(F.array(F.col("source").cast("string"), F.concat(F.lit("lang:"), F.col("lang").cast("string")))))


def token_estimate() -> Column:
    """A fourth of the characters, rounded up."""
    return F.ceil(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)) / 4).cast("bigint")


def even_weights(patterns: dict[tuple[str, ...], int]) -> dict[str, float]:
    """LANGUAGE_WEIGHTS, and the rest in proportion to the square root of each other source's tokens."""
    held: dict[str, int] = {}
    for pattern, n in patterns.items():
        for s in pattern:
            held[s] = held.get(s, 0) + n
    fixed = {s: w for s, w in LANGUAGE_WEIGHTS.items() if s in held}
    root = {s: n**0.5 for s, n in held.items() if not s.startswith("lang:")}
    rest = (1 - sum(fixed.values())) / (sum(root.values()) or 1)
    return fixed | {s: w * rest for s, w in root.items()}


@dataclass(frozen=True)
class Plan:
    """For each pattern: whole passes, and the greatest draw of a further, partial one (null: none)."""

    bounds: list[tuple[str, int, int | None]]
    flow: dict[tuple[tuple[str, ...], str], int]


_SEPARATOR = "\x1f"


def _rows(docs: DataFrame, members: Column, seed: str) -> DataFrame:
    """Pattern, tokens and draw of each row. A draw is 60 bits of a hash of the seed and doc_id."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")
    return docs.select(F.array_join(members, _SEPARATOR).alias("pattern"), token_estimate().alias("tokens"), draw.alias("draw"))


def plan(docs: DataFrame, members: Column, weights: dict[str, float] | None = None, total: int | None = None, passes: int = PASSES, seed: str = SEED, max_patterns: int = MAX_PATTERNS) -> Plan:
    """weights: of the sources, default even_weights; total: tokens to draw, default as many as docs has."""
    rows = _rows(docs, members, seed).where("tokens > 0 and pattern <> ''")
    cell = F.shiftright("draw", 60 - 12)  # CELLS = 2**12
    cells = written(rows.groupBy("pattern", cell.alias("cell")).agg(F.sum("tokens").alias("tokens")), "cells")
    found = cells.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    tokens = {tuple(r["pattern"].split(_SEPARATOR)): int(r["tokens"]) for r in found}
    weights = even_weights(tokens) if weights is None else weights
    total = sum(tokens.values()) if total is None else total
    whole = sum(weights.values()) or 1
    flow = route(tokens, {s: round(total * w / whole) for s, w in weights.items()}, passes)
    sent: dict[tuple[str, ...], int] = {}
    for (pattern, _), n in flow.items():
        sent[pattern] = sent.get(pattern, 0) + n
    parts = {_SEPARATOR.join(p): divmod(sent.get(p, 0), n) for p, n in tokens.items()}
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(p, int(r)) for p, (_, r) in parts.items() if r], "pattern string, rest bigint")
    running = F.sum("tokens").over(Window.partitionBy("pattern").orderBy("cell"))
    at = cells.withColumn("upto", running).join(wanted, "pattern").where("upto >= rest and upto - tokens < rest").select("pattern", "cell", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))
    edge = rows.withColumn("cell", cell).join(F.broadcast(at), ["pattern", "cell"])  # one row a pattern, at most max_patterns
    by_draw = edge.groupBy("pattern", "left", "draw").agg(F.sum("tokens").alias("tokens"))
    taken = by_draw.withColumn("upto", F.sum("tokens").over(Window.partitionBy("pattern").orderBy("draw"))).where("upto - tokens < left").groupBy("pattern").agg(F.max("draw").alias("bound")).collect()
    bound = {r["pattern"]: r["bound"] for r in taken}
    return Plan([(p, int(k), bound.get(p)) for p, (k, _) in sorted(parts.items())], flow)


def _drawn(docs: DataFrame, members: Column, made: Plan, seed: str, keep_unmatched: bool) -> tuple[DataFrame, list[str]]:
    """docs with columns of new names (the second value): how often a row is drawn, its pattern and its tokens.

    The plan is broadcast: a row a pattern, max_patterns at most.
    """
    times, pattern, tokens, draw, passes, bound = names = [f"_{uuid.uuid4().hex}" for _ in range(6)]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(made.bounds, f"{pattern} string, {passes} bigint, {bound} bigint"))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")
    rows = docs.withColumns({pattern: F.array_join(members, _SEPARATOR), tokens: token_estimate(), draw: hashed}).join(bounds, pattern, "left")
    drawn = F.coalesce(F.col(passes), F.lit(0)) + F.coalesce((F.col(draw) <= F.col(bound)).cast("int"), F.lit(0))
    often = F.when(F.col(pattern) == "", F.lit(int(keep_unmatched))).when(F.col(tokens) > 0, drawn).otherwise(0)
    return rows.withColumn(times, often.cast("int")).select(*docs.columns, times, pattern, tokens), names[:3]


def repeats(docs: DataFrame, members: Column | None = None, seed: str = SEED, **options) -> DataFrame:
    """(doc_id, pattern, tokens, repeats) of every row; repeats is how often it is drawn."""
    members = memberships() if members is None else members
    made = plan(docs, members, seed=seed, **options)
    rows, (times, pattern, tokens) = _drawn(docs.select("doc_id", members.alias("members"), "text"), F.col("members"), made, seed, False)
    return rows.select("doc_id", F.translate(pattern, _SEPARATOR, "+").alias("pattern"), F.col(tokens).alias("tokens"), F.col(times).alias("repeats"))


def draw(docs: DataFrame, members: Column | None = None, seed: str = SEED, keep_unmatched: bool = False, **options) -> DataFrame:
    """The rows of docs, each as often as it is drawn, with the columns of docs."""
    members = memberships() if members is None else members
    made = plan(docs, members, seed=seed, **options)
    rows, (times, _, _) = _drawn(docs, members, made, seed, keep_unmatched)
    copy = f"_{uuid.uuid4().hex}"  # clashes with no column
    each = F.explode(F.when(F.col(times) > 0, F.sequence(F.lit(1), F.col(times))).otherwise(F.array().cast("array<int>"))).alias(copy)
    return rows.select(*docs.columns, each).drop(copy)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
