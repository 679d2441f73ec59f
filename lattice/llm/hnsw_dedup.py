"""4. Embedding near-dedup with hierarchical navigable small-world graphs, one per shard.

Vectors (scaled to length 1) are spread over shards by a hash of the id: about `SHARDS` of them, whatever the number of
rows, as long as a shard has SHARD_ROWS to MOST_ROWS rows. Every shard builds a graph; every vector then queries every
shard's graph for all vectors of cosine `threshold` or more (of two shards one queries the other: cosine is symmetric).
Pairs found are verified by their cosine in double precision, each task keeps a spanning forest of its pairs, and groups
are the connected components. Up to SHARDS * MOST_ROWS rows a vector asks a fixed number of graphs, so work grows a
little more than in proportion; beyond that, with rows times shards, as the method says.

Graph and search work on many vectors at once in NumPy: nodes are inserted in batches (each sees the graph so far and the
rest of its batch), neighbours are chosen by the diversity heuristic, and a beam search advances all queries of a block
together. Three things make the result safe. A row that is a near copy of a node found on its insertion is no node, but a
member of that node's ball, so copies can't fill all links; a ball's members are compared exactly with the queries that
can be near copies of them (those within the sum of both angles of the ball's leader, found in a second graph that holds
only the leaders of several rows). A query whose beam holds nothing but near copies has its beam doubled until it doesn't,
so big groups are not cut off. And for each pair of shards an audit compares `audit_rows` of the queries, leaders first,
and as many planted ones (nodes turned by a random angle within the threshold, whose partner is known) with brute force:
as long as less than `target` of those that have a partner find all of theirs, beams double, in the end up to the shard.

Defined results: vectors that are null, of length 0, of another dimension than the most frequent one, or that hold a
null, NaN or infinity are in no group; nor are null ids, which give no row. Of a repeated id the least vector counts.
Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm._shared import table, written
from lattice.llm._vectors import clean, forest
from lattice.operators.components import connected_components

THRESHOLD, SHARDS, SHARD_ROWS, MOST_ROWS, LINKS, BUILD_BEAM, BEAM, AUDIT_ROWS, TARGET = 0.95, 8, 1024, 131_072, 12, 48, 24, 256, 0.99
_FEW = 4096  # leaders that are compared with every query without a graph
_TILES = 48  # slices of shards that meet, on either side


def beam_search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, cosines) [queries, beam], best first, -1 where there are fewer. links: [nodes, degree], -1 for none."""
    rows, n = len(queries), len(x)
    expand = min(expand, beam)
    line = np.arange(rows)
    place = line * (n + 1)  # of each query's marks; the last of them is for absent links
    marks = np.zeros(rows * (n + 1), dtype=np.int16)
    marks[place + n] = -1
    marks[place[:, None] + entry] = -1
    ids = np.full((rows, beam), -1, dtype=np.int64)
    sims = np.full((rows, beam), -np.inf, dtype=np.float32)
    open_ = np.zeros((rows, beam), dtype=bool)
    width = min(beam, entry.shape[1])
    first = np.einsum("rd,red->re", queries, x[entry])
    ids[:, :width], sims[:, :width], open_[:, :width] = entry[:, :width], first[:, :width], True
    active, number = line, np.arange(1, expand * links.shape[1] + 1, dtype=np.int16)[None, :]
    while True:
        going = open_.any(axis=1)
        if not going.all():
            done = np.flatnonzero(~going)
            if len(done) == len(active):
                break
            if len(active) == rows:
                best_ids, best_sims = ids, sims
            best_ids[active[done]], best_sims[active[done]] = ids[done], sims[done]
            active, ids, sims, open_ = active[going], ids[going], sims[going], open_[going]
        mine = np.arange(len(active))[:, None]
        pick = np.argpartition(np.where(open_, -sims, np.inf), expand - 1, axis=1)[:, :expand]
        usable = open_[mine, pick]
        open_[mine, pick] = False
        near = links[np.where(usable, ids[mine, pick], 0)]
        near = np.where(usable[:, :, None] & (near >= 0), near, n).reshape(len(active), -1)
        at = place[active][:, None] + near
        order = np.broadcast_to(number[:, : at.shape[1]], at.shape)
        fresh = marks.take(at) == 0
        some = at[fresh]
        marks[some] = order[fresh]
        fresh &= marks.take(at) == order  # of a node that comes twice only one stays
        r, c = np.nonzero(fresh)
        marks[at[r, c]] = -1
        found = np.full(near.shape, -np.inf, dtype=np.float32)
        found[r, c] = np.einsum("nd,nd->n", queries[active[r]], x[near[r, c]])
        sims_all = np.concatenate([sims, found], axis=1)
        top = np.argpartition(-sims_all, beam - 1, axis=1)[:, :beam]
        sims = sims_all[mine, top]
        ids = np.concatenate([ids, near], axis=1)[mine, top]
        open_ = np.concatenate([open_, fresh], axis=1)[mine, top]
    if len(active) == rows:
        best_ids, best_sims = ids, sims
    else:
        best_ids[active], best_sims[active] = ids, sims
    order = np.argsort(-best_sims, axis=1, kind="stable")
    best_sims = best_sims[line[:, None], order]
    return np.where(np.isfinite(best_sims), best_ids[line[:, None], order], -1), best_sims


def _choose(x: np.ndarray, of: np.ndarray, near: np.ndarray, links: int) -> np.ndarray:
    """The diversity heuristic: from near (best first, -1 for none), those closer to the node than to any chosen one."""
    near = near[:, : max(4 * links, 32)]
    vectors = x[near]
    own = np.where(near >= 0, np.einsum("nd,ncd->nc", x[of], vectors), -np.inf)
    between = np.einsum("ncd,ned->nce", vectors, vectors)
    taken = np.zeros(near.shape, dtype=bool)
    closest = np.full(near.shape, -np.inf, dtype=np.float32)
    for c in range(near.shape[1]):
        good = (near[:, c] >= 0) & (own[:, c] > closest[:, c]) & (taken.sum(axis=1) < links)
        taken[:, c] = good
        closest = np.where(good[:, None], np.maximum(closest, between[:, c]), closest)
    spare = np.cumsum(~taken & (near >= 0), axis=1) <= (links - taken.sum(axis=1))[:, None]
    taken |= spare & ~taken & (near >= 0)  # places left over go to the nearest of the rest
    order = np.argsort(~taken, axis=1, kind="stable")[:, :links]
    out = np.where(np.take_along_axis(taken, order, axis=1), np.take_along_axis(near, order, axis=1), -1)
    return np.pad(out, ((0, 0), (0, links - out.shape[1])), constant_values=-1)


def _best_first(x: np.ndarray, of: np.ndarray, near: np.ndarray) -> np.ndarray:
    sims = np.where(near >= 0, np.einsum("nd,ncd->nc", x[of], x[near]), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1)


class Graph:
    """layers[0] links all nodes; layer l those of level l and above. Links are row numbers of x, -1 for none.

    threshold: a row whose nearest node has this cosine or more becomes no node; lead has that node, else the row itself.
    """

    def __init__(self, x: np.ndarray, links: int = LINKS, build_beam: int = BUILD_BEAM, seed: int = 1, threshold: float | None = None):
        self.x = x
        n = len(x)
        self.lead = np.arange(n)
        level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 6)
        if n:
            level[int(level.argmax())] = level.max()
        self.layers = [np.full((n, 2 * links if at == 0 else links), -1, dtype=np.int64) for at in range((level.max() if n else 0) + 1)]
        self.top = int(level.argmax()) if n else 0
        order = np.concatenate([[self.top], np.delete(np.arange(n), self.top)]) if n else np.zeros(0, int)
        at = 1
        while at < n:
            batch = order[at : at + min(512, max(16, at))]
            self._insert(batch, level, build_beam, links, threshold)
            at += len(batch)

    def _insert(self, batch: np.ndarray, level: np.ndarray, beam: int, links: int, threshold: float | None) -> None:
        x = self.x
        entry = np.full((len(batch), 1), self.top)
        own = x[batch] @ x[batch].T
        found = []
        for at in range(len(self.layers) - 1, -1, -1):
            ids, sims = beam_search(x, self.layers[at], x[batch], entry, beam if (level[batch] >= at).any() else 1)
            entry = ids[:, :1]
            found.append(ids)
        new = np.ones(len(batch), dtype=bool)
        if threshold is not None:
            high = np.float32(threshold + 1e-5)
            new = sims[:, 0] < high
            self.lead[batch[~new]] = ids[~new, 0]
            near = own >= high
            for i in range(len(batch)):
                if new[i]:
                    theirs = near[i] & new
                    theirs[: i + 1] = False
                    self.lead[batch[theirs]] = batch[i]
                    new &= ~theirs
        for at, ids in zip(range(len(self.layers) - 1, -1, -1), found):
            layer = self.layers[at]
            here = np.flatnonzero((level[batch] >= at) & new)
            if not len(here):
                continue
            mates = own[np.ix_(here, here)].copy()
            np.fill_diagonal(mates, -np.inf)
            few = min(len(here), beam)
            peers = batch[here[np.argsort(-mates, axis=1)[:, :few]]]
            peers = np.where(peers == batch[here][:, None], -1, peers)
            near = _choose(x, batch[here], _best_first(x, batch[here], np.concatenate([ids[here], peers], axis=1)), links)
            layer[batch[here], :links] = near
            to, back = near.ravel(), np.repeat(batch[here], near.shape[1])
            back, to = back[to >= 0], to[to >= 0]
            self._link(layer, to, back)

    def nodes_only(self) -> Graph:
        """The graph over its nodes alone, numbered in the order of their rows."""
        nodes = np.flatnonzero(self.lead == np.arange(len(self.x)))
        number = np.full(len(self.x) + 1, -1)
        number[nodes] = np.arange(len(nodes))
        return Graph.of(self.x[nodes], [number[layer[nodes]] for layer in self.layers], int(number[self.top]) if len(nodes) else 0)

    @staticmethod
    def of(x: np.ndarray, layers: list[np.ndarray], top: int) -> Graph:
        made = Graph.__new__(Graph)
        made.x, made.layers, made.top, made.lead = x, layers, top, np.arange(len(x))
        return made

    def _link(self, layer: np.ndarray, to: np.ndarray, back: np.ndarray) -> None:
        """Adds the links to -> back, and prunes nodes that then have too many."""
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, start, count = np.unique(to, return_index=True, return_counts=True)
        wide = np.full((len(nodes), int(count.max()) if len(nodes) else 0), -1, dtype=np.int64)
        wide[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(start, count)] = back
        for cut in range(0, len(nodes), 256):
            some = nodes[cut : cut + 256]
            both = np.sort(np.concatenate([layer[some], wide[cut : cut + 256]], axis=1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both = _best_first(self.x, some, both)
            full = (both >= 0).sum(axis=1) > layer.shape[1]
            layer[some[~full]] = both[~full, : layer.shape[1]] if both.shape[1] >= layer.shape[1] else np.pad(both[~full], ((0, 0), (0, layer.shape[1] - both.shape[1])), constant_values=-1)
            if full.any():
                layer[some[full]] = _choose(self.x, some[full], both[full], layer.shape[1])

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(queries), 1), self.top)
        for layer in self.layers[:0:-1]:
            entry = beam_search(self.x, layer, queries, entry, 1)[0][:, :1]
        return beam_search(self.x, self.layers[0], queries, entry, min(beam, len(self.x)))


def planted(x: np.ndarray, threshold: float, count: int, seed: int = 3) -> np.ndarray:
    """Vectors of length 1, each of a cosine between threshold and 1 to a row of x taken at random."""
    rng = np.random.default_rng(seed)
    of = x[rng.integers(0, len(x), count)].astype(np.float64)
    away = rng.normal(size=of.shape)
    away -= np.einsum("nd,nd->n", away, of)[:, None] * of
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
    cosine = rng.uniform(threshold, 1, count)[:, None]
    return (cosine * of + np.sqrt(1 - cosine**2) * away).astype(np.float32)


def in_range(graph: Graph, queries: np.ndarray, low: float, beam: int, rows: np.ndarray | None = None, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(query row, node) of cosine low or more, as beams of this width find them; full beams double."""
    n = len(graph.x)
    rows = np.arange(len(queries)) if rows is None else rows
    out = [(np.zeros(0, int), np.zeros(0, int))]
    for at in range(0, len(rows), block):
        part, w = rows[at : at + block], beam
        while len(part):
            if w >= n:
                r, node = np.nonzero(queries[part] @ graph.x.T >= low)
                out.append((part[r], node))
                break
            ids, sims = graph.search(queries[part], w)
            full = sims[:, -1] >= low
            r, c = np.nonzero((sims >= low) & ~full[:, None])
            out.append((part[r], ids[r, c]))
            part, w = part[full], 2 * w
    return tuple(np.concatenate(c) for c in zip(*out))


def near_pairs(graph: Graph, queries: np.ndarray, threshold: float, beam: int = BEAM, audit_rows: int = AUDIT_ROWS, target: float = TARGET, own: np.ndarray | None = None, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query row, node) of cosine about threshold or more, beams widened until the audit passes.

    own: the node that is the query itself, -1 for none. The first audit_rows queries (in the given order) are compared
    with brute force, which is their result; the audit asks for them once more, by the graph.
    """
    n = len(graph.x)
    low = np.float32(threshold - 1e-5)
    if not n or not len(queries):
        return np.zeros(0, int), np.zeros(0, int)
    own = np.full(len(queries), -1) if own is None else own
    order = np.arange(len(queries)) if order is None else order
    first, rest = order[:audit_rows], order[audit_rows:]
    mine, node = in_range(graph, queries, low, n, first, block=1024)
    tests = [(queries, own, mine, node)]
    if len(rest):
        asked = planted(graph.x, threshold, audit_rows)
        tests.append((asked, np.full(len(asked), -1), *in_range(graph, asked, low, n, block=1024)))
    counts = [np.bincount(r[c != o[r]], minlength=len(q)) for q, o, r, c in tests]

    def passes() -> bool:
        for (q, o, _, _), wanted in zip(tests, counts):
            some = np.flatnonzero(wanted)
            r, c = in_range(graph, q, low, beam, some)
            if len(some) and (np.bincount(r[c != o[r]], minlength=len(q))[some] >= wanted[some]).mean() < target:
                return False
        return True

    while len(rest) and beam < n and not passes():
        beam *= 2
    r, c = in_range(graph, queries, low, beam, rest)
    return np.concatenate([mine, r]), np.concatenate([node, c])


def own_queries(graph: Graph, queries: np.ndarray, own: np.ndarray, order: np.ndarray, threshold: float, audit_rows: int = AUDIT_ROWS, target: float = TARGET) -> np.ndarray:
    """The queries of a graph's own rows: its nodes asked on insertion, so only the others do, unless the audit finds nodes near nodes.

    order: the nodes first. Those of the audit are asked again in either case.
    """
    nodes = order[own[order] >= 0]
    first, low = nodes[:audit_rows], np.float32(threshold + 1e-5)
    r, node = in_range(graph, queries, low, len(graph.x), first, block=1024)
    missed = len(np.unique(r[node != own[r]]))
    return order if missed > (1 - target) * len(first) else np.concatenate([first, order[own[order] < 0]])


def hubs(lead: np.ndarray) -> np.ndarray:
    """The rows that lead others."""
    return np.unique(lead[lead != np.arange(len(lead))])


def ball_pairs(x: np.ndarray, lead: np.ndarray, queries: np.ndarray, threshold: float, graph: Graph | None = None, step: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(query row, row of x): for each query and ball whose leader is no near copy of it, a near copy among the rest, if there is one.

    graph: over x[hubs(lead)]; without one all leaders of others are compared with all queries.
    """
    rest = np.flatnonzero(lead != np.arange(len(lead)))
    rest = rest[np.argsort(lead[rest], kind="stable")]
    leaders, start = np.unique(lead[rest], return_index=True)
    ends = np.append(start, len(rest))[1:]
    wide = np.float32(np.cos(min(np.pi, 2 * np.arccos(min(1.0, threshold)))) - 1e-3)  # a near copy of a member is no farther from the leader
    out = [(np.zeros(0, int), np.zeros(0, int))]
    for at in range(0, len(queries) if len(leaders) else 0, 1024):
        q = queries[at : at + 1024]
        if graph is None:
            row, ball = np.nonzero(q @ x[leaders].T >= wide)
        else:
            row, ball = in_range(graph, q, wide, 2 * BEAM)
        other = np.einsum("nd,nd->n", q[row], x[leaders[ball]]) < threshold + 1e-5
        row, ball = row[other], ball[other]
        by = np.argsort(ball, kind="stable")
        row, ball = row[by], ball[by]
        some, first = np.unique(ball, return_index=True)
        for b, rows in zip(some, np.split(row, first[1:])):
            members = rest[start[b] : ends[b]]
            theirs = x[members].astype(np.float64).T
            for cut in range(0, len(rows), most := max(1, step // len(members))):
                part = rows[cut : cut + most]
                cosine = q[part].astype(np.float64) @ theirs
                best = cosine.argmax(axis=1)
                hit = cosine[np.arange(len(part)), best] >= threshold - 1e-6
                out.append((part[hit] + at, members[best[hit]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _units(raw: bytes, dim: int) -> np.ndarray:
    x = np.frombuffer(raw, dtype=np.float32).reshape(-1, dim)
    return (x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.einsum("nd,nd->n", a, b) / np.sqrt(np.einsum("nd,nd->n", a, a) * np.einsum("nd,nd->n", b, b))


_GRAPH = "shard bigint, ids binary, raw binary, lead binary, layers array<binary>, top int, hub_layers array<binary>, hub_top int"


def near_duplicate_groups(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int | None = None, links: int = LINKS, dim: int | None = None) -> DataFrame:
    """(vec_id, group_id, is_kept) of every id; group_id is the least id of the group, which is the one kept."""
    ids = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id")).where("vec_id is not null").distinct()
    points, dim = clean(vectors, dim)
    points = written(points, "vectors")
    rows = points.count()
    shard_rows = min(MOST_ROWS, max(SHARD_ROWS, -(-rows // SHARDS))) if shard_rows is None else shard_rows
    shards = max(1, -(-rows // shard_rows))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard")

    def blobs(graph: Graph) -> list[bytes]:
        return [layer.astype(np.int32).tobytes() for layer in graph.layers]

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float32)
        some = (x != 0).any(axis=1)
        x = x[some]
        unit = _units(x.tobytes(), dim)
        graph = Graph(unit, links, threshold=threshold)
        lead, few = graph.lead, hubs(graph.lead)
        graph = graph.nodes_only()
        second = Graph(unit[few], links) if len(few) > _FEW else None
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "ids": [rows["vec_id"].to_numpy()[some].tobytes()], "raw": [x.tobytes()], "lead": [lead.astype(np.int32).tobytes()], "layers": [blobs(graph)], "top": [graph.top], "hub_layers": [blobs(second) if second else []], "hub_top": [second.top if second else 0]})

    graphs = written(points.select("vec_id", "embedding", shard).repartitionByRange(shards, "shard").groupBy("shard").applyInPandas(build, _GRAPH), "graphs")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[row].as_py()  # noqa: E731, B023
                theirs, mine = (np.frombuffer(get(c), dtype=np.int64) for c in ("ids", "query_ids"))
                if not len(theirs) or not len(mine):
                    continue
                raw, asked = (np.frombuffer(get(c), dtype=np.float32).reshape(-1, dim) for c in ("raw", "query_raw"))
                x, queries = _units(raw.tobytes(), dim), _units(asked.tobytes(), dim)
                lead, asking = (np.frombuffer(get(c), dtype=np.int32).astype(np.int64) for c in ("lead", "query_lead"))
                leaders, line = np.unique(lead), np.arange(len(mine))
                links_of = lambda name, n: [np.frombuffer(b, dtype=np.int32).reshape(n, -1).astype(np.int64) for b in get(name)]  # noqa: E731, B023
                graph, few = Graph.of(x[leaders], links_of("layers", len(leaders)), get("top")), hubs(lead)
                second = Graph.of(x[few], links_of("hub_layers", len(few)), get("hub_top")) if len(few) > _FEW else None
                own = np.full(len(mine), -1)
                if get("shard") == get("query_shard"):
                    own[leaders] = np.arange(len(leaders))
                mixed = np.random.default_rng(len(mine)).permutation(len(mine))
                mixed = mixed[np.argsort(asking[mixed] != mixed, kind="stable")]  # the audit takes leaders first: a big group counts once
                found = [ball_pairs(x, lead, queries, threshold, second)]
                if get("shard") == get("query_shard"):
                    found.append((line, lead))
                    mixed = own_queries(graph, queries, own, mixed, threshold)
                r, node = near_pairs(graph, queries[mixed], threshold, own=own[mixed])
                found.append((mixed[r], leaders[node]))
                r, node = (np.concatenate(c) for c in zip(*found))
                good = (cosines(asked[r], raw[node]) >= threshold) & (mine[r] != theirs[node])
                pairs = list(forest(mine[r][good], theirs[node][good]))
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["src", "dst"])

    tiles = min(shards, _TILES)  # slices of equal numbers of shards; each pair of slices is a task
    graphs = graphs.repartitionByRange(tiles, "shard")
    asked = graphs.select(*(F.col(c).alias(f"query_{c}") for c in ("shard", "ids", "raw", "lead")))
    met = graphs.crossJoin(asked).where("shard <= query_shard")
    edges = written(met.mapInArrow(search, "src bigint, dst bigint"), "pairs")
    groups = connected_components(edges).select(F.col("vertex").alias("vec_id"), F.col("component").alias("group_id"))
    return ids.join(groups, "vec_id", "left").select("vec_id", F.coalesce("group_id", "vec_id").alias("group_id")).withColumn("is_kept", F.col("vec_id") == F.col("group_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "embeddings"))
