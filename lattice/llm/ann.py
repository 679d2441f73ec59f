"""2. Approximate nearest neighbours by multiprobe p-stable hashing.

Each of `tables` hash tables has M functions floor((a.x + b) / W) with normal a (2-stable, so that the chance of a
collision depends on the Euclidean distance). A query visits its own bucket, then buckets whose functions are moved by
one, in the order of the squared distances to the boundaries crossed, which estimates the success of a probe. Candidates
of all tables are merged and ranked by exact distance. Every row is a query unless `asking` says which are; all rows are
searched in either case. The registered query asks for the rows whose id is divisible by QUERY_STEP.

Nothing is tuned to a table by hand. W follows from the spread of all vectors, and M is at most what leaves about
`bucket_rows` rows a bucket. An audit ranks a bounded sample of queries (`audit_rows`, exactly, against the whole table).
For each M it takes the fewest probes by which `target` of their true neighbours are reached, if `max_probes` suffice,
and estimates the work: candidates compared (from the collisions within the sample) and copies of the query shipped. The
M of the least work is used. Only if no M of 1 or more will do is the table one bucket: brute force, in tiles.

Points and probes meet by bucket in groups of buckets, so a query's vector goes to a group once for all the buckets it
probes there, and each group sends on only the k best of a query. Buckets of more than `block_rows` points are tiles:
their points and their queries fall into parts by a hash of the id, and each part meets each, so no task holds a hot one.

Defined results: vectors that are null, of another dimension than the table's most frequent one, or that hold a null, NaN
or infinity are no points and no queries; so are null ids. Of a repeated id the least vector counts. A row is not its own
neighbour, equal vectors under other ids are; ties in distance go to the lesser id. A table of n rows gives at most
n - 1 neighbours a row, so an empty one and one of a single row give none; nor does a table in which `asking` holds for
no row (it is no query where it is null). Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattice.llm._shared import table, written
from lattice.llm._text import mix
from lattice.llm._vectors import blobs, clean, matrix, unblob

NEIGHBOURS, TABLES, BUCKET_ROWS, BLOCK_ROWS, MAX_PROBES, AUDIT_ROWS, TARGET, SEED, QUERY_STEP = 10, 4, 256, 50_000, 48, 200, 0.96, 7, 50
SHIPPED = 400  # comparisons that take as long as sending a vector to one more bucket
WIDTH = 1.5  # of a function's cells, in standard deviations of the projections


@dataclass(frozen=True)
class Tables:
    axes: np.ndarray  # [tables, functions, dim], divided by the cell width
    shifts: np.ndarray  # [tables, functions]
    centre: np.ndarray

    def places(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x - self.centre) @ self.axes[t].T + self.shifts[t]

    def keys(self, cells: np.ndarray, t: int) -> np.ndarray:
        """One int64 for the cells [..., functions] of table t."""
        with np.errstate(over="ignore"):
            key = np.full(cells.shape[:-1], mix(np.array([t + 1], dtype=np.uint64))[0])
            for i in range(cells.shape[-1]):
                key = mix(key * np.uint64(31) + cells[..., i].astype(np.int64).view(np.uint64))
        return key.view(np.int64)

    def probes(self, x: np.ndarray, t: int, moves: np.ndarray) -> np.ndarray:
        """int64 [rows, probes]: buckets in the order of their estimated success."""
        place = self.places(x, t)
        cell = np.floor(place)
        rest = place - cell
        functions = rest.shape[1]
        gaps = np.concatenate([rest, 1 - rest], axis=1)
        order = np.argsort(gaps, axis=1)
        near = np.take_along_axis(gaps, order, axis=1) ** 2
        offset = np.zeros((len(x), len(moves), functions))
        score = np.zeros((len(x), len(moves)))
        for i in range(2 * functions):  # the i-th nearest boundary is crossed in the sets that hold i
            with_i = moves[:, i]
            score[:, with_i] += near[:, i : i + 1]
            which = order[:, i]
            step = np.where(which < functions, -1.0, 1.0)
            offset[np.arange(len(x))[:, None], np.flatnonzero(with_i)[None, :], (which % max(1, functions))[:, None]] += step[:, None]
        best = np.argsort(score, axis=1, kind="stable")
        return np.take_along_axis(self.keys(cell[:, None, :] + offset, t), best, axis=1)


def perturbations(functions: int, count: int) -> np.ndarray:
    """bool [sets, 2 * functions]: sets of boundaries by rank of nearness, in the order of their expected scores.

    The expected squared distance of the j-th nearest boundary is that of uniform offsets; no set crosses both
    boundaries of one function (ranks j and 2M + 1 - j).
    """
    m = functions
    z = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    sets, heap = [()], [(z[0], (0,))] if m else []
    while heap and len(sets) < count:
        score, s = heapq.heappop(heap)
        if all(2 * m - 1 - i not in s for i in s):
            sets.append(s)
        if s[-1] + 1 < 2 * m:
            heapq.heappush(heap, (score + z[s[-1] + 1], (*s, s[-1] + 1)))
            heapq.heappush(heap, (score - z[s[-1]] + z[s[-1] + 1], (*s[:-1], s[-1] + 1)))
    out = np.zeros((len(sets), 2 * m), dtype=bool)
    for i, s in enumerate(sets):
        out[i, list(s)] = True
    return out


def nearest(queries: np.ndarray, ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact (row, id, distance) of the k nearest points of each query, itself left out; ties by the lesser id.

    Every point whose rough distance is within the error bound of the k-th is ranked exactly.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(points) > k + 1:  # of equal vectors only the k + 1 least ids can be among the k nearest
        order = np.argsort(point_ids, kind="stable")
        points, point_ids = np.ascontiguousarray(points[order]), point_ids[order]
        same = np.unique(points.view(np.dtype((np.void, points.dtype.itemsize * points.shape[1]))).ravel(), return_inverse=True)[1] if points.shape[1] else np.zeros(len(points), int)
        by = np.argsort(same, kind="stable")
        start = np.flatnonzero(np.append(True, same[by][1:] != same[by][:-1]))
        rank = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
        keep = by[rank <= k]
        points, point_ids = points[keep], point_ids[keep]
    dim = points.shape[1]
    centre = points.mean(axis=0, dtype=np.float64) if len(points) else 0.0
    near = (points - centre).astype(np.float32)
    squares = np.einsum("ij,ij->i", near, near, dtype=np.float64)
    unsure = 6 * (dim + 8) * float(np.finfo(np.float32).eps)  # of the squared lengths, the error of a rough squared distance
    least, slack = (1 - unsure) * squares, (2 * unsure * squares).astype(np.float32)
    alike = bool(len(points)) and slack.max() <= 4 * np.median(slack)  # one bound of the error is then good enough for all points
    held = np.concatenate([near, least[:, None].astype(np.float32)], axis=1)
    step = max(1, 4_000_000 // max(1, len(points)))
    few = min(len(points), k + 1)  # the query itself may be among them
    fold = max(1, min(16, len(points) // (4 * few)))
    width = len(points) // fold
    for at in range(0, len(queries) if len(points) else 0, step):
        q = queries[at : at + step]
        moved = (q - centre).astype(np.float32)
        lengths = np.einsum("ij,ij->i", moved, moved, dtype=np.float64)
        rough = np.concatenate([-2 * moved, np.ones((len(q), 1), np.float32)], axis=1) @ held.T  # a lower bound, but for the query's own length
        high = (rough if alike else rough + slack)[:, : fold * width].reshape(len(q), fold, width).min(axis=1)
        if alike:
            high = high + slack.max()  # the k-th of these is no less than the k-th of all
        kth = np.partition(high, few - 1, axis=1)[:, few - 1].astype(np.float64) + (1 + unsure) * lengths
        limit = (np.sqrt(np.maximum(kth, 0)) + 2e-6) ** 2 - (1 - unsure) * lengths  # distances are compared by six decimals
        bound = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
        row, point = np.nonzero(~(rough > bound[:, None]))
        exact = np.empty(len(row))
        for cut in range(0, len(row), 100_000):
            some = slice(cut, cut + 100_000)
            gap = q[row[some]].astype(np.float64) - points[point[some]]
            exact[some] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        other = point_ids[point] != ids[at : at + step][row]
        row, neighbour, exact = row[other], point_ids[point[other]], np.round(exact[other], 6)
        order = np.lexsort((neighbour, exact, row))
        row = row[order]
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
        best = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row)))) < k
        order = order[best]
        out.append((row[best] + at, neighbour[order], exact[order]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _merge(row: np.ndarray, neighbour: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each row, every neighbour once."""
    order = np.lexsort((neighbour, distance, row))  # a neighbour found again has the same distance, so it comes next
    row, neighbour = row[order], neighbour[order]
    if len(row):
        new = np.append(True, (row[1:] != row[:-1]) | (neighbour[1:] != neighbour[:-1]))
        order, row = order[new], row[new]
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    return order[rank < k]


def _exact(points: DataFrame, queries: np.ndarray, ids: np.ndarray, dim: int, k: int) -> dict[int, np.ndarray]:
    """The true neighbours (as vectors) of a bounded number of queries, from one pass over all points."""
    sent = points.sparkSession.sparkContext.broadcast((queries, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qi = sent.value
        for batch in batches:
            x, xi = matrix(batch.column(1), dim), batch.column(0).to_numpy()
            row, neighbour, distance = nearest(q, qi, x, xi, k)
            at = np.argsort(xi)
            yield pa.RecordBatch.from_arrays([pa.array(qi[row]), pa.array(neighbour), pa.array(distance), blobs(x[at[np.searchsorted(xi, neighbour, sorter=at)]])], names=["q", "id", "d", "v"])

    best = points.mapInArrow(run, "q bigint, id bigint, d double, v binary").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("r") <= k)
    out: dict[int, list[bytes]] = {}
    for r in best.select("q", "v").collect():
        out.setdefault(r["q"], []).append(bytes(r["v"]))
    return {q: np.frombuffer(b"".join(v), dtype=np.float32).reshape(-1, dim) for q, v in out.items()}


def tune(points: DataFrame, dim: int, rows: int, k: int, tables: int, bucket_rows: int, max_probes: int, audit_rows: int, target: float, seed: int) -> tuple[Tables, int]:
    """The hash functions and the number of probes a table."""
    mean = points.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).orderBy("i").collect()
    centre = np.array([r["m"] for r in mean], dtype=np.float32)
    spread = float(np.sqrt(sum(r["v"] for r in mean))) or 1.0
    audit = points.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(audit_rows).collect()
    ids, x = np.array([r["vec_id"] for r in audit]), np.array([r["embedding"] for r in audit], dtype=np.float32).reshape(-1, dim)
    true = _exact(points, x, ids, dim, k)
    rng = np.random.default_rng(seed)
    most = int(np.ceil(np.log2(max(1.0, rows / bucket_rows)) / 1.25))
    axes, shifts = rng.normal(size=(tables, most, dim)).astype(np.float32) / np.float32(spread * WIDTH), rng.random((tables, most)).astype(np.float32)
    best: tuple[float, Tables, int] | None = None
    for functions in range(most, -1, -1):
        if not functions and best:
            break
        used = tables if functions else 1
        made = Tables(axes[:used, :functions], shifts[:used, :functions], centre)
        moves = perturbations(functions, max_probes)
        missed = len(moves)
        reached = [np.full(sum(len(v) for v in true.values()), missed)]
        among = []
        for t in range(used):
            probes, at = made.probes(x, t, moves), []
            for i, q in enumerate(ids.tolist()):
                if q in true:
                    hit = made.keys(np.floor(made.places(true[q], t)), t)[:, None] == probes[i][None, :]
                    at.append(np.where(hit.any(axis=1), hit.argmax(axis=1), missed))
            if at:
                reached.append(np.concatenate(at))
            hit = made.keys(np.floor(made.places(x, t)), t)[None, :, None] == probes[:, None, :]
            among.append(np.where(hit.any(axis=2), hit.argmax(axis=2), missed)[~np.eye(len(x), dtype=bool)])
        need = np.sort(np.min(reached, axis=0))
        probes = int(need[int(np.ceil(target * len(need))) - 1]) + 1 if len(need) else 1
        if probes <= missed:
            share = sum(float((a < probes).mean()) if len(a) else 1.0 for a in among)
            work = rows * share + SHIPPED * used * probes
            if best is None or work < best[0]:
                best = work, made, probes
    return best[1:]


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, tables: int = TABLES, bucket_rows: int = BUCKET_ROWS, max_probes: int = MAX_PROBES, audit_rows: int = AUDIT_ROWS, target: float = TARGET, dim: int | None = None, seed: int = SEED, block_rows: int = BLOCK_ROWS, asking: Column | None = None) -> DataFrame:
    """(vec_id, neighbour_id, distance, rank) of the k nearest neighbours found for every row, or those where asking (over vec_id) holds."""
    points, dim = clean(vectors, dim)
    points = written(points, "points")
    searches = points if asking is None else points.where(asking)
    rows, queries = points.count(), searches.count()
    schema = "vec_id bigint, neighbour_id bigint, distance double"
    if not queries:
        return points.sparkSession.createDataFrame([], schema + ", rank int")
    made, probes = tune(points, dim, rows, k, tables, bucket_rows, max_probes, audit_rows, target, seed)
    moves = perturbations(made.axes.shape[1], max_probes)
    groups = max(1, (rows + queries * probes) * len(made.axes) // 250_000)
    context = points.sparkSession.sparkContext
    sent = context.broadcast((made.axes, made.shifts, made.centre))

    def stored_keys(made: Tables, x: np.ndarray) -> np.ndarray:
        return np.stack([made.keys(np.floor(made.places(x, t)), t) for t in range(len(made.axes))], axis=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Tables(*sent.value)
        for batch in batches:
            key, n = np.unique(stored_keys(made, matrix(batch.column(1), dim)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    large = points.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > block_rows).orderBy("key").collect()  # at most rows * tables / block_rows
    tiled = context.broadcast((np.array([r["key"] for r in large], dtype=np.int64), np.array([-(-r["n"] // block_rows) for r in large], dtype=np.int64)))

    def tiles(key: np.ndarray, row: np.ndarray, ids: np.ndarray, probing: bool) -> tuple[np.ndarray, np.ndarray]:
        """The same with the keys of large buckets repeated, one for each tile in which the row takes part."""
        hot, parts = tiled.value
        if not len(hot):
            return key, row
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        count = np.where(hot[at] == key, parts[at], 1)
        again = np.repeat(np.arange(len(key)), count)
        other = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
        own = (mix(ids.view(np.uint64)) % np.uint64(1 << 20)).astype(np.int64)[row[again]] % count[again]
        left, right = (own, other) if probing else (other, own)
        tile = mix((left * (1 << 31) + right).view(np.uint64) + mix(key[again].view(np.uint64))).view(np.int64)
        return np.where(count[again] > 1, tile, key[again]), row[again]

    def emit(batches: Iterator[pa.RecordBatch], probing: bool) -> Iterator[pa.RecordBatch]:
        made = Tables(*sent.value)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                x = matrix(part.column(1), dim)
                keys = np.concatenate([made.probes(x, t, moves)[:, :probes] for t in range(len(made.axes))], axis=1) if probing else stored_keys(made, x)
                key, row = tiles(keys.ravel(), np.repeat(np.arange(len(x)), keys.shape[1]), part.column(0).to_numpy(), probing)
                group = (mix(key.view(np.uint64)) % np.uint64(groups)).astype(np.int32)
                order = np.lexsort((row, group))
                row, group, key = row[order], group[order], key[order]
                start = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])))
                ends = pa.array(np.append(start, len(row)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(group[start]), part.column(0).take(pa.array(row[start])), blobs(x[row[start]]), pa.ListArray.from_arrays(ends, pa.array(key))], names=["group", "vec_id", "vector", "keys"])

    def rank(queries: pa.Table, stored: pa.Table) -> pa.Table:
        q, p = (unblob(t.column("vector"), dim) for t in (queries, stored))
        qi, pi = (t.column("vec_id").to_numpy() for t in (queries, stored))

        def unfold(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            lists = t.column("keys").combine_chunks()
            key, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(t)), np.asarray(lists.value_lengths()))
            order = np.argsort(key, kind="stable")
            return key[order], row[order]

        (qk, qr), (pk, pr) = unfold(queries), unfold(stored)
        found = []
        for key in np.intersect1d(qk, pk):
            mine, theirs = qr[np.searchsorted(qk, key) : np.searchsorted(qk, key, "right")], pr[np.searchsorted(pk, key) : np.searchsorted(pk, key, "right")]
            row, neighbour, distance = nearest(q[mine], qi[mine], p[theirs], pi[theirs], k)
            found.append((mine[row], neighbour, distance))
        if not found:
            return pa.table({"vec_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        row, neighbour, distance = (np.concatenate(x) for x in zip(*found))
        best = _merge(row, neighbour, distance, k)
        return pa.table({"vec_id": qi[row[best]], "neighbour_id": neighbour[best], "distance": distance[best]})

    kind = "group int, vec_id bigint, vector binary, keys array<bigint>"
    asked, stored = (side.mapInArrow(lambda b, p=p: emit(b, p), kind).groupBy("group") for side, p in ((searches, True), (points, False)))
    merged = asked.cogroup(stored).applyInArrow(rank, schema).distinct()
    best = merged.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id")))
    return best.where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), asking=F.col("vec_id") % QUERY_STEP == 0)
