"""1. MinHash near-dedup: SuperMinHash signatures, banding, verification and union into groups.

A document is the set of its word 3-grams (a document of one or two words is one gram of all of them). Two documents
are near copies if the Jaccard similarity of their sets is at least `threshold`; groups are the connected components
of near copies. The steps:

1. Signatures. SuperMinHash draws, for each element, a random permutation of the m slots and a random fraction; in the
   j-th slot of its permutation the element has the value j + fraction, and a slot keeps the least value. It runs level
   by level for many documents at once: after level j no later level can change a slot that is filled, so a document
   stops as soon as all its slots are (one or two levels for long documents).
2. Documents of equal signatures are one from here on: copies by the thousand cost one row.
3. Banding. Documents sharing a band form a bucket; buckets of equal members are checked once.
4. Verification in the bucket, without listing all pairs: each member is compared with the leaders so far, then members
   of different groups with one another, so that a pair is skipped only if a chain of verified pairs joins it already.
   Estimates more than `sigmas` standard errors from the threshold decide; the pairs between go to the exact
   Jaccard similarity of the whole texts. A bucket of more than `bucket_rows` members is never one task: its parts are
   checked first, then the leaders of the parts, in parts again, and so on. Members that are then outside the bucket's
   largest component are compared with all members, tile by tile, so no pair of different components goes unchecked.
5. Union by distributed connected components.

Defined results: a null, empty or wordless text is in no group (its group_id is its doc_id). Repeated rows of one
doc_id give one row with the least group; a null doc_id gives none. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm._shared import table, written
from lattice.llm._text import as_text, mix, ngrams, pieces, release, word_hashes
from lattice.operators.components import connected_components

SHINGLE, SLOTS, BANDS, THRESHOLD, SIGMAS, BUCKET_ROWS = 3, 128, 32, 0.5, 3.0, 4096
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def superminhash(elements: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """uint64 [sets, slots]: level << 32 | fraction, the all-ones value throughout for an empty set. Repeats don't matter."""
    sets = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.full(sets * slots, _NONE, dtype=np.uint64)
    of = np.repeat(np.arange(sets), sizes)
    seed = elements
    chosen: list[np.ndarray] = []  # what each earlier level swapped its place with, by active element
    with np.errstate(over="ignore"):
        for level in range(slots):
            if not len(seed):
                break
            draw = mix(seed + _STEP * np.uint64(level + 1))
            swap = (((draw & _LOW) * np.uint64(slots - level)) >> _32).astype(np.int16) + np.int16(level)
            slot = swap
            for i in range(level - 1, -1, -1):  # Fisher-Yates without the array: follow the swaps back
                slot = np.where(chosen[i] == slot, np.int16(i), slot)
            np.minimum.at(out, of * slots + slot, (np.uint64(level) << _32) | (draw >> _32))
            chosen.append(swap)
            unfilled = (out.reshape(sets, slots) == _NONE).any(axis=1)
            going = unfilled[of]
            if not going.all():
                of, seed, chosen = of[going], seed[going], [c[going] for c in chosen]
    return out.reshape(sets, slots)


def _bands(signatures: np.ndarray, bands: int) -> np.ndarray:
    rows = signatures.shape[1] // bands
    with np.errstate(over="ignore"):
        key = np.tile(mix(np.arange(bands, dtype=np.uint64)), (len(signatures), 1))
        for r in range(rows):
            key = mix(key * np.uint64(31) + signatures[:, r::rows][:, :bands])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], shingle: int, slots: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in pieces(as_text(batch.column(1))):
            grams, offsets = ngrams(*word_hashes(texts), shingle, pad=True)
            some = np.flatnonzero(np.diff(offsets))
            if not len(some):
                continue
            signature = superminhash(grams, np.concatenate([offsets[some], offsets[-1:]]), slots)
            with np.errstate(over="ignore"):
                weight = mix(np.arange(1, slots + 1, dtype=np.uint64)) | np.uint64(1)
                whole = [mix((signature * weight).sum(axis=1, dtype=np.uint64)), mix((signature * weight[::-1]).sum(axis=1, dtype=np.uint64))]
            keys = _bands(signature, bands)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at + some)),
                    pa.array([f"{a:016x}{b:016x}" for a, b in zip(*(w.tolist() for w in whole))]),
                    _binary(mix(signature).astype(np.uint8)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel())),
                ],
                names=["doc_id", "whole", "slots", "keys"],
            )
        release()


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a uint8 matrix."""
    width = rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, rows.size + 1, width, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def signatures(docs: DataFrame, shingle: int = SHINGLE, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """(doc_id, whole, slots, keys): a hash of the whole signature, a byte of each slot, a key for each band."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(lambda b: _sign(b, shingle, slots, bands), "doc_id bigint, whole string, slots binary, keys array<bigint>")


def _bucket(rows: pd.DataFrame, threshold: float, sigmas: float, leading: bool = False) -> pd.DataFrame:
    """Edges of one bucket: sure ones as a forest, and unsure pairs between groups that it leaves apart.

    leading: the leaders too, as edges to themselves, one for each group.
    """
    ids = rows["doc_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, raw = ids[order], np.frombuffer(b"".join(rows["slots"].iloc[order]), dtype=np.uint8).reshape(len(rows), -1)
    slots = raw.shape[1]
    margin = sigmas * np.sqrt(threshold * (1 - threshold) / slots)
    parent = np.arange(len(ids))

    def similarity(i: int, others: np.ndarray) -> np.ndarray:
        same = (raw[others] == raw[i]).mean(axis=1)
        return (same - 1 / 256) / (1 - 1 / 256)  # unequal slots agree in a byte once in 256

    edges, unsure, leaders = [], [], []
    for i in range(len(ids)):
        if leaders:
            s = similarity(i, np.array(leaders))
            if s.max() >= threshold + margin:
                parent[i] = leaders[int(s.argmax())]
                edges.append((ids[parent[i]], ids[i], True))
                continue
        leaders.append(i)
    root = parent.copy()
    if len(leaders) > 1:
        for i in range(len(ids)):
            others = np.flatnonzero(root[:i] != root[i])
            while len(others):
                s = similarity(i, others)
                j = int(s.argmax())
                if s[j] < threshold + margin:
                    unsure += [(ids[k], ids[i], False) for k in others[s > threshold - margin]]
                    break
                edges.append((ids[others[j]], ids[i], True))
                root[root == root[others[j]]] = root[i]
                others = np.flatnonzero(root[:i] != root[i])
        if unsure:
            group = dict(zip(ids, root))
            unsure = [u for u in unsure if group[u[0]] != group[u[1]]]
    own = [(ids[i], ids[i], True) for i in np.unique(root, return_index=True)[1]] if leading else []
    return pd.DataFrame(edges + unsure + own, columns=["src", "dst", "sure"])


def _tile(rest: pa.Table, members: pa.Table, threshold: float, sigmas: float) -> pa.Table:
    """Edges between rows of the two sides that are in different components: a sure one for each two components, and unsure ones."""
    out: list[tuple[int, int, bool]] = []
    if len(rest) and len(members):
        (i, a, g), (j, b, h) = ((t.column("doc_id").to_numpy(), np.frombuffer(b"".join(t.column("slots").to_pylist()), dtype=np.uint8).reshape(len(t), -1), t.column("component").to_numpy()) for t in (rest, members))
        margin = sigmas * np.sqrt(threshold * (1 - threshold) / a.shape[1])
        joined: set[tuple[int, int]] = set()
        for at in range(0, len(a), 16):
            same = (a[at : at + 16, None, :] == b[None, :, :]).mean(axis=2)
            s = np.where(g[at : at + 16, None] == h[None, :], -1, (same - 1 / 256) / (1 - 1 / 256))
            for r, c in zip(*np.nonzero(s > threshold - margin)):
                pair = (int(g[at + r]), int(h[c]))
                if s[r, c] < threshold + margin:
                    out.append((int(i[at + r]), int(j[c]), False))
                elif pair not in joined:
                    joined.add(pair)
                    out.append((int(i[at + r]), int(j[c]), True))
        out = [(*sorted(e[:2]), e[2]) for e in out]
    return pa.table({"src": pa.array([e[0] for e in out], pa.int64()), "dst": pa.array([e[1] for e in out], pa.int64()), "sure": pa.array([e[2] for e in out], pa.bool_())})


_EDGE = "src bigint, dst bigint, sure boolean"


def _large_buckets(rows: DataFrame, sure: DataFrame, bucket_rows: int, threshold: float, sigmas: float) -> DataFrame:
    """Edges of the buckets (key, doc_id, slots) that are too large for a task; sure: edges known from the others."""
    found, level, before = [], rows, None
    for step in range(64):
        sizes = level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / bucket_rows))
        most = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        parted = level.join(sizes.select("key", "parts"), "key").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(step)), F.col("parts")))
        run = lambda key, r: _bucket(r, threshold, sigmas, True).assign(key=key[0])
        made = written(parted.select("key", "part", "doc_id", "slots").groupBy("key", "part").applyInPandas(run, f"{_EDGE}, key bigint"), "large")
        found.append(made.where("src <> dst").select("src", "dst", "sure"))
        if most <= bucket_rows or (before is not None and most > 0.9 * before):
            break
        before = most
        level = written(level.join(made.where("src = dst").select("key", F.col("src").alias("doc_id")), ["key", "doc_id"], "left_semi"), "leaders")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    groups = connected_components(sure.unionByName(edges.where("sure").select("src", "dst")))
    placed = written(rows.join(groups.withColumnRenamed("vertex", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "placed")
    counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("key").agg(F.max_by("component", "n").alias("largest"), F.sum("n").alias("members"), F.max("n").alias("most"))
    per = per.where("members > most").select("key", "largest", F.ceil(F.col("members") / bucket_rows).alias("parts"), F.ceil((F.col("members") - F.col("most")) / bucket_rows).alias("blocks"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    cells = placed.join(per, "key")
    columns = ["key", "block", "part", "doc_id", "slots", "component"]
    rest = cells.where("component <> largest").withColumn("block", own("blocks")).withColumn("part", spread("parts")).select(*columns)
    members = cells.withColumn("part", own("parts")).withColumn("block", spread("blocks")).select(*[F.col(c).alias(c) for c in columns])
    keys = columns[:3]
    crossed = rest.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(lambda a, b: _tile(a, b, threshold, sigmas), _EDGE)
    return edges.unionByName(crossed)


def _jaccard(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = ([np.unique(g[o[0] : o[1]]) for i in range(len(batch)) for g, o in [ngrams(*word_hashes(t.slice(i, 1)), shingle, pad=True)]] for t in (as_text(batch.column(2)), as_text(batch.column(3))))
        value = [len(np.intersect1d(a, b, assume_unique=True)) / max(1, len(np.union1d(a, b))) for a, b in zip(left, right)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value, pa.float64())], names=["src", "dst", "jaccard"])


def near_duplicate_groups(docs: DataFrame, shingle: int = SHINGLE, slots: int = SLOTS, bands: int = BANDS, threshold: float = THRESHOLD, sigmas: float = SIGMAS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, group_id, is_kept): group_id is the least doc_id of the group, which is the one document kept."""
    signed = written(signatures(docs, shingle, slots, bands), "signatures")
    exact = signed.groupBy("whole").agg(F.min("doc_id").alias("head"))
    copies = signed.join(exact, "whole").select("doc_id", "head").where("doc_id <> head").distinct()
    heads = signed.join(exact.select(F.col("head").alias("doc_id"), "whole"), ["doc_id", "whole"], "left_semi")
    keyed = heads.select("doc_id", F.explode("keys").alias("key"))
    large = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows).select("key"), "large-keys")
    some = not large.isEmpty()
    usual = keyed.join(large, "key", "left_anti") if some else keyed
    buckets = usual.groupBy("key").agg(F.array_sort(F.collect_set("doc_id")).alias("members")).where("size(members) > 1").select("members").distinct()
    members = buckets.select(F.xxhash64("members").alias("bucket"), F.explode("members").alias("doc_id"))
    rows = members.join(heads.select("doc_id", "slots"), "doc_id")
    edges = written(rows.groupBy("bucket").applyInPandas(lambda r: _bucket(r, threshold, sigmas), _EDGE).distinct(), "edges")
    if some:
        hot = written(keyed.join(large, "key", "left_semi").distinct().join(heads.select("doc_id", "slots"), "doc_id").select("key", "doc_id", "slots").dropDuplicates(["key", "doc_id"]), "large-rows")
        edges = written(edges.unionByName(_large_buckets(hot, edges.where("sure").select("src", "dst"), bucket_rows, threshold, sigmas)).distinct(), "edges")
    sure = edges.where("sure").select("src", "dst")
    unsure = edges.where("not sure").select("src", "dst").join(sure, ["src", "dst"], "left_anti")
    text = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    pairs = unsure.join(text.withColumnsRenamed({"id": "src", "text": "left_text"}), "src").join(text.withColumnsRenamed({"id": "dst", "text": "right_text"}), "dst").select("src", "dst", "left_text", "right_text")
    exactly = pairs.mapInArrow(lambda b: _jaccard(b, shingle), "src bigint, dst bigint, jaccard double").where(F.col("jaccard") >= threshold).select("src", "dst")
    links = sure.unionByName(exactly).unionByName(copies.select(F.col("head").alias("src"), F.col("doc_id").alias("dst")))
    groups = connected_components(written(links, "links")).select(F.col("vertex").alias("doc_id"), F.col("component").alias("group_id"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    return ids.join(groups, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id")).withColumn("is_kept", F.col("doc_id") == F.col("group_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without those of documents that a near copy of a lesser doc_id represents.

    Rows of a null doc_id stay. Of rows that repeat a doc_id, all columns alike or not, one stays.
    """
    groups = written(near_duplicate_groups(docs, **options).where("not is_kept").select("doc_id"), "dropped")
    kept = docs.join(groups, docs["doc_id"].cast("bigint") == groups["doc_id"], "left_anti")
    repeated = written(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("repeated_id")).count().where("count > 1").select("repeated_id"), "repeated")
    if repeated.isEmpty():
        return kept
    single = kept.join(repeated, kept["doc_id"] == repeated["repeated_id"], "left_anti")
    return single.unionByName(kept.join(repeated, kept["doc_id"] == repeated["repeated_id"], "left_semi").dropDuplicates(["doc_id"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))
