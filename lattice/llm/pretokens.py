"""Texts as chunks of pre-token indices, and the distinct-word table, for BPE encoding (5) and token counts (8).

Spark splits each text into pre-tokens with the tokenizer's own pattern (a JVM expression). A Python pass over Arrow
batches turns a batch into one *chunk* row: its distinct words, and its texts as compressed indices into them. Chunks
are shuffled once, by chunk; both branches below read that one exchange:

* words: a chunk's distinct words, cut by a hash of the word into buckets and sorted there, go to the bucket's task. It
  has all rows of its words, so it makes its part of the distinct-word table, handles each word once and joins the
  values back to each chunk's words, in their order;
* texts: met by chunk with those values, which are put in place by position.

So what is shuffled by word is a chunk's distinct words, compressed, not its occurrences; and no table grows in one place: the
distinct-word table has a part for each BUCKET_BYTES of input, never broadcast or collected.

A chunk is named by its place and content, and a task that is run again after a loss must make the same chunks. So rows
whose order may change, such as those of a shuffle, are written to the shared folder first.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm._shared import plan_bytes, repeatable
from lattice.llm._text import release, span_hashes

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The byte-level BPE pre-token pattern; white space is Unicode's, as (?U) makes it in Java.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""
CHUNK_BYTES = 8 << 20
#: Input for which a part of the distinct-word table is made at least, and one of the shuffle of chunks.
BUCKET_BYTES, PART_BYTES = 64 << 20, 16 << 20
_CHUNK = "chunk bigint, doc_ids array<bigint>, words binary, lengths binary, sizes binary, places binary, times binary"


def load_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoder(pickled_ranks: bytes) -> Callable[[str], list[int]]:
    """Encodes one pre-token; the tokenizer is built once per Python worker, so it is kept in a module that stays loaded."""
    import tiktoken

    kept = vars(tiktoken).setdefault("_kept", {})
    name = hashlib.md5(pickled_ranks).digest()
    if name not in kept:
        kept[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pickle.loads(pickled_ranks), special_tokens={})
    return kept[name]._encode_single_piece


def _squeeze(values: np.ndarray) -> bytes:
    """int32 values as zstd over their byte planes."""
    planes = np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _spread(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()


def _pack(batches: Iterator[pa.RecordBatch], frequencies: bool) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    number = 0
    for batch in batches:
        lists = batch.column(1)
        sizes = pc.list_value_length(lists)  # null: the text is null
        weight = np.cumsum(pc.fill_null(batch.column(2), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
            coded = lists.slice(at, to - at).flatten().dictionary_encode()
            count = pc.fill_null(sizes.slice(at, to - at), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            place, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            alphabetic = pc.sort_indices(words).to_numpy()  # neighbours alike compress well
            often = alphabetic[np.argsort(-np.bincount(place, minlength=len(words))[alphabetic], kind="stable")]  # frequent words get small indices
            rank = np.empty(len(words), dtype=np.int32)
            rank[often] = np.arange(len(words), dtype=np.int32)
            place, times = rank[place], np.zeros(0, dtype=np.int32)
            if frequencies:
                text = np.repeat(np.arange(len(count), dtype=np.int64), np.maximum(count, 0))
                pair, times = np.unique(text * max(1, len(words)) + place, return_counts=True)
                place = (pair % max(1, len(words))).astype(np.int32)
                count = np.where(count < 0, -1, np.bincount(pair // max(1, len(words)), minlength=len(count))).astype(np.int32)
            blob = _squeeze(place)
            name = int.from_bytes(hashlib.md5(f"{part}-{number}-".encode() + blob + count.tobytes()).digest()[:8], "little", signed=True)
            ordered = words.take(pa.array(often))
            spelled, lengths = _spell(ordered)
            number += 1
            ids = batch.column(0).slice(at, to - at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([spelled]), pa.array([lengths]), pa.array([_squeeze(count)]), pa.array([blob]), pa.array([_squeeze(times)])],
                names=["chunk", "doc_ids", "words", "lengths", "sizes", "places", "times"],
            )
            at = to
            release()


def _words(spelled: bytes, lengths: bytes) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(_spread(lengths))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(zstandard.ZstdDecompressor().decompress(spelled))])


def _spell(words: pa.Array) -> tuple[bytes, bytes]:
    return zstandard.ZstdCompressor(level=3).compress("".join(words.to_pylist()).encode()), _squeeze(pc.binary_length(words).to_numpy(zero_copy_only=False))


def _in_buckets(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by bucket, then alphabet, and the bucket of each so ordered."""
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], dtype=np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    bucket = (span_hashes(raw, ends[:-1], ends[1:]) % np.uint64(buckets)).astype(np.int32)
    alphabetic = pc.sort_indices(words).to_numpy()
    order = alphabetic[np.argsort(bucket[alphabetic], kind="stable")]
    return order, bucket[order]


def _list_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            words = _words(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
            order, bucket = _in_buckets(words, buckets)
            words = words.take(pa.array(order))
            some, first = np.unique(bucket, return_index=True)
            parts = [_spell(words.slice(a, b - a)) for a, b in zip(first, [*first[1:], len(words)])]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), batch.column(0)[i].as_py())), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], names=["bucket", "chunk", "words", "lengths"])
            del words, parts
            release()


@dataclass(frozen=True)
class Values:
    """A list of int32 for each word of a chunk, by the word's index: pool[starts[i] : starts[i] + lengths[i]]."""

    pool: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def by_distinct_word(docs: DataFrame, value: Callable[[list[str]], list[list[int]]], put: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray, Values], pa.Table], schema: str, frequencies: bool = False) -> DataFrame:
    """value: distinct words -> a list of integers for each; put: (chunk, sizes, places, times, values) -> its rows."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = repeatable(slim, "texts")
    size = plan_bytes(docs if made is slim else made)
    docs, text, partitions = made, F.col("text"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = docs.select("doc_id", F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0)).alias("words"), F.length(text).cast("bigint").alias("size"))
    chunks = split.mapInArrow(lambda b: _pack(b, frequencies), _CHUNK).repartition(max(partitions, size // PART_BYTES), "chunk")
    buckets = max(partitions, size // BUCKET_BYTES)
    words = chunks.mapInArrow(lambda b: _list_words(b, buckets), "bucket int, chunk bigint, words binary, lengths binary")

    def handle(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        lists = [_words(w.as_py(), n.as_py()) for w, n in zip(rows.column("words"), rows.column("lengths"))]
        coded = pa.concat_arrays([x.cast(pa.large_string()) for x in lists]).dictionary_encode()
        found = value(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        pool = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))
        of, sizes, pools, at = coded.indices.to_numpy(zero_copy_only=False), [], [], 0
        for words in lists:
            part = of[at : at + len(words)]
            at += len(words)
            n = lengths[part]
            sizes.append(_squeeze(n))
            pools.append(_squeeze(pool[np.repeat(starts[part] - (np.cumsum(n, dtype=np.int64) - n), n) + np.arange(int(n.sum()))]))
        release()
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "lengths": pa.array(sizes, pa.binary()), "pool": pa.array(pools, pa.binary())})

    values = words.groupBy("bucket").applyInArrow(handle, "chunk bigint, bucket int, lengths binary, pool binary")

    def place(chunk: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("bucket")
        nothing = [np.zeros(0, np.int32)]
        sizes = np.concatenate([*nothing, *(_spread(b.as_py()) for b in found.column("lengths"))])
        pool = np.concatenate([*nothing, *(_spread(b.as_py()) for b in found.column("pool"))])
        parts = []
        for i in range(len(chunk)):  # one row
            row = chunk.slice(i, 1)
            order, _ = _in_buckets(_words(row.column("words")[0].as_py(), row.column("lengths")[0].as_py()), buckets)
            lengths, starts = np.empty(len(order), np.int32), np.empty(len(order), np.int64)
            lengths[order], starts[order] = sizes, np.cumsum(sizes, dtype=np.int64) - sizes
            parts.append(put(row, *(_spread(row.column(c)[0].as_py()) for c in ("sizes", "places", "times")), Values(pool, starts, lengths)))
        release()
        return pa.concat_tables(parts)

    return chunks.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(place, schema)
