"""5. BPE encoding and decoding through a distinct-word table.

Encoding splits words in Spark, encodes each distinct word once and puts the ids back by position (see pretokens).
Decoding joins ids to their pieces: the piece table has one row for each id of the vocabulary (a fixed size, whatever
the corpus), so the join is a gather in every task, and a text's pieces are concatenated in Arrow.

Defined results: a null text gives null ids, an empty one an empty list, and both come back as they were. Repeated rows
and null doc_ids are encoded like any others, one result for each row. Other columns are ignored. Ids outside the
vocabulary decode to nothing; bytes that are no UTF-8, which only foreign ids give, decode to U+FFFD.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lattice.llm._shared import table
from lattice.llm._text import release
from lattice.llm.pretokens import TOKENIZER, Values, by_distinct_word, encoder, load_ranks

_BLOCK = 300_000


def _put_ids(chunk: pa.Table, sizes: np.ndarray, places: np.ndarray, _times: np.ndarray, values: Values) -> pa.Table:
    ends = np.zeros(len(places) + 1, dtype=np.int32)
    np.cumsum(values.lengths[places], out=ends[1:])
    ids = np.empty(ends[-1], dtype=np.int32)
    for at in range(0, len(places), _BLOCK):
        part = places[at : at + _BLOCK]
        n = values.lengths[part]
        low, high = ends[at], ends[at + len(part)]
        ids[low:high] = values.pool[np.repeat(values.starts[part] - (ends[at : at + len(part)] - low), n) + np.arange(high - low)]
    words = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    lists = pa.ListArray.from_arrays(pa.array(ends[words]), pa.array(ids), mask=pa.array(sizes < 0))
    return pa.table({"doc_id": chunk.column("doc_ids").combine_chunks().flatten(), "ids": lists})


def encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids, n_tokens) of every row; tokenizer: path of a rank file, read on the driver and sent to the executors."""
    ranks = docs.sparkSession.sparkContext.broadcast(pickle.dumps(load_ranks(tokenizer)))

    def value(words: list[str]) -> list[list[int]]:
        return list(map(encoder(ranks.value), words))

    coded = by_distinct_word(docs, value, _put_ids, "doc_id bigint, ids array<int>")
    return coded.withColumn("n_tokens", F.size(F.coalesce("ids", F.array().cast("array<int>"))))


def decode(coded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """coded (doc_id, ids, ...) with a column text, in place of one that it may have."""
    coded = coded.drop("text")
    ranks = load_ranks(tokenizer)
    pieces = coded.sparkSession.sparkContext.broadcast([p for _, p in sorted((r, b) for b, r in ranks.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.array([*pieces.value, b""], pa.binary())
        last = len(piece) - 1
        batch = lists = flat = joined = texts = None
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                lists = batch.column(batch.schema.get_field_index("ids"))
                flat = pc.fill_null(lists.flatten(), last).to_numpy(zero_copy_only=False)
                flat = np.where((flat < 0) | (flat > last), last, flat)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
                joined = pc.binary_join(pa.LargeListArray.from_arrays(ends, piece.take(pa.array(flat)).cast(pa.large_binary())), pa.scalar(b"", pa.large_binary()))
                texts = [None if null else raw.decode("utf-8", "replace") for raw, null in zip(joined.to_pylist(), lists.is_null().to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])
            del batch, lists, flat, joined, texts
            release()

    return coded.mapInArrow(run, StructType([*coded.schema.fields, StructField("text", StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes the table, and decodes what that gave: (doc_id, ids, n_tokens, text)."""
    return decode(encode(table(spark, sf_dir, "documents")))
