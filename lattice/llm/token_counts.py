"""8. Token counts: pieces counted once per distinct pre-token, joined to each document's pre-token frequencies, summed.

Token ids are never materialised for a document. See pretokens for how distinct words and chunks meet.

Defined results: a null text and an empty one have 0 pre-tokens and 0 tokens. Every row counts, repeated ones and those
of a null doc_id too. Other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lattice.llm._shared import table
from lattice.llm.pretokens import TOKENIZER, Values, by_distinct_word, encoder, load_ranks


def _put_counts(chunk: pa.Table, sizes: np.ndarray, places: np.ndarray, times: np.ndarray, values: Values) -> pa.Table:
    pieces = values.pool[values.starts].astype(np.int64)  # one count a word
    ends = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    words = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])
    tokens = np.concatenate([[0], np.cumsum(pieces[places] * times)])
    return pa.table({"doc_id": chunk.column("doc_ids").combine_chunks().flatten(), "n_pretokens": np.diff(words[ends]), "n_tokens": np.diff(tokens[ends])})


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every row."""
    ranks = docs.sparkSession.sparkContext.broadcast(pickle.dumps(load_ranks(tokenizer)))

    def value(words: list[str]) -> list[list[int]]:
        one = encoder(ranks.value)
        return [[len(one(w))] for w in words]

    return by_distinct_word(docs, value, _put_counts, "doc_id bigint, n_pretokens bigint, n_tokens bigint", frequencies=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
