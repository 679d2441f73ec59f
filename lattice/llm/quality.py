"""9. Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Words are runs of letters and digits, and runs of other signs, case kept; features are the words and word pairs of the
whole text, hashed into 2**BITS buckets; all pairs of a word with itself share a
bucket, and so do all words that equal the last but one. A feature weighs its count over the root of the text's feature count, so a
score is one sparse dot product. Training takes labelled documents, at most `max_rows` of them in the order of a hash
of doc_id, in one task; the weights (2**BITS floats, whatever the corpus) go to the executors as a broadcast.

Defined results: a null, empty or blank text scores 0 and is rejected. Without any labelled row every other document
scores 0.5 and stays. Labels that are null, and documents of a null doc_id, don't train; the latter are still scored.
Repeated rows are scored alike. Other columns are ignored here and kept by `reject`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lattice.llm._shared import table
from lattice.llm._text import as_text, ngrams, pieces, release, word_hashes

BITS, MAX_ROWS, THRESHOLD = 18, 8000, 0.5
_AGAIN, _TWICE = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95)
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.1, 3


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's words, then pairs; (buckets, offsets) of both together, grouped by text."""
    words, offsets = word_hashes(texts, signs=True)
    pairs, pair_offsets = ngrams(words, offsets, 2)
    again = np.zeros(len(words), dtype=bool)  # the word before the last comes again: one bucket for all such words
    again[2:] = words[2:] == words[:-2]
    first = np.flatnonzero(np.diff(offsets))
    again[offsets[first]] = False
    again[np.minimum(offsets[first] + 1, len(words) - 1)] = False
    twice = np.repeat(offsets[:-1] - pair_offsets[:-1], np.diff(pair_offsets)) + np.arange(len(pairs))
    pairs[words[twice] == words[np.minimum(twice + 1, len(words) - 1)]] = _TWICE
    words = np.where(again, _AGAIN, words)
    shift = np.uint64(64 - bits)
    n, m = np.diff(offsets), np.diff(pair_offsets)
    ends = np.concatenate([[0], np.cumsum(n + m)])
    out = np.empty(ends[-1], dtype=np.int32)
    out[np.arange(len(words)) + np.repeat(ends[:-1] - offsets[:-1], n)] = (words >> shift).astype(np.int32)
    out[np.arange(len(pairs)) + np.repeat(ends[:-1] + n - pair_offsets[:-1], m)] = (pairs >> shift).astype(np.int32)
    return out, ends


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def train(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by FTRL-proximal over (buckets, label) in the given order; the bias is the last entry."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    seen = []
    for buckets, label in rows:
        at, count = np.unique(buckets, return_counts=True)
        seen.append((np.append(at, size - 1), np.append(count / np.sqrt(max(1, len(buckets))), 1.0), label))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, label in seen:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            squares = n[at] + g * g
            z[at] += g - (np.sqrt(squares) - np.sqrt(n[at])) / ALPHA * w
            n[at] = squares
    return weights(slice(None)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS) -> np.ndarray:
    """Trains on labelled documents, at most max_rows. Documents and labels meet on doc_id; the first of repeats counts."""
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), F.col("quality").cast("int").alias("quality")).where("label_id is not null and quality is not null").groupBy("label_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    text = docs.select(F.col("doc_id").cast("bigint").alias("label_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = text.join(F.broadcast(chosen), "label_id")  # max_rows rows of 12 bytes

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in pieces(as_text(batch.column(1))):
                buckets, offsets = features(part, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(buckets))], names=["label_id", "quality", "buckets"])
            release()

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = [part for part in parts if len(part)]
        if not some:
            return
        group = pd.concat(some).drop_duplicates("label_id").sort_values(["place", "label_id"])
        yield pd.DataFrame({"weights": [train(list(zip(group["buckets"], group["quality"])), bits).tobytes()]})

    ready = rows.select("label_id", "text", "quality").mapInArrow(featurise, "label_id bigint, quality int, buckets array<int>").withColumn("place", F.xxhash64("label_id"))
    got = ready.repartition(1).mapInPandas(learn, "weights binary").collect()
    return np.frombuffer(got[0]["weights"], dtype=np.float32) if got else np.zeros((1 << bits) + 1, np.float32)


def score(text: Column, weights: np.ndarray, spark: SparkSession, bits: int = BITS) -> Column:
    """The probability of quality 1 for a text; only the text goes to Python and only a number comes back."""
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf(DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for batch in batches:
            scores = [np.zeros(0)]
            for _, part in pieces(as_text(batch)):
                buckets, offsets = features(part, bits)
                count = np.diff(offsets)
                logit = _sums(w[buckets], offsets) / np.sqrt(np.maximum(count, 1)) + w[-1]
                scores.append(np.where(count > 0, 1 / (1 + np.exp(-np.clip(logit, -35, 35))), 0.0))
            yield pa.array(np.concatenate(scores))
            release()

    return F.round(run(text.cast("string")), 6)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, quality_score, is_kept) of every row."""
    scored = docs.select("doc_id", score(F.col("text"), fit(docs, labels, max_rows), docs.sparkSession).alias("quality_score"))
    return scored.withColumn("is_kept", F.col("quality_score") >= threshold)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    return docs.where(score(F.col("text"), fit(docs, labels, max_rows), docs.sparkSession) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
