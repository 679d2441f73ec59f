"""Vectors in Arrow batches, for the two operators over embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.llm._shared import written


def usable(dim: int) -> Column:
    """Rows of an id and a vector of dim entries, none of them null, NaN or infinite."""
    v = F.col("embedding")
    return F.col("vec_id").isNotNull() & F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def clean(vectors: DataFrame, dim: int | None) -> tuple[DataFrame, int]:
    """(vec_id, embedding array<float>) of the usable rows, one for each vec_id (the least vector of repeats), and the dimension.

    dim None: the most frequent dimension of the table, the greater of equally frequent ones; 0 for an empty table.
    Vectors are shuffled only where ids repeat, and only those of repeated ids.
    """
    slim = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    if dim is None:
        sizes = slim.where("embedding is not null").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
        dim = sizes["dim"] if sizes else 0
    good = slim.where(usable(dim))
    repeated = written(good.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    if repeated.isEmpty():
        return good, dim
    least = good.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return good.join(repeated, "vec_id", "left_anti").unionByName(least), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """float32 [rows, dim] of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def blobs(rows: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    ends = np.arange(0, (len(rows) + 1) * width, max(width, 1), dtype=np.int32) if width else np.zeros(len(rows) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def unblob(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The float32 rows of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def forest(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the edges (a, b), by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            yield x, y
