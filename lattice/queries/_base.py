"""Registry of the queries and the inputs that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.operators.similarity import pairwise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LEAST = 0.3  # cosine of an edge between embeddings


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) and the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def units(spark: SparkSession, sf: str) -> DataFrame:
    """unit_id, embedding, label."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("unit_id"), "embedding", "label")


def one_query(spark: SparkSession, sf: str, unit: int = 0) -> DataFrame:
    """query_vector of one unit: a single row."""
    return units(spark, sf).where(F.col("unit_id") == unit).select(F.col("unit_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """src < dst, weight: pairs of embeddings of cosine LEAST or more. Read again and again by graph operators, so it is cut once."""
    from lattice.session import cut

    return cut(pairwise(units(spark, sf), LEAST).select("src", "dst", F.col("similarity").alias("weight")))


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).select(F.col("unit_id").alias("id"))


def r(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(*[r(c, places).alias(c) if c in columns else c for c in df.columns])


#: SQL of the shared inputs.
U = "u as (select vec_id as unit_id, embedding::double[] as v, label from embeddings)"
Q0 = "q as (select vec_id as query_id, embedding::double[] as w from embeddings where vec_id = 0)"
E = f"e as (select a.unit_id as src, b.unit_id as dst, list_cosine_similarity(a.v, b.v) as weight from u a join u b on a.unit_id < b.unit_id where list_cosine_similarity(a.v, b.v) >= {LEAST})"
BOTH = "s as (select src, dst, weight from e union all select dst, src, weight from e)"
CENTROIDS = "c as (select label, list(m order by p) as cv from (select label, p, avg(v[p]) as m from u, (select unnest(range(1, 65)) as p) group by label, p) group by label)"
WORDS = r"list_filter(string_split_regex({t}, '[ \t\n\r\f\v]+'), lambda x: x <> '')"
DOTTED = r"list_filter(string_split({t}, '.'), lambda x: regexp_replace(x, '[ \t\n\r\f\v]', '', 'g') <> '')"
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')), lambda x: x <> '')"
MD5 = "list_transform(range(0, 16), lambda i: ((instr('0123456789abcdef', substr(md5({t}), 2 * i + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(md5({t}), 2 * i + 2, 1)) - 1) / 255.0::double)"
