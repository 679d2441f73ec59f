"""The registered queries of the ten operators, and their SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattice.llm import ann, bpe, hnsw_dedup, license_scan, minhash_dedup, mixing, quality, sharding, token_counts, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": minhash_dedup.query,
        "op2_approximate_neighbours": ann.query,
        "op3_shard_interleaving": sharding.query,
        "op4_embedding_near_dedup": hnsw_dedup.query,
        "op5_bpe_encode_decode": bpe.query,
        "op6_url_filter": url_filter.query,
        "op7_source_mixing": mixing.query,
        "op8_token_counts": token_counts.query,
        "op9_quality_classifier": quality.query,
        "op10_license_scan": license_scan.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_shard_interleaving": sharding.SQL}
