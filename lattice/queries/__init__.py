"""The registered queries of the reference operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lattice.queries import _base, graphs, search, stores, texts  # noqa: F401

    return dict(_base.QUERIES)


def oracle_sql() -> dict[str, str]:
    from lattice.queries import _base, graphs, search, stores, texts  # noqa: F401

    return dict(_base.SQL)
