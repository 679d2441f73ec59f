"""Pluggable models as columns: an embedder text -> vector, a generator prompt -> text, with retries in the worker."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def with_retries(call: Callable, attempts: int = 3, wait: float = 1.0) -> Callable:
    """call, tried again after 1, 2, ... times `wait` seconds; the last error is raised."""

    def run(*args):
        for i in range(attempts):
            try:
                return call(*args)
            except Exception:
                if i + 1 == attempts:
                    raise
                time.sleep(wait * 2**i)

    return run


def embedder(embed_documents: Callable[[list[str]], list[list[float]]], attempts: int = 3, wait: float = 1.0) -> Callable[[Column], Column]:
    """A function of a text column from a model that embeds a list of texts; null texts are embedded as empty ones."""
    call = with_retries(embed_documents, attempts, wait)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in call(texts.fillna("").tolist())])

    return lambda c: run(c)


def generator(generate: Callable[[str], str], attempts: int = 3, wait: float = 1.0) -> Callable[[Column], Column]:
    """A function of a prompt column from a model that answers one prompt; null prompts give null."""
    call = with_retries(generate, attempts, wait)

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if p is None else call(p))

    return lambda c: run(c)
