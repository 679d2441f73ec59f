"""Tables written to the shared folder, and the input tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lattice.session import table_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back: lineage is cut and later reads prune columns."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repeatable(df: DataFrame, name: str) -> DataFrame:
    """df itself if its rows come in the same order again when a task is run again, as from files; else written first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return written(df, name) if re.search(r"Exchange|InMemoryTableScan|Python|Pandas|InArrow|ExistingRDD", plan) else df


def plan_bytes(df: DataFrame) -> int:
    """What the optimizer takes for the size of the rows: the files' size for a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
