"""3. Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; a row of rank r among n has the fractional rank
(r - 1/2) / n. All rows in the order of their fractional ranks interleave the sources in proportion, so cutting that
order into equal runs gives shards that each match the mixture to within a row or so per source.

Both rankings are distributed: rows fall into cells by the hash (for the rank in a source) and by the fractional rank
(for the place overall), whose sizes are summed up in a small table of counts; a window then only ranks the rows of one
cell. A hot source is as many cells as its share, so no task holds a whole source. Only keys are shuffled, not texts.

Defined results: every input row gets one result row. A null source is a source of its own; null doc_ids and repeated
rows are ordered among themselves arbitrarily but stay whole in number. An empty table gives no rows; more shards than
rows leave shards empty. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattice.llm._shared import table, written

SEED, SHARDS, CELL_ROWS = "lattice", 64, 100_000


def _ranks(rows: DataFrame, group: list[str], cell: str, order: list[str], name: str) -> DataFrame:
    """rows with a 1-based rank by (cell, *order) within group, by sizes of cells and ranks inside them."""
    keys = [*group, cell]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    inside = rows.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    match = [inside[k].eqNullSafe(before[k]) for k in keys]
    joined = inside.join(before, match)
    return joined.select(*[inside[c] for c in rows.columns], (F.col("_before") + F.col("_inside")).alias(name))


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, source, shard, place): place counts from 0 within the shard."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"))
    hashed = ids.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    totals = written(hashed.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "sources")
    everything = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    uniform = F.conv(F.substring("draw", 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    sized = hashed.join(totals.withColumnRenamed("source", "of"), hashed["source"].eqNullSafe(F.col("of"))).drop("of")
    rows = sized.withColumn("cell", F.floor(uniform * F.ceil(F.col("n") / F.lit(cell_rows))).cast("bigint"))
    ranked = _ranks(rows, ["source"], "cell", ["draw", "doc_id"], "rank").drop("cell")
    fraction = written(ranked.withColumn("fraction", (F.col("rank") - 0.5) / F.col("n")), "ranked")
    cells = max(1, -(-everything // cell_rows))
    wide = fraction.withColumn("cell", F.floor(F.col("fraction") * F.lit(cells)).cast("bigint")).withColumn("all", F.lit(0))
    placed = _ranks(wide, ["all"], "cell", ["fraction", "source", "draw", "doc_id"], "position")
    last = F.col("position") - 1
    shard = F.floor(last * F.lit(shards) / F.lit(max(1, everything))).cast("int")
    first = F.ceil(shard.cast("bigint") * F.lit(everything) / F.lit(shards)).cast("bigint")
    return placed.select("doc_id", "source", shard.alias("shard"), (last - first).alias("place"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


SQL = f"""
with h as (
  select doc_id, source, md5('{SEED}:' || cast(doc_id as varchar)) as draw from documents
), r as (
  select *, (row_number() over (partition by source order by draw, doc_id) - 0.5::double)
            / (count(*) over (partition by source))::double as fraction from h
), p as (
  select *, row_number() over (order by fraction, source, draw, doc_id) - 1 as position, count(*) over () as n from r
), s as (
  select *, cast(floor(position * {SHARDS} / n::double) as integer) as shard from p
)
select doc_id, source, shard, cast(position - ceil(cast(shard as bigint) * n / {SHARDS}.0::double) as bigint) as place from s
"""
