"""Sharding by proportional stratified interleaving.

Rows are ranked within their stratum (the source) in a seeded random order, ordered by fractional rank
(rank + 1/2) / stratum size, and cut into equal runs. Every run then holds each stratum in proportion, to
within a row, and the shards' counts are at most one apart (law "rows"). Both rankings are distributed running
totals over narrow rows; no stratum meets in one task, whatever its share.

Cases: a null source is a stratum of its own; ties in the seeded order go by doc_id (null first), then text
checksum; equal rows are interchangeable; an empty table gives no rows; extra columns pass through,
but for earlier columns named shard or slot, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import group_key, running_totals


def seeded(seed: int, *columns: Column) -> Column:
    """A pseudo-random order key that any engine with MD5 can rebuild."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


def interleave(rows: DataFrame, n_shards: int, stratum: str = "source", ties: Sequence[str] = ("doc_id",), seed: int = 7) -> DataFrame:
    """rows with shard int (0 to n_shards - 1) and slot long (gapless from 0 in each shard) added."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    rows = rows.drop("shard", "slot")
    names = rows.columns
    keyed = rows.withColumn("__s", group_key(F.col(stratum))).withColumn("__h", seeded(seed, *[F.col(t) for t in ties]))
    order = [F.col("__h"), *[F.col(t) for t in ties]]
    ranked = running_totals(keyed, F.col("__s"), order, F.lit(1), "__rank")
    spread = ranked.withColumn("__f", (F.col("__rank_before") + 0.5) / F.col("__rank_all"))
    placed = running_totals(spread, None, [F.col("__f"), F.md5("__s"), *order], F.lit(1), "__row")
    base, more = F.floor(F.col("__row_all") / n_shards), F.col("__row_all") % n_shards
    row, large = F.col("__row_before"), more * (base + 1)
    shard = F.when(row < large, F.floor(row / (base + 1))).otherwise(more + F.floor((row - large) / F.greatest(base, F.lit(1))))
    first = F.when(F.col("shard") <= more, F.col("shard") * (base + 1)).otherwise(large + (F.col("shard") - more) * base)
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (row - first).cast("long")).select(*names, "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder for each shard, rows in slot order within each file."""
    sharded.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = interleave(rows, 16, "source", ("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op4_sharding": op4_sharding}
