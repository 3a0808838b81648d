"""Contiguous shards of near-equal bytes, by global prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import land

SHARDS = 8


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row for each document: ``doc_id``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents to ``shards`` contiguous runs of the order of ``doc_id``, near equal in bytes.

    Narrow rows are range-partitioned once; each partition's total goes into a global prefix sum (one
    row for each partition, so bounded by the number of partitions), and a running sum within the
    partition completes it. A document belongs to the shard in which its middle byte falls, so a
    shard misses the target by at most half a document at either end.

    Returns ``doc_id, size, text_crc32, start`` (bytes before the document), ``shard``, ``slot``
    (rank within the shard, gapless from 0).

    Defined cases: a null text counts as empty (size 1); a null id sorts first; equal ids are ordered
    by size and crc, and fully equal rows in any order, each with a slot of its own; an empty table
    gives no rows; a single document gives one shard with rows; other columns are ignored.
    """
    order = ["doc_id", "size", "text_crc32"]
    parts = land(measure(docs, id_col, text_col).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sizes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = (
        parts.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(every).alias("total"),
        )
    )
    running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        parts.withColumn("own_bytes", F.sum("size").over(running))
        .withColumn("own_row", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
        .join(F.broadcast(base), "part")
        .withColumn("start", F.col("bytes_before") + F.col("own_bytes") - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.col("own_row") - 1)
        .withColumn("shard", F.least(F.expr(f"((2 * start + size) * {shards}) div (2 * total)"), F.lit(shards - 1)).cast("int"))
        .select(*order, "start", "row", "shard")
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(*order, "start", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return balanced_shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


