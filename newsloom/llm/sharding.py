"""Contiguous shards of nearly equal size, from a global prefix sum.

Rows are put in a total order (identifier, checksum, size) by a range partitioning and written as a thin
table with the number of their partition. The partitions' totals (one row for each) give each
partition its offset, a running sum within the partition gives each row its place in the whole, and
the row goes to the shard in whose equal part of all bytes its middle lies. No task sees more than
one partition and a table with a row for each partition.

Cases: a null text has no bytes and size 1; null identifiers come last; equal rows are neighbours and may
be divided by a cut; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import text_or_empty
from newsloom.session import materialize


def byte_shards(docs: DataFrame, shards: int = 16, id_column: str = "doc_id") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs.

    size: bytes of the text plus 1. slot: the row's place within its shard, from 0.
    """
    text = F.to_binary(text_or_empty(), F.lit("utf-8"))
    order = [F.col("id").asc_nulls_last(), F.col("text_crc32").asc(), F.col("size").asc()]
    thin = docs.select(F.col(id_column).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    thin = materialize(thin.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ordered")

    totals = thin.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    every = Window.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = thin.withColumn("upto", F.sum("size").over(within)).withColumn("row", F.count("*").over(within)).join(offsets, "part")
    placed = placed.select("id", "size", "text_crc32", (F.col("rows_before") + F.col("row") - 1).alias("row"), F.expr(f"cast({shards} * cast(2 * (bytes_before + upto) - size as decimal(38,0)) div (2 * total) as int)").alias("shard"))
    placed = materialize(placed, "placed")
    starts = placed.groupBy("shard").agg(F.min("row").alias("start"))  # at most one row for each shard
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
