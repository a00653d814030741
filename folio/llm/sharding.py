"""Contiguous shards of near-equal bytes, from global prefix sums of sizes.

Rows are range-partitioned by id and each partition keeps running sums of its own rows. Only one total for each
partition is summed over partitions; adding a partition's offset to its running sums gives every row its global
position, and cutting the byte axis at equal targets gives the shards. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import cut, read, whole

#: Bytes that each row takes besides its text.
ROW_BYTES = 8


def assign_shards(docs: DataFrame, shards: int = 24, partitions: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, first_byte of each row of docs.

    A row belongs to the shard in which its first byte falls, in the order of doc_id (nulls first; rows of one id by
    size and checksum), so that shards differ by less than two rows' bytes. slot counts a shard's rows from 0.
    Null text: no bytes, checksum 0. Rows equal in all three columns share a range and get neighbouring places.
    An empty table gives no rows. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("doc_id", "size", "text_crc32")
    sized = docs.select("doc_id", (F.octet_length(whole("text")) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(whole("text")).alias("text_crc32"))
    part = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Written once: the ranges come from a sample, so both uses below must see the same ones.
    local = cut(sized.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()).withColumns({"bytes_to": F.sum("size").over(part), "rows_to": F.row_number().over(part).cast("long")}))

    # One row for each range partition, so a single task and a broadcast hold at most `partitions` rows.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("part").agg(F.max("bytes_to").alias("bytes"), F.max("rows_to").alias("rows"))
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    first_byte = F.col("bytes_before") + F.col("bytes_to") - F.col("size")
    placed = local.join(F.broadcast(offsets), "part").select(*order, first_byte.alias("first_byte"), (F.col("rows_before") + F.col("rows_to") - 1).alias("row"), (F.expr(f"(bytes_before + bytes_to - size) * {shards} div all_bytes")).cast("int").alias("shard"))
    starts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row for each shard
    return placed.join(F.broadcast(starts), "shard").select(*order, "shard", (F.col("row") - F.col("first_row")).alias("slot"), "first_byte")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "first_byte")
