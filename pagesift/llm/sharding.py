"""Sharding: contiguous, byte-balanced shards from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, key_of, stage, text_of


def balanced_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot): shards are contiguous in ascending id and near equal in bytes.

    A document's size is its UTF-8 bytes plus 1 (null text: 1).  Ids are range-partitioned once as narrow rows
    (no text is shuffled); per-partition byte and row totals, summed over partitions, turn the running sum
    within each partition into a global prefix sum.  A document goes to the shard in which the middle of its byte
    interval falls, so no shard differs from the target by more than one document at either end.  ``slot`` is the
    gapless rank within the shard.

    Null ids come last, repeated rows are separate documents, equal ids are ordered by size and checksum, an empty
    table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(key_of(id_col).alias("k"), (F.octet_length(text).cast("long") + 1).alias("size"),
                       F.crc32(text.cast("binary")).alias("crc"))
    rows = stage(rows.repartitionByRange("k").withColumn("part", F.spark_partition_id()), "shard-rows")
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("k").alias("first"))
    # one row per partition: a bounded window
    ahead = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes0"),
                           F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.sum("bytes").over(every).alias("total"))
    order = Window.partitionBy("part").orderBy("k", "size", "crc")
    placed = rows.join(totals, "part").select(
        "k", "size", "crc", "total",
        (F.col("bytes0") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"),
        (F.col("n0") + F.row_number().over(order) - 1).alias("rank"))
    shard = F.least(F.expr(f"((2 * before + size) * {int(shards)}) div (2 * total)"), F.lit(shards - 1)).cast("int")
    placed = placed.withColumn("shard", shard)
    starts = placed.groupBy("shard").agg(F.min("rank").alias("start"))  # at most ``shards`` rows
    return placed.join(F.broadcast(starts), "shard").select(
        id_of(F.col("k")).alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("rank") - F.col("start")).alias("slot"))
