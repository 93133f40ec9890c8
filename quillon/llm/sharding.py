"""Contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import documents, stored

#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Places every row by the law ``bytes``: rows in the order of (doc_id, checksum, size), cut at equal byte targets.

    Only narrow rows (id, size, checksum) move, never texts: they are range-partitioned, stored once, and one total
    per partition gives each partition's offset (the only rows that meet are one per partition). Inside a partition
    a running sum goes on from there. A row belongs to the shard in which its middle byte falls, so sizes differ from
    total/shards by less than the largest row; with huge rows a shard may stay empty.

    Null text counts as no bytes with checksum 0; null ids come first; repeated rows keep one place each; an empty
    table gives an empty result. Other columns don't matter.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents(docs).select("doc_id", (F.octet_length(raw) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(narrow.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: the one place where rows of all partitions meet.
    offsets = totals.select(
        F.col("part").alias("p"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.withColumns({"b": F.coalesce(F.sum("size").over(within), F.lit(0)), "r": F.count(F.lit(1)).over(within)})
        .join(F.broadcast(offsets), F.col("part") == F.col("p"))
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("b")) + F.col("size"))
        .select(*order, (F.col("rows_before") + F.col("r")).alias("row"), F.expr(f"cast(middle * {shards} div (2 * total) as int)").alias("shard"))
    )
    placed = stored(placed)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
