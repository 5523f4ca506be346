"""Contiguous shards of near-equal bytes, from global prefix sums. DataFrame operations only.

Rows are dealt into ranges of doc_id; each range's total is one row, whose running sums give every range its
offset; a row's place is that offset plus the running sum within its range. Cuts fall at equal targets, and a row
belongs to the shard that holds its middle byte, so no shard is off by more than the largest row.

Defined cases: a null text has no bytes (size 8); null doc_ids come first; rows that repeat a doc_id follow each
other by size and checksum and may fall on both sides of a cut; an empty table gives an empty result; columns of
the input other than doc_id and text are ignored. Equal texts are not kept together: a third of all rows may be
copies of one text, and no shard could hold them and stay equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segloom.llm.tables import settle

#: Bytes that each row costs besides its text.
ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: slot counts from 0 within its shard, in the order of doc_id."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    order = ["doc_id", "size", "text_crc32"]
    slim = docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(slim.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))

    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each range: bounded by the number of partitions, and so are the broadcast and the single window.
    totals = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("all_bytes"),
    )
    inside = Window.partitionBy("range").orderBy(*order)
    placed = (
        dealt.join(F.broadcast(offsets), "range")
        .withColumn("start", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("rank", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"cast((2 * start + size) * {int(shards)} div (2 * all_bytes) as int)"))
        .select(*order, "shard", "rank")
    )
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(*order, "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"))
