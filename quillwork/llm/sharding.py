"""Contiguous shards of near equal bytes from global prefix sums.

Rows are put in order by one range shuffle of (id, size, checksum); the text itself never moves. The ordered table is
staged with the number of its partition, because the totals and the prefix sums have to see the same partitions. One small
aggregate gives the bytes and rows of each partition, their running sums give each partition's start, and a running sum
inside the partition gives each row's place. A shard is an interval of bytes: cuts lie at equal targets, and a row belongs
to the target interval in which its middle byte lies, so every shard is within one row's size of its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.llm.common import Stage


def shard(sized: DataFrame, shards: int, order: list[str], size: str = "size") -> DataFrame:
    """``sized`` with ``shard int`` (0 to shards - 1) and ``slot long`` (gapless from 0 in the shard).

    Shards are contiguous in ``order`` (nulls first). Rows equal in ``order`` stand by their other columns; full repeats are
    interchangeable. Sizes must be null or not negative; null counts as 0. Sizes summing to 0 all go to shard 0. An empty
    table gives an empty table. Columns named shard or slot are replaced.
    """
    spark = sized.sparkSession
    stage = Stage(spark, "shard")
    cols = [c for c in sized.columns if c.lower() not in ("shard", "slot")]
    rest = [c for c in cols if c not in order]
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in [*order, *rest]]
    row = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")
    ordered = sized.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage.put(ordered.select(row, F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("bytes"),
                                      F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    totals = placed.groupBy("part").agg(F.sum("bytes").alias("part_bytes"), F.count("*").alias("part_rows"))
    # one row per partition of the range shuffle: as many as Spark has tasks, never more
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("byte_start"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("row_start"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = placed.join(F.broadcast(starts), "part").select(
        "row", "all_bytes",
        (2 * (F.col("byte_start") + F.sum("bytes").over(inside)) - F.col("bytes")).alias("twice_middle"),
        (F.col("row_start") + F.row_number().over(inside) - 1).alias("place"))
    target = F.expr(f"if(all_bytes > 0, least((twice_middle * {shards}L) div nullif(2L * all_bytes, 0L), {shards - 1}L), 0L)")
    dealt = known.select("row", "place", target.cast("int").alias("shard"))
    dealt = stage.put(dealt)
    first = dealt.groupBy("shard").agg(F.min("place").alias("first"))  # at most one row per shard
    return dealt.join(F.broadcast(first), "shard").select("row.*", "shard", (F.col("place") - F.col("first")).alias("slot"))
