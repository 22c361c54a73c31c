"""Rows beside each other in an order: windows over blocks of it, and a table of block ends that carries over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import checkpoint

#: Whole numbers of an order that make a block.
BLOCK = 65_536


def beside(rows: DataFrame, part: list[str], order: list[str], columns: list[str], block: int = BLOCK) -> DataFrame:
    """rows with prev and next, structs of the columns of the row before and after within the part; null at its ends.

    order: a whole number (a row number, a position), then columns that break ties. A window runs over one block of the
    number, so a part of any length is spread over many tasks. The first and last row of each block, a row a block, meet
    in windows over BLOCK blocks; only these groups' ends, a row for BLOCK * BLOCK numbers, are put in order by part. Parts
    are not null; a null number is in a block of its own, which nothing follows.
    """
    keys = [*part, "_block"]
    take, place = F.struct(*columns), F.struct(*order)
    blocked = rows.withColumn("_block", F.floor(F.col(order[0]) / block))
    inside = Window.partitionBy(*keys).orderBy(*order)
    near = blocked.withColumn("prev", F.lag(take).over(inside)).withColumn("next", F.lead(take).over(inside))
    edges = blocked.groupBy(*keys).agg(F.min_by(take, place).alias("_first"), F.max_by(take, place).alias("_last"))
    edges = edges.withColumn("_super", F.floor(F.col("_block") / block))
    w = Window.partitionBy(*part, "_super").orderBy("_block")
    edges = edges.withColumn("_before", F.lag("_last").over(w)).withColumn("_after", F.lead("_first").over(w))
    ends = edges.groupBy(*part, "_super").agg(F.min_by("_first", "_block").alias("_f"), F.max_by("_last", "_block").alias("_l"))
    w = Window.partitionBy(*part).orderBy("_super")
    ends = ends.select(*part, "_super", F.lag("_l").over(w).alias("_b"), F.lead("_f").over(w).alias("_a"))
    carried = edges.join(ends, [*part, "_super"]).select(*keys, F.coalesce("_before", "_b").alias("_before"), F.coalesce("_after", "_a").alias("_after"))
    joined = near.join(carried, keys, "left")
    return joined.withColumn("prev", F.coalesce("prev", "_before")).withColumn("next", F.coalesce("next", "_after")).drop("_block", "_before", "_after")


def text_after(rows: DataFrame, order: str, text: str, length: int) -> DataFrame:
    """rows with after: the first length letters of the texts that follow in the order, joined; texts are not empty.

    The rows are range partitioned and kept so; a window runs over each partition, and what its first rows start with,
    a row a partition, is carried over to those before it.
    """
    ranged = checkpoint(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p").orderBy(order)
    ahead = F.concat(*[F.coalesce(F.lead(text, i).over(inside), F.lit("")) for i in range(1, length + 1)])
    near = ranged.withColumn("_in", ahead).withColumn("_r", F.row_number().over(inside))
    firsts = near.where(F.col("_r") <= length).groupBy("_p").agg(F.array_sort(F.collect_list(F.struct("_r", F.col(text).alias("t")))).alias("_s"))
    firsts = firsts.select("_p", F.left(F.array_join(F.col("_s.t"), ""), F.lit(length)).alias("_t"))
    partitions = Window.partitionBy(F.lit(0)).orderBy("_p")  # a row for each partition of the range
    starts = F.concat(*[F.coalesce(F.lead("_t", i).over(partitions), F.lit("")) for i in range(1, length + 1)])
    joined = near.join(F.broadcast(firsts.select("_p", starts.alias("_next"))), "_p")
    return joined.withColumn("after", F.left(F.concat("_in", "_next"), F.lit(length))).drop("_p", "_in", "_r", "_next")
