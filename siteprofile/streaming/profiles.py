"""Incremental counts: the same profiles over a stream of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals


def context_counts(sites: DataFrame, context: str, time: str, lateness: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """(window, context, n) of a stream of sites with an event time; rows later than lateness are dropped by the watermark, which also bounds the state."""
    return sites.withWatermark(time, lateness).groupBy(F.window(time, window), F.col(context).alias("context")).agg(F.count(F.lit(1)).alias("n"))


def position_counts(sites: DataFrame, regions: DataFrame, time: str, lateness: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """(window, position, observed) of a stream of sites around the fixed windows regions (id, chrom, start, end), which each batch meets by chromosome and bin."""
    stream = intervals.site_intervals(sites.withWatermark(time, lateness))
    joined = intervals.overlap_join(stream, regions.select("chrom", "start", "end"), left_longest=1)
    return joined.groupBy(F.window(time, window), (F.col("pos") - F.col("r_start")).alias("position")).agg(F.count(F.lit(1)).alias("observed"))
