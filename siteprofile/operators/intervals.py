"""Interval operators. Intervals are 0-based and half-open: start, end. Sites are 1-based: pos covers [pos - 1, pos)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ordered

#: A region table with at most so many rows is broadcast; the count is taken first.
BROADCAST_REGIONS = 20_000
#: Bins of a level are so many times as long as those of the level below; there are LEVELS levels.
WIDER, LEVELS = 4, 14


def site_intervals(sites: DataFrame) -> DataFrame:
    """Sites with start = pos - 1 and end = pos."""
    return sites.withColumn("start", F.col("pos") - 1).withColumn("end", F.col("pos"))


def windows(regions: DataFrame, centre: Column, left: int, right: int, least_start: int = 1) -> DataFrame:
    """Regions with center and the window [centre - left, centre + right); windows that start before least_start go."""
    made = regions.withColumn("center", centre).withColumn("start", F.col("center") - left).withColumn("end", F.col("center") + right)
    return made.where(F.col("start") >= least_start)


def overlap_width(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.least(b, d) - F.greatest(a, c)


def level(start: Column, end: Column, bin_size: int) -> Column:
    """The lowest level whose bins are at least as long as the interval, which then touches two of them at most."""
    return sum(((end - start) > bin_size * WIDER**i).cast("int") for i in range(LEVELS - 1)).cast("int")


def bins(start: Column, end: Column, at: Column, bin_size: int) -> Column:
    """Numbers of the bins of a level that an interval touches."""
    size = F.lit(bin_size) * F.pow(F.lit(WIDER), at).cast("long")
    return F.sequence(F.floor(start / size), F.floor((F.greatest(end, start + 1) - 1) / size))


def levels_of(intervals: DataFrame, bin_size: int, longest: int | None) -> tuple[list[int], int | None]:
    """The levels that intervals may have, by their longest length where it is known, else from one aggregation, which also counts them."""
    if longest is not None:
        return list(range(1 + sum(longest > bin_size * WIDER**i for i in range(LEVELS - 1)))), None
    row = intervals.agg(F.sort_array(F.collect_set(level(F.col("start"), F.col("end"), bin_size))).alias("l"), F.count(F.lit(1)).alias("n")).first()
    return list(row.l), row.n


def overlap_join(
    left: DataFrame, right: DataFrame, how: str = "inner", bin_size: int = 1024, broadcast: bool | None = None,
    left_longest: int | None = None, right_longest: int | None = None,
) -> DataFrame:
    """Pairs of intervals on one chrom that share a base, with overlap, their shared width.

    Both sides have chrom, start and end; the right side's three come out as r_chrom, r_start and r_end, its other columns
    must be named apart. how: inner, or left (left rows without a partner have overlap 0). Bins are nested: those of a level
    are WIDER times as long as those below. An interval belongs to the lowest level with bins as long as itself, where it
    touches one or two. Of a pair the shorter one is looked up at the level of the longer one, so the join is on
    (chrom, level, bin), a long chromosome is spread over many tasks, and an interval of any length makes at most two rows
    for each level that the other side has. A pair that shares two bins is taken from that of its first shared base.

    left_longest, right_longest: the longest interval of a side, where the caller knows it (1 for sites); else one aggregation
    of that side finds its levels. Regions that a count shows to be few are broadcast (broadcast: None decides by the count).
    Intervals without a start, end or chrom meet nothing.
    """
    l_levels, _ = levels_of(left, bin_size, left_longest)
    r_levels, n = levels_of(right, bin_size, right_longest)
    right = right.withColumnRenamed("chrom", "r_chrom").withColumnRenamed("start", "r_start").withColumnRenamed("end", "r_end")
    width = overlap_width(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    if broadcast is None:
        n = right.limit(BROADCAST_REGIONS + 1).count() if n is None else n
        broadcast = n <= BROADCAST_REGIONS
    hint = F.broadcast if broadcast else lambda df: df

    l_own, r_own = level(F.col("start"), F.col("end"), bin_size), level(F.col("r_start"), F.col("r_end"), bin_size)

    def placed(rows: DataFrame, side: str, own: Column, at: list[int], may_be: list[int], holds) -> DataFrame:
        """rows once for each bin that they touch at those of the levels at for which holds(level, own level)."""
        start, end = F.col(f"{side}start"), F.col(f"{side}end")
        if len(at) == 1 and all(holds(at[0], x) for x in may_be):
            rows = rows.withColumn(f"_{side}level", F.lit(at[0]))
        else:
            asked = F.array_compact(F.array(*[F.when(holds(F.lit(x), own), F.lit(x)) for x in at]))
            rows = rows.withColumn(f"_{side}level", F.explode(asked))
        return rows.withColumn(f"_{side}bin", F.explode(bins(start, end, F.col(f"_{side}level"), bin_size)))

    def meet(at: list[int], l_holds, r_holds) -> DataFrame:
        l, r = placed(left, "", l_own, at, l_levels, l_holds), placed(right, "r_", r_own, at, r_levels, r_holds)
        first = F.floor(F.greatest("start", "r_start") / (F.lit(bin_size) * F.pow(F.lit(WIDER), F.col("_level")).cast("long")))
        on = (F.col("chrom") == F.col("r_chrom")) & (F.col("_level") == F.col("_r_level")) & (F.col("_bin") == F.col("_r_bin"))
        return l.join(hint(r), on & (width > 0) & (F.col("_bin") == first)).drop("_level", "_bin", "_r_level", "_r_bin")

    # At the right interval's level, where the left one's is not above it; else at the left one's.
    found = meet(r_levels, lambda x, own: x >= own, lambda x, own: x == own)
    if any(a > b for a in l_levels for b in r_levels):
        found = found.unionByName(meet(l_levels, lambda x, own: x == own, lambda x, own: x > own))
    found = found.withColumn("overlap", width)
    if how == "inner":
        return found
    # A left interval asks, at each level that is its own or above, whether any of its two bins has a partner.
    alone = left
    for at in sorted({*l_levels, *r_levels}):
        asked = placed(right, "r_", r_own, [at], r_levels, lambda x, own: x >= own)
        asked = hint(asked.select("r_chrom", "r_start", "r_end", "_r_bin"))
        size = bin_size * WIDER**at
        ends = [F.floor(F.col("start") / size), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / size)]
        for end in ends[: 1 if left_longest is not None and left_longest <= 1 else 2]:
            on = (F.col("chrom") == F.col("r_chrom")) & (F.when(l_own <= at, end) == F.col("_r_bin"))
            alone = alone.join(asked, on & (width > 0), "left_anti")
    none = [F.lit(None).cast(t).alias(c) for c, t in right.dtypes]
    return found.unionByName(alone.select("*", *none, F.lit(0).cast("long").alias("overlap")))


def chromosome_ends(sizes: DataFrame, span: int = 30_000, zero_based: bool = False) -> DataFrame:
    """chrom, start, end, part of the ends of each chromosome (part end) and what lies between (part middle); sizes has chrom and len. zero_based: the first end starts at 0, not 1."""
    first = 0 if zero_based else 1
    parts = F.array(
        F.struct(F.lit(first).cast("long").alias("start"), F.lit(span + 1).cast("long").alias("end"), F.lit("end").alias("part")),
        F.struct((F.col("len") - span).alias("start"), F.col("len").alias("end"), F.lit("end").alias("part")),
        F.struct(F.lit(span + 2).cast("long").alias("start"), (F.col("len") - span - 1).alias("end"), F.lit("middle").alias("part")),
    )
    return sizes.select("chrom", F.explode(parts).alias("p")).select("chrom", "p.*")


def equi_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of tracks with one row per base on the same keys (open and closed sites, mappability)."""
    return left.join(right, keys)


def neighbours(windows_: DataFrame, order: str | list[str] = "row") -> DataFrame:
    """Each interval with the one before and after it on its chrom: prev_start, prev_end, next_start, next_end.

    order: the number of the row in the input, or a position and what breaks its ties.
    """
    near = ordered.beside(windows_, ["chrom"], [order] if isinstance(order, str) else order, ["start", "end"])
    return near.select(*windows_.columns, *[F.col(side)[c].alias(f"{side}_{c}") for c in ("start", "end") for side in ("prev", "next")])


def clean_overlaps(intervals: DataFrame, order: str | list[str] = "row") -> DataFrame:
    """Where an interval reaches into the next on its chrom, both are cut in the middle of what they share."""
    near = neighbours(intervals, order)
    half = lambda a, b: F.floor((a - b) / 2)
    end = F.when(F.col("end") >= F.col("next_start"), F.col("end") - half(F.col("end"), F.col("next_start"))).otherwise(F.col("end"))
    start = F.when(F.col("prev_end") >= F.col("start"), F.col("start") + half(F.col("prev_end"), F.col("start"))).otherwise(F.col("start"))
    return near.withColumn("_s", start).withColumn("end", end).withColumn("start", F.col("_s")).drop("_s", "prev_start", "prev_end", "next_start", "next_end")


def neighbour_signal(wide: DataFrame, inner_left: int = 73, inner_right: int = 74, order: str = "row") -> DataFrame:
    """offset and n: how often the inner part of one window covers each offset of the next or previous wide window on its chrom.

    wide has chrom, center, start, end (start = center - half, end = center + half). An inner part that reaches the next
    wide window covers its first offsets; one that starts within the previous wide window covers its last ones. The last row
    of the input starts no comparison.
    """
    size = F.col("end") - F.col("start")
    last_row = wide.agg(F.max(order).alias("_last"))
    near = neighbours(wide, order).crossJoin(F.broadcast(last_row)).where(F.col(order) < F.col("_last"))  # one row
    ahead = F.col("center") + inner_right - F.col("next_start")
    behind = size - F.col("prev_end") + F.col("center") - inner_left
    none = F.array().cast("array<bigint>")
    first = F.when(ahead > 0, F.sequence(F.lit(0).cast("long"), ahead - 1)).otherwise(none)
    last = F.when((F.col("center") - inner_left <= F.col("prev_end")) & (behind < size), F.sequence(behind, size - 1)).otherwise(none)
    return near.select(F.explode(F.concat(first, last)).alias("offset")).groupBy("offset").agg(F.count(F.lit(1)).alias("n"))


def coverage_signal(wide: DataFrame, width: int = 400, order: str = "row") -> DataFrame:
    """(offset, signal) for each offset of a wide window: neighbour_signal() over the number of windows, and 1 where no neighbour reaches."""
    n = wide.agg(F.count(F.lit(1)).alias("_n"))  # one row
    counted = neighbour_signal(wide, order=order).crossJoin(F.broadcast(n)).select("offset", (F.col("n") / F.col("_n")).alias("signal"))
    return wide.sparkSession.range(width).select(F.col("id").alias("offset")).join(counted, "offset", "left").na.fill(1.0, ["signal"])


def islands(values: DataFrame, part: list[str], value: str, block: int = ordered.BLOCK) -> DataFrame:
    """Runs of consecutive whole numbers in each part: first, last, n. Values that repeat count once.

    Runs are found inside blocks of the number, so a part of any length is spread over many tasks. Each block is sorted once and
    read in that order by windows that look one row back or ahead, so a task holds what its sort does and no table of runs. Of
    each block only a run at its first and one at its last number can go on in the next; these, two a block, are joined by a
    window over the part.
    """
    inside = Window.partitionBy(*part, "_block").orderBy(value)
    near = lambda f: f(value).over(inside)
    blocked = values.select(*part, value).where(F.col(value).isNotNull()).withColumn("_block", F.floor(F.col(value) / block))
    once = blocked.withColumn("_before", near(F.lag)).where(F.col("_before").isNull() | (F.col("_before") != F.col(value)))
    marked = once.withColumn("_after", near(F.lead))
    marked = marked.withColumn("_first", F.coalesce(F.col("_before") != F.col(value) - 1, F.lit(True))).withColumn("_last", F.coalesce(F.col("_after") != F.col(value) + 1, F.lit(True)))
    bounds = marked.where(F.col("_first") | F.col("_last"))
    runs = bounds.withColumn("last", F.when(F.col("_last"), F.col(value)).otherwise(near(F.lead))).where("_first").withColumnRenamed(value, "first")
    runs = runs.select(*part, "_block", "first", "last", (F.col("last") - F.col("first") + 1).cast("long").alias("n"))
    low = F.col("_block") * block
    at_end = (F.col("first") == low) | (F.col("last") == low + block - 1)
    w = Window.partitionBy(*part).orderBy("first")
    ends = runs.where(at_end).withColumn("_new", F.coalesce(F.col("first") != F.lag("last").over(w) + 1, F.lit(True)).cast("int"))
    joined = ends.withColumn("_run", F.sum("_new").over(w)).groupBy(*part, "_run")
    joined = joined.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return runs.where(~at_end).select(*part, "first", "last", "n").unionByName(joined.drop("_run"))
