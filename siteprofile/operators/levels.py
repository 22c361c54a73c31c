"""Two samples of read levels at each site: rank and distribution tests, and their combination over neighbouring sites."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.special import chi2_sf

SITE = ("chrom", "strand", "pos")
#: Equal cells of the levels by which a site's reads are dealt to tasks, and terms of the series of the distance's law.
CELLS, TERMS = 1024, 50


def kolmogorov_sf(x: Column) -> Column:
    """Upper tail of the Kolmogorov distribution; below 0.2 it is 1 to 11 places."""
    terms = [(2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * x * x) for k in range(1, TERMS + 1)]
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(terms[1:], terms[0]))))


def two_sample(reads: DataFrame, least_reads: int = 20, site: tuple[str, ...] = SITE) -> DataFrame:
    """(site..., n_treated, n_control, u, z, ks, p_u, p_ks) of the sites with at least least_reads reads of either sample.

    reads has the columns of site, treated (boolean) and level. u is the number of pairs in which the treated read is the
    higher one, equal ones counted half; z its deviation over the standard deviation with ties, p_u two-sided from it. ks is
    the largest distance of the two distributions, p_ks its asymptotic law. Reads without a level or sample do not count; where all
    levels of a site are equal, z and p_u are null.

    Equal levels are counted first. Ranks are running sums over cells of the level, CELLS a site, and then within a cell, so
    the reads of a crowded site are spread over many tasks.
    """
    keys = list(site)
    held = reads.where(F.col("level").isNotNull() & F.col("treated").isNotNull() & ~F.isnan(F.col("level").cast("double")))
    counts = held.groupBy(*keys, F.col("level").cast("double").alias("_x")).agg(F.count_if("treated").alias("_a"), F.count_if(~F.col("treated")).alias("_b"))
    ends = held.agg(F.min("level").cast("double").alias("_lo"), F.max("level").cast("double").alias("_hi"))
    cell = F.coalesce(F.least(F.floor(F.try_divide(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * CELLS), F.lit(CELLS - 1)), F.lit(0))
    counts = counts.crossJoin(F.broadcast(ends)).withColumn("_cell", cell).drop("_lo", "_hi")  # one row
    whole, up = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_a").alias("_ca"), F.sum("_b").alias("_cb"))
    cells = cells.select(
        *keys, "_cell", F.coalesce(F.sum("_ca").over(up), F.lit(0)).alias("_a0"), F.coalesce(F.sum("_cb").over(up), F.lit(0)).alias("_b0"),
        F.sum("_ca").over(whole).alias("_na"), F.sum("_cb").over(whole).alias("_nb"),
    ).where((F.col("_na") >= least_reads) & (F.col("_nb") >= least_reads))
    inside = Window.partitionBy(*keys, "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("_ua", F.sum("_a").over(inside)).withColumn("_ub", F.sum("_b").over(inside)).join(cells, [*keys, "_cell"])
    a, b, both = F.col("_a"), F.col("_b"), (F.col("_a") + F.col("_b")).cast("double")
    upto_a, upto_b = F.col("_a0") + F.col("_ua"), F.col("_b0") + F.col("_ub")
    found = run.groupBy(*keys).agg(
        F.max("_na").alias("n_treated"),
        F.max("_nb").alias("n_control"),
        F.sum(a * (upto_b - b) + a * b / F.lit(2.0)).alias("u"),
        F.max(F.abs(upto_a / F.col("_na") - upto_b / F.col("_nb"))).alias("ks"),
        F.sum(both * both * both - both).alias("_ties"),
    )
    n, m = F.col("n_treated").cast("double"), F.col("n_control").cast("double")
    spread = F.sqrt(n * m / 12 * (n + m + 1 - F.col("_ties") / ((n + m) * (n + m - 1))))
    found = found.withColumn("z", F.when(spread > 0, (F.col("u") - n * m / 2) / spread))
    scaled = F.col("ks") * F.sqrt(n * m / (n + m))
    return found.select(*keys, "n_treated", "n_control", "u", "z", "ks", chi2_sf(F.col("z") ** 2).alias("p_u"), kolmogorov_sf(scaled).alias("p_ks"))


def fisher(tested: DataFrame, p: str = "p_ks", context: int = 2, site: tuple[str, ...] = SITE) -> DataFrame:
    """tested with n_combined and p_combined: the tests of the sites up to context positions away on the same strand, the own one included, by Fisher's method.

    A site's logarithm goes to the 2 * context + 1 positions that it is near to, and is summed there, so a long
    chromosome is spread over many tasks. Null p-values take no part; one of 0 counts as the smallest number.
    """
    keys, pos = list(site[:-1]), site[-1]
    near = F.explode(F.array(*[F.col(pos) + i for i in range(-context, context + 1)]))
    logs = tested.where(F.col(p).isNotNull()).select(*keys, near.alias(pos), (-F.ln(F.greatest(F.col(p), F.lit(2.3e-308)))).alias("_h"))
    sums = logs.groupBy(*keys, pos).agg(F.sum("_h").alias("_h"), F.count(F.lit(1)).alias("n_combined"))
    h = F.col("_h")
    series = [F.when(F.col("n_combined") > i, F.pow(h, F.lit(float(i))) / math.factorial(i)).otherwise(0.0) for i in range(2 * context + 1)]
    tail = F.least(F.lit(1.0), F.exp(-h) * sum(series[1:], series[0]))
    return tested.join(sums.select(*keys, pos, "n_combined", tail.alias("p_combined")), list(site), "left")
