"""Sets of regions against the whole genome: sites, contexts, signatures, similarity and expected counts of every set in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import contexts, intervals, statistics, tracks


def clipped(regions: DataFrame) -> DataFrame:
    """Regions with len, cut to their chromosome: start at least 1, end at most len + 1; what is left of none goes."""
    start, end = F.greatest(F.col("start"), F.lit(1)), F.least(F.col("end"), F.col("len") + 1)
    return regions.withColumn("_s", start).withColumn("end", end).withColumn("start", F.col("_s")).drop("_s").where("start < end")


def region_backgrounds(regions: DataFrame, genome: DataFrame, k: int) -> DataFrame:
    """(region_set, kmer, n) of the k-mers inside the regions, region by region. Regions with a column centred that is true (tracks of single bases) have the k-mers centred on their bases instead."""
    centred = F.coalesce(F.col("centred"), F.lit(False)) if "centred" in regions.columns else F.lit(False)
    first = F.when(centred, F.col("start") + 1 - k // 2).otherwise(F.col("start"))
    length = F.col("end") - F.col("start") + F.when(centred, 2 * (k // 2)).otherwise(0)
    rows = regions.select("region_set", "chrom", first.alias("_from"), length.alias("_length"))
    return tracks.kmers_in(rows, genome, F.col("_from"), F.col("_length"), k, ["region_set"])


def region_signatures(sites: DataFrame, genome: DataFrame, regions: DataFrame, k: int = 3) -> DataFrame:
    """(region_set, context, n, ref, ref_norm, total_norm): contexts of the sites in each set of regions over the k-mers of these.

    A site counts once for each region that it lies in. All sets are counted together in the genome's chunks.
    """
    observed = tracks.contexts_in(sites, regions, genome, k, ["region_set"])
    background = region_backgrounds(regions, genome, k).withColumnsRenamed({"kmer": "context", "n": "ref"})
    norm = observed.join(background, ["region_set", "context"], "left").withColumn("ref_norm", F.coalesce(F.try_divide("n", "ref"), F.lit(0.0)))
    total = norm.groupBy("region_set").agg(F.sum("ref_norm").alias("_t"))
    return norm.join(total, "region_set").select("region_set", "context", "n", "ref", "ref_norm", F.try_divide("ref_norm", "_t").alias("total_norm"))


def similarities(signatures: DataFrame, whole: DataFrame) -> DataFrame:
    """(region_set, cosine) of each set's signature to that of the whole genome; contexts that one lacks count as 0."""
    both = signatures.join(whole.select("context", F.col("total_norm").alias("_w")), "context", "left")
    sums = both.groupBy("region_set").agg(F.sum(F.col("total_norm") * F.coalesce("_w", F.lit(0.0))).alias("_d"), F.sum(F.col("total_norm") ** 2).alias("_v"))
    length = whole.agg(F.sum(F.col("total_norm") ** 2).alias("_n"))
    return sums.crossJoin(F.broadcast(length)).select("region_set", F.try_divide("_d", F.sqrt("_v") * F.sqrt("_n")).alias("cosine"))  # one row


def observed_expected(sites: DataFrame, genome: DataFrame, regions: DataFrame, whole: DataFrame, k: int = 3) -> DataFrame:
    """(region_set, observed, expected, g, p_value): sites in each set against what the whole genome's signature expects of its k-mers, each product rounded to 2 places and the sum to whole numbers."""
    met = intervals.overlap_join(intervals.site_intervals(sites), regions.select("region_set", "chrom", "start", "end"), left_longest=1)
    observed = met.groupBy("region_set").agg(F.count(F.lit(1)).alias("observed"))
    counts = region_backgrounds(regions, genome, k)
    each = counts.join(whole.select(F.col("context").alias("kmer"), "ref_norm"), "kmer").select("region_set", F.bround(F.col("ref_norm") * F.col("n"), 2).alias("e"))
    expected = each.groupBy("region_set").agg(F.bround(F.sum("e"), 0).alias("expected"))
    return statistics.g_test(observed.join(expected, "region_set"))


def structure_similarity(sites: DataFrame, genome: DataFrame, regions: DataFrame) -> DataFrame:
    """(region_set, context, cosine): similarity of each set to the whole genome by Triplet and by Pentamer."""
    parts = []
    for name, k in (("Triplet", 3), ("Pentamer", 5)):
        whole = contexts.signature(tracks.contexts_of(sites, genome, k), contexts.genome_kmer_counts(genome, k))
        parts.append(similarities(region_signatures(sites, genome, regions, k), whole).select("region_set", F.lit(name).alias("context"), "cosine"))
    return parts[0].unionByName(parts[1])


def on_strand(sites: DataFrame, track: str) -> DataFrame:
    """The sites that a track of one strand (plus, minus) is compared with; all for both."""
    return sites if track == "both" else sites.where(F.col("strand") == {"plus": "+", "minus": "-"}[track])
