"""Operators on tabular reads: what the raw-data steps select, drop and count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the alignment flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, SECONDARY, DUPLICATE = 1, 2, 4, 8, 16, 64, 256, 1024


def has(flag: str, bit: int):
    return F.col(flag).bitwiseAND(F.lit(bit)) == bit


def subset(reads: DataFrame, ids: DataFrame, key: str = "read_id") -> DataFrame:
    """The reads whose id is listed."""
    return reads.join(ids, key, "left_semi")


def distinct_pairs(reads: DataFrame, first: str = "seq1", second: str = "seq2") -> DataFrame:
    """One read pair of each pair of sequences."""
    return reads.dropDuplicates([first, second])


def without_adapter(reads: DataFrame, adapter: str, least: int = 9, columns: tuple[str, ...] = ("seq1", "seq2")) -> DataFrame:
    """Pairs in which no read starts with a suffix of the adapter of at least `least` bases; no mismatches."""
    starts = [adapter[i:] for i in range(len(adapter) - least + 1)]
    found = F.lit(False)
    for c in columns:
        for s in starts:
            found = found | F.col(c).startswith(s)
    return reads.where(~F.coalesce(found, F.lit(False)))


def proper_pairs(alignments: DataFrame, flag: str = "flag") -> DataFrame:
    return alignments.where(has(flag, PROPER))


def statistics(alignments: DataFrame, flag: str = "flag", mapq: str = "mapq", threshold: int = 30) -> DataFrame:
    """One row of counts: all, mapped, proper, unmapped pairs, duplicates, secondary, and those of good mapping quality."""
    return alignments.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~has(flag, UNMAPPED)).alias("mapped"),
        F.count_if(has(flag, PROPER)).alias("proper"),
        F.count_if(has(flag, UNMAPPED) & has(flag, MATE_UNMAPPED)).alias("pair_unmapped"),
        F.count_if(has(flag, DUPLICATE)).alias("duplicates"),
        F.count_if(has(flag, SECONDARY)).alias("secondary"),
        F.count_if(F.col(mapq) >= threshold).alias("good"),
    )


def on_chromosomes(alignments: DataFrame, chroms: list[str]) -> DataFrame:
    return alignments.where(F.col("chrom").isin(*chroms))
