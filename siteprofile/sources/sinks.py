"""Sinks. Each writes a folder of part files; compression and mode are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, compression: str | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).options(sep="\t", header=True)
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_signatures(sites: DataFrame, triplets: DataFrame, pentamers: DataFrame, folder: str, method: str) -> None:
    """The three tables of an enrichment run."""
    write_tsv(sites, f"{folder}/damage_most_sig_{method}.tsv")
    write_tsv(triplets, f"{folder}/triplet_normalized_{method}.tsv")
    write_tsv(pentamers, f"{folder}/pentamer_normalized_{method}.tsv")


def write_profile(profile: DataFrame, folder: str) -> None:
    names = {"position": "Position", "observed": "Observed_damage", "expected": "Expected_damage", "rel_inc": "Relative Increase"}
    write_tsv(profile.withColumnsRenamed(names).orderBy("Position"), f"{folder}/exp_obs_relinc.tsv")


def write_peak(snr: DataFrame, p_value: DataFrame, folder: str) -> None:
    """One row: peak, snr, p-value and their ratio."""
    one = snr.crossJoin(F.broadcast(p_value))  # one row each
    write_tsv(one.select("peak", "snr", F.col("p_value").alias("p-value"), (F.col("snr") / F.col("p_value")).alias("snr/pval")), f"{folder}/peak_snr_pval_data.tsv")


def write_wide(long: DataFrame, folder: str, name: str, key: str, column: str, value: str, columns: list[str] | None = None) -> None:
    """A matrix: a column for each name."""
    write_tsv(long.groupBy(key).pivot(column, columns).agg(F.first(value)), f"{folder}/{name}.tsv")


def write_bed(sites: DataFrame, path: str, order: DataFrame | None = None) -> None:
    """Sites as BED, sorted by chromosome and start; order (chrom, ordinal) sorts chromosomes as in a genome file."""
    bed = sites.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), "strand").distinct()
    if order is not None:
        bed = bed.join(F.broadcast(order), "chrom").orderBy("ordinal", "start", "strand").drop("ordinal")
    else:
        bed = bed.orderBy("chrom", "start", "strand")
    bed.write.options(sep="\t", header=False).csv(path)


def run_folder(base: str, p_value: float, n_sites: int) -> str:
    return f"{base}/pval_{p_value}_damage_{n_sites}"
