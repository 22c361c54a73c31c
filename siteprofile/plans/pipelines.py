"""Whole analyses, composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contexts, intervals, profiles, spectral, statistics, tracks
from ..storage import checkpoint

#: Chromosomes that an enrichment leaves out.
EXCLUDED = ("chrXII", "chrMito", "chrM")


def selected(
    sites: DataFrame, genome: DataFrame, p_value: float = 0.05, bases: list[str] | None = None, top: int | None = None,
    alpha: float | None = None, excluded=(), ties: tuple[str, ...] = ("chrom", "pos", "strand"),
) -> DataFrame:
    """The sites that an enrichment counts, by filters in this order: the top sites, of these those on chromosomes that are
    not excluded, those with one of the bases, those with a p-value below the threshold, and of what is then left those
    that multiple testing keeps. So excluded sites use up places of the top, and the correction sees the other bases' sites
    no more. Without bases no sequence is read. A base that is named twice counts once."""
    rows = statistics.top_sites(sites, top, ties=ties) if top else sites
    rows = rows.where(~F.col("chrom").cast("string").isin(*excluded)) if excluded else rows
    if bases:
        rows = contexts.annotate(rows, genome, (1,)).where(F.col("base").isin(*bases)).select(*sites.columns)
    rows = rows.where(F.col("pvalue") < p_value)
    return statistics.benjamini_hochberg(rows).where(F.col("q") <= alpha) if alpha else rows


def enrichment(
    sites: DataFrame, genome: DataFrame, p_value: float = 0.05, bases: list[str] | None = None, top: int | None = None,
    alpha: float | None = None, k: int = 3, excluded=(),
) -> DataFrame:
    """Signature of the sites that selected() gives: context, background, ratio."""
    rows = selected(sites, genome, p_value, bases, top, alpha, excluded)
    return contexts.signature(tracks.contexts_of(rows, genome, k), contexts.genome_kmer_counts(genome, k))


def region_pairs(sites: DataFrame, regions: DataFrame, left: int = 73, right: int = 74, least_start: int = 1) -> DataFrame:
    """Sites with the windows around the regions' centres that they lie in."""
    windows = intervals.windows(regions, F.col("center"), left, right, least_start)
    windows = windows.select("id", "chrom", "start", "end", "class", "center")
    return intervals.overlap_join(intervals.site_intervals(sites), windows, left_longest=1, right_longest=left + right)


def nucleosome_profile(
    sites: DataFrame, regions: DataFrame, genome: DataFrame, sig: DataFrame, left: int = 73, right: int = 74, offset: int = 0,
    mirror_minus: bool = False,
) -> DataFrame:
    """position, observed, expected, rel_inc over the windows; left = 500 and right = 501 zoom out.

    Minus-strand windows are read as their reverse complement, so their expected positions run backwards. mirror_minus: the
    observed ones do too; else they count from the left on both strands, as the analyses have it. Each region is a window of
    its own, and both counts come from one pass over the genome's chunks, without a row for each site in a window.
    """
    windows = intervals.windows(regions, F.col("center"), left, right)
    counts = tracks.profile_in(sites, windows, genome, sig, left + right, 3, offset, mirror_minus).where("expected IS NOT NULL")
    return profiles.relative_increase(counts)


def randomised_peak(
    sites: DataFrame, regions: DataFrame, genome: DataFrame, sig: DataFrame, n_random: int = 1000, seed: int = 42,
    centre: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(snr and peak of the observed profile, one row with the empirical p-value of its snr).

    The windows' sequences are written once and read by the null model and the expected counts; so are the draws' counts, a row
    for each replicate and position. A replicate's profile is an array, and its spectrum a product with one matrix of angles.
    """
    pairs = region_pairs(sites, regions)
    groups = profiles.window_groups(pairs)
    windows = checkpoint(profiles.sequenced(groups, genome, 147))
    sig = checkpoint(sig)  # 5^3 rows at most
    exp = checkpoint(profiles.expected_of(windows, sig, 147))
    counts = profiles.densify(profiles.observed(pairs, F.col("pos") - F.col("r_start")), 1, 147, "observed")
    real = profiles.relative_increase(counts, exp).select(F.lit(-1).cast("long").alias("replicate"), "position", F.col("rel_inc").alias("x"))
    drawn = checkpoint(statistics.multinomial_null(profiles.probabilities_of(windows, sig, 147), n_random, seed)).join(F.broadcast(exp), "position")  # 147 rows
    null = drawn.select("replicate", "position", F.try_divide(F.col("n") - F.col("expected"), F.col("expected")).alias("x"))
    signals = real.unionByName(null).select("replicate", (F.col("position") - 1).alias("i"), "x")
    spectra = spectral.spectra(signals, 0, 145, 5, 50, ["replicate"])
    peaks = checkpoint(spectral.signal_to_noise(spectra, ["replicate"], centre))  # a row for each replicate
    found = peaks.where("replicate < 0").drop("replicate")
    return found, statistics.empirical_p(peaks.where("replicate >= 0"), found)


def region_comparison(sites: DataFrame, genome: DataFrame, regions: DataFrame, whole: DataFrame, k: int = 3) -> DataFrame:
    """(class, cosine): for each class of regions the similarity of its signature (sites in it over its own k-mers) to that of the whole genome."""
    background = tracks.kmers_in(regions, genome, F.col("start"), F.col("end") - F.col("start"), k, ["class"])
    observed = tracks.contexts_in(sites, regions, genome, k, ["class"])
    norm = observed.join(background.withColumnsRenamed({"kmer": "context", "n": "ref"}), ["class", "context"], "left").select("class", "context", F.coalesce(F.try_divide("n", "ref"), F.lit(0.0)).alias("v"))
    both = norm.join(whole.select("context", F.col("total_norm").alias("w")), "context", "left")
    length = F.broadcast(whole.agg(F.sqrt(F.sum(F.col("total_norm") ** 2)).alias("_w")))  # one row
    sums = both.groupBy("class").agg(F.sum(F.col("v") * F.coalesce("w", F.lit(0.0))).alias("_d"), F.sqrt(F.sum(F.col("v") ** 2)).alias("_v"))
    return sums.crossJoin(length).select("class", F.try_divide("_d", F.col("_v") * F.col("_w")).alias("cosine"))


def transcript_profile(
    sites: DataFrame, transcripts: DataFrame, genome: DataFrame, base: str = "G", half: int = 650, site: str = "tss", stranded: bool = False
) -> DataFrame:
    """rel_pos, count, norm_count, normalized of the sites around transcript starts (site tss) or ends (tts) over the base's count there.

    transcripts has id, chrom, tss, start, end, strand (1 or -1). stranded: of transcripts on the minus strand the
    complement's bases are counted; else those of the plus strand for all, as the analyses have it.
    """
    anchor = F.col("tss") if site == "tss" else F.when(F.col("strand") == 1, F.col("end")).otherwise(F.col("start"))
    windows = intervals.windows(transcripts.withColumn("class", F.lit(site)), anchor, half, half, 0).select("id", "chrom", "center", "start", "end", F.col("strand").alias("own_strand"))
    back = F.coalesce(F.col("own_strand") == -1, F.lit(False)) if stranded else F.lit(False)
    comp = tracks.composition_in(windows.where(~back), genome, 2 * half)
    if stranded:
        comp = comp.unionByName(tracks.composition_in(windows.where(back), genome, 2 * half).withColumn("kmer", F.translate("kmer", "ACGT", "TGCA")))
    background = comp.where(F.col("kmer") == base).groupBy((F.col("offset") - (half - 1)).alias("rel_pos")).agg(F.sum("n").alias("norm_count"))
    counts = tracks.observed_in(sites, windows, 2 * half).select((F.col("position") - half).alias("rel_pos"), F.col("observed").alias("count"))
    return profiles.anchored(counts, background)


def transcription_states(track: DataFrame, both_strands: bool = False, shift: int = 1) -> DataFrame:
    """Intervals of an occupancy track, moved by shift, with state: transcribed above 0; silent below 0 (both_strands) or at 0; the rest goes."""
    silent = F.col("occupancy") < 0 if both_strands else F.col("occupancy") == 0
    state = F.when(F.col("occupancy") > 0, "transcribed").when(silent, "silent")
    moved = track.withColumn("state", state).where("state is not null")
    return moved.withColumn("start", F.col("start") + shift).withColumn("end", F.col("end") + shift)


def transcription_signature(sites: DataFrame, track: DataFrame, genome: DataFrame, k: int = 3, both_strands: bool = False) -> DataFrame:
    """(state, context, total_norm): signatures of the sites in transcribed and silent intervals over the k-mers centred there."""
    states = transcription_states(track, both_strands)
    half = k // 2
    counts = tracks.kmers_in(states, genome, F.col("start") - half + 1, F.col("end") - F.col("start") + 2 * half, k, ["state"])
    background = counts.withColumnsRenamed({"kmer": "context", "n": "ref"})
    observed = tracks.contexts_in(sites, states, genome, k, ["state"])
    norm = observed.join(background, ["state", "context"], "left").select("state", "context", F.coalesce(F.try_divide("n", "ref"), F.lit(0.0)).alias("v"))
    total = norm.groupBy("state").agg(F.sum("v").alias("_t"))
    return norm.join(total, "state").select("state", "context", F.try_divide("v", "_t").alias("total_norm"))


def pipeline_schema(sites: DataFrame) -> DataFrame:
    """Annotated detector sites in the schema that the other analyses read: mer is the pentamer, coverage and frequencies are 0, value is the p-value."""
    zero = lambda name, kind: F.lit(0).cast(kind).alias(name)
    return sites.select("chrom", "pos", "base", "strand", F.col("context_5").alias("mer"), zero("min_coverage", "long"), zero("untreated_freq", "double"), zero("treated_freq", "double"), F.col("pvalue").alias("value"), "context_5", "context_3")


def detector_schema(rows: DataFrame, columns: list[str]) -> DataFrame:
    """An older table of detector sites (CHROM, SEQ, p-value, diff, ...) with the columns of a newer one: coverage and frequencies are 0, mer is -."""
    named = rows.withColumnsRenamed({"CHROM": "chrom", "SEQ": "base", "p-value": "value"}).drop("diff")
    zero = {c: F.lit(0) for c in ("untreated_freq", "treated_freq", "min_coverage")}
    return named.withColumns(zero | {"mer": F.lit("-")}).select(*columns)


def read_bases(sites: DataFrame, genome: DataFrame) -> DataFrame:
    """Sites of reads (chrom, pos, strand) as start = pos - 1, end = pos + 1 and base: what stands at pos, as read on the strand; N off the chromosome."""
    rows = contexts.with_sequence(sites, genome, F.col("pos"), 1, "_b")
    base = F.when(F.length("_b") == 1, F.col("_b")).otherwise("N")
    read = F.when(F.col("strand") == "-", F.translate(base, "ACGT", "TGCA")).otherwise(base)
    return rows.withColumn("start", F.col("pos") - 1).withColumn("end", F.col("pos") + 1).withColumn("base", read).drop("_b")
