"""The analyses from files to files: python -m siteprofile.commands NAME --help. Sequences are read from FASTA; outputs are folders of TSV parts."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequence as S
from .operators import adapters, contexts, intervals, levels, profiles, spectral, statistics, structures
from .plans import pipelines
from .sources import readers, sinks, store

COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], None], dict[str, dict]]] = {}


def command(name: str, **options):
    """Register a command; each option is its default, or a type where it must be given."""

    def add(run):
        made = {}
        for key, value in options.items():
            if isinstance(value, type):
                made[key] = {"required": True, **({"nargs": "+"} if value is list else {"type": value})}
            elif isinstance(value, list):
                made[key] = {"default": value, "nargs": "*"}
            else:
                made[key] = {"default": value, "type": type(value) if value is not None else str}
        COMMANDS[name] = (run, made | {"output": {"required": True}})
        return run

    return add


def _write_enrichment(sites: DataFrame, genome: DataFrame, output: str, method: str) -> None:
    annotated = contexts.annotate(sites, genome)
    signatures = [contexts.signature(contexts.context_counts(annotated, f"context_{k}"), contexts.genome_kmer_counts(genome, k)) for k in (3, 5)]
    names = {"context": "CONTEXT", "ref_norm": "REF_NORM", "total_norm": "TOTAL_NORM"}
    sinks.write_signatures(annotated, *(s.withColumnsRenamed(names) for s in signatures), output, method)


@command("enrich-detector", input=str, genome=str, method="detector", top=100_000, p_value=0.05, bases=[], alpha=0.0, excluded=list(pipelines.EXCLUDED))
def enrich_detector(spark, a):
    """Exported detector intervals: top sites, p-value, bases, optional false-discovery rate, signatures of 3 and 5 bases."""
    rows = readers.detector(spark.read.options(sep="\t", header=True).csv(a.input))
    genome = readers.fasta(spark, a.genome)
    rows = pipelines.selected(rows, genome, a.p_value, a.bases, a.top, a.alpha, a.excluded)
    folder = sinks.run_folder(a.output, a.p_value, a.top)
    _write_enrichment(rows, genome, folder, a.method)
    sinks.write_tsv(pipelines.pipeline_schema(contexts.annotate(rows, genome)), f"{folder}/damage_pipeline.tsv")


@command("enrich-caller", input=str, genome=str, bases=list, method="caller")
def enrich_caller(spark, a):
    """A caller's table: bases, treated over untreated, signatures."""
    rows = readers.caller(spark, a.input).where(F.col("base").isin(*a.bases)).where("value > 0")
    _write_enrichment(rows.select("chrom", "pos", "strand", "mer", "min_coverage", "untreated_freq", "treated_freq", "value"), readers.fasta(spark, a.genome), a.output, a.method)


@command("enrich-strands", plus=list, minus=list, genome=str, quantile=0.9, method="strands")
def enrich_strands(spark, a):
    """Read counts by strand: those above the quantile of the non-zero ones."""
    rows = statistics.above_quantile(readers.strand_pair(spark, a.plus, a.minus), "reads", a.quantile)
    _write_enrichment(rows, readers.fasta(spark, a.genome), a.output, a.method)


@command("enrich-replicates", replicates=list, genome=str, method="replicates")
def enrich_replicates(spark, a):
    """Distinct sites of replicate BEDs."""
    _write_enrichment(readers.replicates(spark, a.replicates).select("chrom", "pos", "strand"), readers.fasta(spark, a.genome), a.output, a.method)


def _windows(spark, a) -> tuple[DataFrame, DataFrame]:
    regions = readers.nucleosomes(spark, a.nucleosomes).withColumn("center", F.col("end")).withColumn("class", F.lit("nucleosome"))
    return readers.damage(spark, a.damage), regions


def _profile(spark, a, left: int, right: int, name: str) -> None:
    sites, regions = _windows(spark, a)
    pairs = pipelines.region_pairs(sites, regions, left, right)
    sinks.write_tsv(pairs, f"{a.output}/{name}.tsv")
    out = pipelines.nucleosome_profile(sites, regions, readers.fasta(spark, a.genome), readers.signature(spark, a.signature), left, right)
    sinks.write_profile(profiles.recentred(out, 501) if left == 500 else out, a.output)


@command("nucleosome-profile", damage=str, nucleosomes=str, signature=str, genome=str)
def nucleosome_profile(spark, a):
    """Observed and expected sites within 73 bases of the nucleosomes' centres."""
    _profile(spark, a, 73, 74, "damage_in_nucleosomes")


@command("zoom-out", damage=str, nucleosomes=str, signature=str, genome=str)
def zoom_out(spark, a):
    """The same within 500 bases, and the signal-to-noise of its spectrum."""
    _profile(spark, a, 500, 501, "damage_zoom_out")
    profile = spark.read.options(sep="\t", header=True, inferSchema=True).csv(f"{a.output}/exp_obs_relinc.tsv")
    signal = profile.select((F.col("Position") + 500).cast("long").alias("i"), F.col("`Relative Increase`").cast("double").alias("x"))
    sinks.write_tsv(spectral.signal_to_noise(spectral.spectrum(signal, 0, 999, 5, 260)), f"{a.output}/peak_snr.tsv")


@command("randomise", damage=str, nucleosomes=str, signature=str, genome=str, n_random=1000, centre=0.0, seed=42)
def randomise(spark, a):
    """Peak, signal-to-noise and its p-value against sites dealt anew in their windows."""
    sites, regions = _windows(spark, a)
    found, p = pipelines.randomised_peak(sites, regions, readers.fasta(spark, a.genome), readers.signature(spark, a.signature), a.n_random, a.seed, a.centre or None)
    sinks.write_peak(found, p, a.output)


@command("structure", damage=str, genome=str, sizes=str, origins=str, ndr=str, accessibility=str, occupancy="", track="both", mappability="", span=30_000)
def structure(spark, a):
    """Origins (all, by timing), chromosome ends and middles, open and closed chromatin: similarity to the whole genome, observed and expected sites; transcribed and silent intervals of a track."""
    sites, genome = readers.damage(spark, a.damage), readers.fasta(spark, a.genome)
    if a.mappability:
        sites = intervals.equi_join(sites, readers.mappability(spark, a.mappability).where("value > 0").drop("value"), ["chrom", "pos"])
    lengths = readers.chrom_sizes(spark, a.sizes)
    ends = structures.clipped(intervals.chromosome_ends(lengths, a.span).join(lengths, "chrom")).withColumn("region_set", F.when(F.col("part") == "end", "Subtelomeric").otherwise("Non subtelomeric"))
    replication = readers.origins(spark, a.origins, a.ndr)
    timing = replication.withColumn("region_set", F.concat(F.lit("Origins "), F.when(F.col("feature_type") == "ndr", "NDR").otherwise(F.col("Timing"))))
    access = readers.accessibility(spark, a.accessibility).withColumn("region_set", F.when(F.col("counts") > 0, "Open chromatin").otherwise("Close chromatin"))
    sets = [replication.withColumn("region_set", F.lit("Replication Origins")), timing, ends, access]
    regions = None
    for each in sets:
        some = each.select("region_set", "chrom", "start", "end", F.lit(each is access).alias("centred"))
        regions = some if regions is None else regions.unionByName(some)
    similar = structures.structure_similarity(sites, genome, regions)
    sinks.write_tsv(similar.select(F.col("cosine").alias("Cosine-similarity"), F.col("region_set").alias("DNA structure"), F.col("context").alias("Context")), f"{a.output}/cosine_structure.tsv")
    annotated = contexts.annotate(sites, genome, (3,))
    whole = contexts.signature(contexts.context_counts(annotated, "context_3"), contexts.genome_kmer_counts(genome, 3))
    sinks.write_tsv(structures.observed_expected(sites, genome, regions, whole), f"{a.output}/observed_expected.tsv")
    if a.occupancy:
        track = pipelines.transcription_signature(structures.on_strand(sites, a.track), readers.bedgraph(spark, a.occupancy), genome, both_strands=a.track == "both")
        sinks.write_tsv(track, f"{a.output}/transcription_signature.tsv")


@command("transcript-ends", damage=str, transcripts=str, genome=str, base="G")
def transcript_ends(spark, a):
    """Sites around transcript starts and ends over the base's count there."""
    sites, genome = readers.damage(spark, a.damage).where(F.col("base") == a.base), readers.fasta(spark, a.genome)
    table = readers.numbered(readers.transcripts(spark, a.transcripts), "id").withColumn("chrom", F.concat(F.lit("chr"), "chrom"))
    for site in ("tss", "tts"):
        sinks.write_tsv(pipelines.transcript_profile(sites, table, genome, a.base, site=site).orderBy("rel_pos"), f"{a.output}/{site}.tsv")


def _bases(spark, a, left: int, right: int, from_right: bool) -> None:
    sites, regions = _windows(spark, a)
    middle = a.study[len(a.study) // 2]
    genome = readers.fasta(spark, a.genome)
    around = intervals.windows(regions, F.col("center"), left, right).select("id", "chrom", "start", "end")
    pairs = intervals.overlap_join(intervals.site_intervals(profiles.of_study(sites, a.study)), around, left_longest=1)
    comp = profiles.composition(profiles.window_sequences(around, genome, left + right))
    position = F.col("r_end") - F.col("pos") if from_right else F.col("pos") - F.col("r_start")
    enriched = profiles.per_base_enrichment(profiles.observed(pairs, position), comp, middle)
    out = profiles.with_model(enriched, profiles.random_model(comp, middle))
    smooth = spectral.savgol(out.select(F.col("position").alias("i"), F.col("norm_2").alias("x")), 31, 3).toDF("position", "smooth")
    sinks.write_tsv(out.join(smooth, "position", "left").orderBy("position"), f"{a.output}/enrichment.tsv")


@command("nucleosome-bases", damage=str, nucleosomes=str, genome=str, study="G")
def nucleosome_bases(spark, a):
    """Per-base enrichment inside nucleosomes with the random model."""
    _bases(spark, a, 73, 74, False)


@command("linker-bases", damage=str, nucleosomes=str, genome=str, study="G")
def linker_bases(spark, a):
    """The same within 200 bases, for a base or a motif, with the coverage by neighbours."""
    _bases(spark, a, 200, 200, True)
    _, regions = _windows(spark, a)
    around = intervals.windows(regions, F.col("center"), 200, 200).select("id", "chrom", "center", "start", "end")
    sinks.write_tsv(intervals.coverage_signal(around, order="id").orderBy("offset"), f"{a.output}/coverage.tsv")


@command("compare", left=str, right=str, renormalize=0)
def compare(spark, a):
    """Difference by context and cosine of two signatures."""
    one, two = readers.signature(spark, a.left), readers.signature(spark, a.right)
    sinks.write_tsv(statistics.difference(one, two, renormalize=bool(a.renormalize)), f"{a.output}/difference.tsv")
    sinks.write_tsv(statistics.cosine(one, two), f"{a.output}/cosine.tsv")


@command("cosine-matrix", signatures=list, names=list, like="")
def cosine_matrix(spark, a):
    """All pairs of signatures, rounded to 2 places, and the signatures side by side; like: only the contexts of this one."""
    long = None
    keys = readers.signature(spark, a.like) if a.like else None
    for name, path in zip(a.names, a.signatures, strict=True):
        one = readers.signature(spark, path).where(~F.col("context").contains("N"))
        one = (statistics.restricted(one, keys) if keys is not None else one).withColumn("name", F.lit(name))
        long = one if long is None else long.unionByName(one)
    matrix = statistics.cosine_matrix(long).withColumn("cosine", F.round("cosine", 2))
    sinks.write_wide(matrix, a.output, "data_cosines", "left", "right", "cosine", a.names)
    sinks.write_wide(long, a.output, "signatures", "context", "name", "total_norm", a.names)


@command("cosine-null", signature=str, observed=float, alpha=2.0, draws=10_000)
def cosine_null(spark, a):
    """How seldom random signatures are as similar as observed."""
    channels = [r[0] for r in readers.signature(spark, a.signature).orderBy("context").select("total_norm").collect()]  # a channel a context
    sinks.write_tsv(statistics.null_score(statistics.dirichlet_null(spark, channels, a.draws, a.alpha), a.observed), f"{a.output}/null.tsv")


@command("merge-replicates", one=str, two=str)
def merge_replicates(spark, a):
    """Positions of both replicates with mean frequencies, and those of one alone."""
    key = F.concat_ws("_", "chrom", "pos")
    one, two = (readers.caller(spark, p).withColumn("id", key) for p in (a.one, a.two))
    texts = [c for c in ("group", "motif") if c in one.columns and c in two.columns]
    means = ["untreated_freq", "treated_freq", *[c for c in one.columns if c.endswith("_p") and c in two.columns]]
    sinks.write_tsv(statistics.replicate_mean(one, two, "id", means, texts), f"{a.output}/merged.tsv", "gzip")
    same = [c for c in one.columns if c in two.columns]
    sinks.write_tsv(statistics.symmetric_difference(one.select(*same), two.select(*same), "id"), f"{a.output}/alone.tsv", "gzip")


@command("convert", old=str, new=str)
def convert(spark, a):
    """An older detector table with the columns of a newer one."""
    table = lambda p: spark.read.options(sep="\t", header=True).csv(p)
    sinks.write_tsv(pipelines.detector_schema(table(a.old), table(a.new).columns), f"{a.output}/damage_most_sig.tsv")


@command("centre-shares", signature=str)
def centre_shares(spark, a):
    """Shares of a signature by its centre base."""
    sinks.write_tsv(contexts.centre_shares(readers.signature(spark, a.signature)), f"{a.output}/shares.tsv")


@command("residues", table=str)
def residues(spark, a):
    """Mean and spread of mass-spectrometry proportions by residue."""
    sinks.write_tsv(statistics.mean_and_spread(readers.mass_spec(spark, a.table), "residue", "proportion"), f"{a.output}/residues.tsv")


@command("read-sites", reads=str, genome=str)
def read_sites(spark, a):
    """Sites before the first reads of an exported alignment, with their base, and as sorted BED."""
    sites = readers.read_sites(readers.reads(spark, a.reads))
    sinks.write_tsv(pipelines.read_bases(sites, readers.fasta(spark, a.genome)), f"{a.output}/sites.tsv")
    sinks.write_bed(sites, f"{a.output}/sites.bed")


@command("discard-adapters", pairs=str, adapter=str, rate=0.1, least=9)
def discard_adapters(spark, a):
    """A table of read pairs (seq1, seq2 and more) without those in which a read has the adapter, with errors."""
    rows = spark.read.options(sep="\t", header=True).csv(a.pairs)
    sinks.write_tsv(adapters.without_adapter(rows, a.adapter, ("seq1", "seq2"), a.rate, a.least), f"{a.output}/discarded_misligated.tsv")


@command("two-sample", reads=str, least_reads=20, context=2)
def two_sample(spark, a):
    """Levels of treated and control reads (chrom, strand, pos, treated, level): tests by site, combined over neighbouring sites."""
    rows = spark.read.schema("chrom string, strand string, pos long, treated boolean, level double").options(sep="\t", header=True).csv(a.reads)
    sinks.write_tsv(levels.fisher(levels.two_sample(rows, a.least_reads), context=a.context), f"{a.output}/sites.tsv")


@command("store-sites", damage=str, files=0)
def store_sites(spark, a):
    """A site table as a sorted store with an index; store.region() opens only the files that a region touches."""
    store.write(intervals.site_intervals(readers.damage(spark, a.damage)), a.output, files=a.files or None)


@command("context-domain", k=3, centre="")
def context_domain(spark, a):
    """All contexts in the order of centre and flanks."""
    sinks.write_tsv(S.contexts(spark, a.k, a.centre or None).orderBy("ordinal"), f"{a.output}/contexts.tsv")


def _marker(spark: SparkSession, output: str):
    """The file that says that a step has ended well, and the file system that it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{output}/_done")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


@command("steps", file=str, resume=0)
def steps(spark, a):
    """Commands one after the other, from a JSON list of objects with name, command, options and on (false: left out).

    A step writes below output/name; {output} in an option stands for output, so that a step reads what another wrote. With
    resume, steps that ended well before are not run again.
    """
    listed = json.loads(spark.read.text(a.file, wholetext=True).first()[0])
    unknown = {s["command"] for s in listed} - set(COMMANDS)
    if unknown or len({s["name"] for s in listed}) < len(listed):
        raise ValueError(f"unknown commands {sorted(unknown)}, or a name that stands twice")
    for step in listed:
        output = f"{a.output}/{step['name']}"
        path, system = _marker(spark, output)
        if not step.get("on", True) or a.resume and system.exists(path):
            continue
        if a.resume and system.exists(path.getParent()):  # what a step left behind that did not end
            system.delete(path.getParent(), True)
        words = [step["command"], "--output", output]
        for key, value in step.get("options", {}).items():
            each = [str(v).replace("{output}", a.output) for v in (value if isinstance(value, list) else [value])]
            words += [f"--{key}", *each]
        main(words, spark)
        system.create(path).close()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siteprofile", description=__doc__)
    each = top.add_subparsers(dest="command", required=True)
    for name, (run, options) in COMMANDS.items():
        sub = each.add_parser(name, help=run.__doc__, description=run.__doc__)
        for key, how in options.items():
            sub.add_argument(f"--{key.replace('_', '-')}", **how)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    found = parser().parse_args(arguments)
    COMMANDS[found.command][0](spark or SparkSession.builder.appName(f"siteprofile {found.command}").getOrCreate(), found)


if __name__ == "__main__":
    main()
