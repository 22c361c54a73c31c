"""Readers. Each has a declared schema; variants are told apart by their header or number of columns before the read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The column names of the caller table's three forms.
CALLER_8 = "chrom string, pos long, base string, strand string, mer string, min_coverage long, untreated_freq double, treated_freq double"
CALLER_13 = "`index` long, chrom string, pos long, base string, strand string, mer string, min_coverage long, untreated_freq double, treated_freq double, diff double, `group` string, motif_1_p double, motif string"
CALLER_14 = "`index` long, chrom string, pos long, base string, strand string, mer string, min_coverage long, untreated_freq double, treated_freq double, diff double, `group` string, motif_1_p double, motif_2_p double, motif string"
CALLER = {8: CALLER_8, 13: CALLER_13, 14: CALLER_14}


def _tsv(spark: SparkSession, path: str | list[str], schema: str, header: bool = False) -> DataFrame:
    return spark.read.schema(schema).options(sep="\t", header=header, enforceSchema=True).csv(path)


def caller(spark: SparkSession, path: str) -> DataFrame:
    """Caller table (gzip TSV with a header of 8, 13 or 14 columns), with value = treated_freq - untreated_freq."""
    first = spark.read.text(path).limit(1).first()
    width = len(first[0].split("\t")) if first else 8
    if width not in CALLER:
        raise ValueError(f"a caller table has {', '.join(map(str, CALLER))} columns, not {width}")
    return _tsv(spark, path, CALLER[width], header=True).withColumn("value", F.col("treated_freq") - F.col("untreated_freq"))


def detector(rows: DataFrame) -> DataFrame:
    """Exported detector intervals (chrm, end, strand, reg_text ending in ': <-log10 p>') as chrom, pos, strand, pvalue; Mito is chrM."""
    name = F.concat(F.lit("chr"), "chrm")
    p = F.pow(F.lit(10.0), -F.try_element_at(F.split("reg_text", ": "), F.lit(-1)).cast("double"))
    return rows.select(F.when(name == "chrMito", "chrM").otherwise(name).alias("chrom"), F.col("end").cast("long").alias("pos"), "strand", p.alias("pvalue"))


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "chrom string, len long")


def genome_length(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.sum("len").alias("len"))


def damage(spark: SparkSession, path: str) -> DataFrame:
    """The pipeline's site table, whatever the order of its header; diff and index go."""
    table = spark.read.options(sep="\t", header=True).csv(path)
    names = {c.lower(): c for c in table.columns}
    take = lambda new, old, kind: F.col(f"`{names[old]}`").cast(kind).alias(new) if old in names else F.lit(None).cast(kind).alias(new)
    return table.select(
        take("chrom", "chrom", "string"), take("pos", "pos", "long"), take("base", "base" if "base" in names else "seq", "string"), take("strand", "strand", "string"),
        take("mer", "mer", "string"), take("min_coverage", "min_coverage" if "min_coverage" in names else "min coverage", "long"), take("untreated_freq", "untreated_freq", "double"),
        take("treated_freq", "treated_freq", "double"), take("value", "value", "double"), take("context_5", "pentamer", "string"), take("context_3", "triplet", "string"),
    )


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """Rows numbered from 0 in the order of the file: by partition, then by place, with one count per partition summed up."""
    placed = df.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_p", first.alias("_first"))  # one row per partition
    return placed.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_first") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_first")


def nucleosomes(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """chrom, start, end, val_1, val_2 and id, the number of the row; header: the first line is dropped."""
    return numbered(_tsv(spark, path, "chrom string, start long, end long, val_1 double, val_2 double", header), "id")


def origins(spark: SparkSession, origins_path: str, ndr_path: str) -> DataFrame:
    """Replication origins and nucleosome-depleted regions in one table with feature_type; columns that one lacks are null."""
    o = spark.read.options(sep="\t", header=True).csv(origins_path).drop("Origin").withColumn("feature_type", F.lit("origin"))
    n = spark.read.options(sep="\t", header=True).csv(ndr_path).withColumn("feature_type", F.lit("ndr"))
    both = o.unionByName(n, allowMissingColumns=True)
    return both.withColumn("Start", F.col("Start").cast("long")).withColumn("End", F.col("End").cast("long")).withColumnsRenamed({"Chromosome": "chrom", "Start": "start", "End": "end"})


def genes(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "chrom string, start long, end long, name string, score string, strand string")


def accessibility(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "chrom string, start long, end long, counts double")


def bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, occupancy without rows that lack a value."""
    return _tsv(spark, path, "chrom string, start long, end long, occupancy double").na.drop()


def mappability(spark: SparkSession, folder: str) -> DataFrame:
    """(chrom, pos, value) of a folder with one file per chromosome and one byte per base."""
    files = spark.read.format("binaryFile").load(folder)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^/.]*)?$", 1)
    at = F.sequence(F.lit(1), F.octet_length("content"))
    long = files.where(F.octet_length("content") > 0).select(stem.alias("chrom"), "content", F.explode(at).alias("pos"))
    return long.select("chrom", F.col("pos").cast("long").alias("pos"), F.conv(F.hex(F.substring("content", F.col("pos"), F.lit(1))), 16, 10).cast("int").alias("value"))


def strand_pair(spark: SparkSession, plus: list[str], minus: list[str]) -> DataFrame:
    """chrom, p0, pos, id, reads, strand of the files of both strands."""
    schema = "chrom string, p0 long, pos long, id string, reads long"
    return _tsv(spark, plus, schema).withColumn("strand", F.lit("+")).unionByName(_tsv(spark, minus, schema).withColumn("strand", F.lit("-")))


def replicates(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Replicate BEDs (chrom, start, pos, seq, strand) as one set of distinct rows with id = chrom_pos_strand."""
    rows = _tsv(spark, paths, "chrom string, start long, pos long, seq string, strand string")
    return rows.withColumn("id", F.concat_ws("_", "chrom", "pos", "strand")).distinct()


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq), upper case; the name ends at the first white space. Records are split at >, so a file of many is spread over tasks."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("v")).where(F.length(F.trim("v")) > 0)
    return raw.select(F.regexp_extract("v", r"^(\S+)", 1).alias("chrom"), F.upper(F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n?", ""), r"\s+", "")).alias("seq"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts that have a gene name: chrom, strand (1 or -1), tss, start, end, gene."""
    raw = spark.read.options(sep="\t", header=True).csv(path)
    named = raw.where(F.col("`Gene name`").isNotNull())
    return named.select(F.col("`Chromosome/scaffold name`").alias("chrom"), F.col("Strand").cast("int").alias("strand"), F.col("`Transcription start site (TSS)`").cast("long").alias("tss"), F.col("`Transcript start (bp)`").cast("long").alias("start"), F.col("`Transcript end (bp)`").cast("long").alias("end"), F.col("`Gene name`").alias("gene"))


def signature(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "context string, ref_norm double, total_norm double", header=True)


def mass_spec(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.options(sep="\t", header=True).csv(path)
    return raw.select(F.col("Residue").alias("residue"), F.col("`Damage Proportion`").cast("double").alias("proportion"))


def reads(spark: SparkSession, path: str) -> DataFrame:
    """A tabular export of alignments: chrom, start, end (0-based, half-open), is_reverse, is_read1, is_secondary, chrom_len."""
    return _tsv(spark, path, "chrom string, start long, end long, is_reverse boolean, is_read1 boolean, is_secondary boolean, chrom_len long", header=True)


def read_sites(alignments: DataFrame) -> DataFrame:
    """(chrom, pos, strand) of the base before each primary first read: start - 1 on plus, unless the read starts the chromosome; end + 1 on minus, unless it ends it."""
    primary = alignments.where(F.col("is_read1") & ~F.col("is_secondary"))
    pos = F.when(F.col("is_reverse"), F.when(F.col("end") != F.col("chrom_len"), F.col("end") + 1)).otherwise(F.when(F.col("start") != 0, F.col("start") - 1))
    return primary.select("chrom", pos.alias("pos"), F.when(F.col("is_reverse"), "-").otherwise("+").alias("strand")).where("pos is not null")
