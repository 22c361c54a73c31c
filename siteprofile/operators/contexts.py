"""Sequence contexts of sites and regions, their counts, and normalised signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import arrays
from ..functions import sequence as S
from . import ordered

#: Bases of a chunk of the genome, and of the overlap on both sides. Where a fixed, short length is read, chunks are of SHORT bases and overlap by that length.
CHUNK, HALO, SHORT = 16_384, 1_100, 1_024


def chunked(genome: DataFrame, chunk: int = CHUNK, halo: int = HALO, binary: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """genome in rows chrom, chunk, first, part, len, and its columns keep: part starts at position first (1-based) and reaches halo bases over both ends of its chunk.

    genome has chrom and seq, or, from sources.ranges.fasta(), chrom, at, piece and len. A chromosome of any length is spread
    over many rows. binary: part as bytes, in which a place is found at once.
    """
    if "piece" in genome.columns:
        return _from_pieces(genome, chunk, halo, binary)
    n = F.length("seq")
    made = genome.where(n > 0).select("chrom", *keep, F.col("seq").cast("binary").alias("_b"), n.cast("long").alias("len"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).alias("chunk"))
    first = F.greatest(F.col("chunk") * chunk + 1 - halo, F.lit(1))
    last = F.least((F.col("chunk") + 1) * chunk + halo, F.col("len"))
    part = F.substring("_b", first.cast("int"), (last - first + 1).cast("int"))
    return made.select("chrom", "chunk", *keep, first.alias("first"), (part if binary else part.cast("string")).alias("part"), "len")


def _from_pieces(genome: DataFrame, chunk: int, halo: int, binary: bool) -> DataFrame:
    """chunked() of pieces: each goes to the chunks that it reaches into, and a chunk joins its few."""
    last = F.col("at") + F.length("piece") - 1
    low = F.greatest(F.floor((F.col("at") - 1 - halo) / chunk), F.lit(0))
    high = F.least(F.floor((last - 1 + halo) / chunk), F.floor((F.col("len") - 1) / chunk))
    each = genome.where(F.length("piece") > 0).withColumn("chunk", F.explode(F.sequence(low, high)))
    first = F.greatest(F.col("chunk") * chunk + 1 - halo, F.lit(1))
    start, stop = F.greatest("at", first), F.least(last, (F.col("chunk") + 1) * chunk + halo)
    cut = F.substring("piece", (start - F.col("at") + 1).cast("int"), (stop - start + 1).cast("int"))
    joined = each.where(start <= stop).groupBy("chrom", F.col("chunk").cast("int").alias("chunk"))
    joined = joined.agg(F.min(first).alias("first"), F.array_sort(F.collect_list(F.struct(start.alias("s"), cut.alias("t")))).alias("_p"), F.first("len").alias("len"))
    part = F.array_join(F.col("_p.t"), "")
    return joined.select("chrom", "chunk", "first", (part.cast("binary") if binary else part).alias("part"), "len")


def with_sequence(rows: DataFrame, genome: DataFrame, pos, length, name: str, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """rows with the bases pos .. pos + length - 1 of their chrom as name, at any length. Bases off the chromosome are missing; a start before the first base, or an unknown chrom, gives an empty string.

    The chunk of its start holds a window of up to halo bases; a fixed length is the halo, and makes chunks short where they
    are left at their default. Of lengths by row, those over the halo are put together from all chunks that they touch.
    """
    fixed = isinstance(length, int)
    if fixed:
        halo = max(length, 1)
        chunk = max(SHORT, 4 * length) if chunk == CHUNK and length < CHUNK // 4 else chunk
    keyed = rows.withColumn("_pos", pos.cast("long")).withColumn("_n", F.lit(length).cast("int") if fixed else length.cast("int"))
    if fixed:
        return _within(keyed, genome, name, chunk, halo).drop("_pos", "_n")
    long = F.coalesce(F.col("_n") > halo, F.lit(False))
    return _within(keyed.where(~long), genome, name, chunk, halo).unionByName(_across(keyed.where(long), genome, name, chunk)).drop("_pos", "_n")


def _within(keyed: DataFrame, genome: DataFrame, name: str, chunk: int, halo: int) -> DataFrame:
    """with_sequence for windows _pos, _n of at most halo bases: one chunk has all of each."""
    keyed = keyed.withColumn("_chunk", F.floor((F.greatest(F.col("_pos"), F.lit(1)) - 1) / chunk).cast("int"))
    parts = chunked(genome, chunk, halo, True).select("chrom", F.col("chunk").alias("_chunk"), F.col("first").alias("_first"), F.col("part").alias("_part"), F.col("len").alias("_len"))
    joined = keyed.join(parts, ["chrom", "_chunk"], "left")
    inside = (F.col("_pos") >= 1) & (F.col("_pos") <= F.col("_len"))
    text = F.when(inside, F.substring("_part", (F.col("_pos") - F.col("_first") + 1).cast("int"), F.greatest(F.col("_n"), F.lit(0))).cast("string")).otherwise("")
    return joined.withColumn(name, F.coalesce(text, F.lit(""))).drop("_chunk", "_first", "_part", "_len")


def _across(keyed: DataFrame, genome: DataFrame, name: str, chunk: int) -> DataFrame:
    """with_sequence for windows _pos, _n of any length: different windows are cut at the chunks' ends and their pieces joined."""
    window = ["chrom", "_pos", "_n"]
    last = F.col("_pos") + F.col("_n") - 1
    touched = F.sequence(F.floor((F.col("_pos") - 1) / chunk).cast("int"), F.floor((last - 1) / chunk).cast("int"))
    cut = keyed.where("_pos >= 1").select(*window).distinct().select(*window, F.explode(touched).alias("_chunk"))
    parts = chunked(genome, chunk, 0).select("chrom", F.col("chunk").alias("_chunk"), F.col("first").alias("_first"), F.col("part").alias("_part"))
    start = F.greatest(F.col("_pos"), F.col("_first"))
    piece = F.substring("_part", (start - F.col("_first") + 1).cast("int"), (last - start + 1).cast("int"))
    pieces = cut.join(parts, ["chrom", "_chunk"]).groupBy(*window).agg(F.array_sort(F.collect_list(F.struct("_chunk", piece.alias("piece")))).alias("_pieces"))
    whole = pieces.select(*window, F.array_join(F.col("_pieces.piece"), "").alias("_whole"))
    return keyed.join(whole, window, "left").withColumn(name, F.coalesce("_whole", F.lit(""))).drop("_whole")


def annotate(sites: DataFrame, genome: DataFrame, lengths=(3, 5)) -> DataFrame:
    """sites (chrom, pos, strand) with base and, for each length k, context_k, as read on the strand. One join fetches the widest window; the others are cut from it."""
    wide = max(lengths)
    half = wide // 2
    rows = with_sequence(sites, genome, F.greatest(F.col("pos") - half, F.lit(1)), wide, "_w")
    shift = F.greatest(half - F.col("pos") + 1, F.lit(0))  # bases missing on the left
    centre = (half + 1 - shift).cast("int")
    rows = rows.withColumn("base", S.strand_base(F.substring("_w", centre, F.lit(1)), F.col("strand")))
    for k in lengths:
        first = centre - k // 2
        cut = F.when(first >= 1, F.substring("_w", first, F.lit(k))).otherwise("")
        rows = rows.withColumn(f"context_{k}", S.strand_context(cut, F.col("strand"), k))
    return rows.drop("_w")


#: Different k-mers that a task holds before it passes on their counts.
HELD = 200_000


def _labels(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, list[tuple]]:
    """A number for each row, by its first n columns, and what the numbers stand for."""
    number = np.zeros(batch.num_rows, "i8")
    for column in batch.columns[:n]:
        coded = column.dictionary_encode("encode")
        number = np.unique(number * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first = np.unique(number, return_index=True)
    return number, [tuple(column[int(r)].as_py() for column in batch.columns[:n]) for r in first]


def kmer_counts(seqs: DataFrame, k: int, by: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """(by..., kmer, n) over all sequences of ASCII letters, step 1; k-mers do not span rows. Each task counts its k-mers by number, in the bytes of a batch; only the counts are shuffled."""
    keys = by or []
    rows = seqs.select(*keys, F.col(seq).cast("binary").alias("_seq"))
    kinds = StructType([*rows.select(*keys).schema, StructField("kmer", StringType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}

        def told() -> pa.RecordBatch:
            columns = list(zip(*((*key, n) for key, n in held.items()), strict=True)) or [()] * len(kinds.names)
            types = [*(f.type for f in given.schema.remove(len(keys))), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], kinds.names)

        given = None
        for batch in batches:
            if not batch.num_rows:
                continue
            given = batch
            number, values = _labels(batch, len(keys))
            for label, kmer, n in zip(*arrays.kmer_table(batch.column(len(keys)), k, number), strict=True):
                key = (*values[label], kmer)
                held[key] = held.get(key, 0) + int(n)
            if len(held) > HELD:
                yield told()
                held.clear()
        if held:
            yield told()

    return rows.mapInArrow(run, kinds).groupBy(*keys, "kmer").agg(F.sum("n").alias("n"))


def genome_kmer_counts(genome: DataFrame, k: int, span_chromosomes: bool = False) -> DataFrame:
    """(kmer, n) over the genome, counted in chunks that reach k - 1 bases over their ends.

    span_chromosomes: as if the chromosomes were joined in the order of chrom, so k-mers run over their ends too. Only what
    stands at the ends of chromosomes, 2 (k - 1) bases each, is put in order for that, over many tasks.
    """
    parts = chunked(genome, CHUNK, k - 1).select("part", (F.col("chunk") * CHUNK + 1 - F.col("first")).cast("int").alias("_before"))
    counts = kmer_counts(parts.select(F.expr("substring(part, _before + 1)").alias("seq")), k)
    if not span_chromosomes or k < 2:
        return counts
    whole = chunked(genome, CHUNK, k - 1)
    at = {"head": F.when(F.col("chunk") == 0, F.left("part", F.lit(k - 1))), "tail": F.when(F.col("chunk") == F.floor((F.col("len") - 1) / CHUNK), F.right("part", F.lit(k - 1)))}
    ends = whole.select("chrom", *[c.alias(name) for name, c in at.items()]).where("head IS NOT NULL OR tail IS NOT NULL")
    ends = ends.groupBy("chrom").agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
    seams = ordered.text_after(ends, "chrom", "head", k - 1)
    # A k-mer over an end starts in the tail, and needs k bases from there.
    seams = seams.select(F.concat("tail", "after").alias("seq"), F.length("tail").alias("t"))
    starts = F.transform(F.sequence(F.lit(1), F.least(F.col("t"), F.length("seq") - k + 1)), lambda i: F.substring("seq", i, F.lit(k)))
    over = seams.where(F.length("seq") >= k).select(F.explode(starts).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(over).groupBy("kmer").agg(F.sum("n").alias("n"))


def base_composition(seqs: DataFrame, by: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """(by..., base, share): share of each letter, rounded half to even at 4 places."""
    keys = by or []
    counts = kmer_counts(seqs, 1, keys, seq)
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.select(*keys, F.col("kmer").alias("base"), F.bround(F.col("n") / total, 4).alias("share"))


def context_counts(sites: DataFrame, context: str, by: list[str] | None = None) -> DataFrame:
    keys = by or []
    return sites.groupBy(*keys, F.col(context).alias("context")).agg(F.count(F.lit(1)).alias("n"))


def signature(observed: DataFrame, background: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., context, ref_norm, total_norm): observed (context, n) over background (kmer, n), and its share of the sum. A context without background has 0. NO_CONTEXT is left out."""
    keys = by or []
    ref = background.select(F.col("kmer").alias("context"), F.col("n").alias("ref"))
    joined = observed.where(F.col("context") != S.NO_CONTEXT).join(ref, "context", "left")
    norm = joined.withColumn("ref_norm", F.coalesce(F.try_divide("n", "ref"), F.lit(0.0)))
    total = norm.groupBy(*keys).agg(F.sum("ref_norm").alias("_total"))  # one row per group of at most 4^k contexts
    summed = norm.join(total, keys) if keys else norm.crossJoin(F.broadcast(total))
    return summed.select(*keys, "context", "ref_norm", F.try_divide("ref_norm", "_total").alias("total_norm"))


def complete(sig: DataFrame, domain: DataFrame) -> DataFrame:
    """The signature in the order of a domain (context, ordinal); contexts never observed have 0."""
    return domain.join(sig, "context", "left").na.fill(0.0, ["ref_norm", "total_norm"])


def expected_total(sig: DataFrame, region_counts: DataFrame) -> DataFrame:
    """One row: expected, the rounded sum over contexts of ref_norm times the region's count, each product rounded to 2 places (half to even)."""
    counts = region_counts.select(F.col("kmer").alias("context"), F.col("n").alias("c"))
    each = sig.join(counts, "context", "left").select(F.bround(F.col("ref_norm") * F.coalesce("c", F.lit(0)), 2).alias("e"))
    return each.agg(F.bround(F.sum("e"), 0).alias("expected"))


def centre_shares(sig: DataFrame, norm: str = "total_norm") -> DataFrame:
    """(base, share): a signature without N, renormalised and summed by centre base, rounded to 2 places."""
    clean = sig.where(~F.col("context").contains("N")).groupBy(S.centre_base(F.col("context")).alias("base")).agg(F.sum(norm).alias("s"))
    return clean.select("base", F.bround(F.col("s") / F.sum("s").over(Window.partitionBy()), 2).alias("share"))
