"""Positional profiles of sites around anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import arrays
from ..functions import sequence as S
from .contexts import HELD, with_sequence


def observed(pairs: DataFrame, position: Column) -> DataFrame:
    """(position, observed) of sites joined to windows."""
    return pairs.groupBy(position.cast("long").alias("position")).agg(F.count(F.lit(1)).alias("observed"))


def window_groups(pairs: DataFrame) -> DataFrame:
    """(id, strand, chrom, win_start, n) of the sites joined to each window, by strand."""
    return pairs.groupBy("id", "strand").agg(F.first("chrom").alias("chrom"), F.min("r_start").alias("win_start"), F.count(F.lit(1)).alias("n"))


#: Letters that a context may have where a signature is looked up: their places are the digits of its number. All others are one more digit.
LETTERS = "ACGTN"
DIGIT = np.full(256, len(LETTERS), "i8")
DIGIT[[ord(x) for x in LETTERS]] = range(len(LETTERS))


def signature_tables(sig: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The total_norm of each context of k LETTERS by its number, and that of its reverse complement; 0 where it has none. The driver reads 5^k rows at most."""
    rows = sig.where((F.length("context") == k) & F.col("context").rlike(f"^[{LETTERS}]*$")).select("context", F.col("total_norm").cast("double").alias("p")).collect()
    base = len(LETTERS) + 1
    plus, minus = np.zeros(base**k), np.zeros(base**k)
    number = lambda text: sum(int(DIGIT[ord(x)]) * base**i for i, x in enumerate(reversed(text)))
    for context, p in rows:
        plus[number(context)] = p or 0.0
        minus[number(context.translate(str.maketrans("ACGT", "TGCA"))[::-1])] = p or 0.0
    return plus, minus


#: Places of windows that are looked up at a time.
PLACES = 1 << 18


def shares(seq: pa.Array, minus: np.ndarray, width: int, k: int, tables: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, values, sums) for some windows at a time: the values of their places by the signature, as read on the strand, and their sums."""
    data, at = arrays.letters(seq)
    digits = DIGIT[data].reshape(-1, width + k - 1)
    step = max(PLACES // width, 1)
    for low in range(0, len(at) - 1, step):
        d = digits[low : low + step]
        code = np.zeros((len(d), width), "i8")
        for j in range(k):
            code = code * (len(LETTERS) + 1) + d[:, j : j + width]
        back = minus[low : low + step]
        values = np.where(back[:, None], tables[1][code][:, ::-1], tables[0][code]) if back.any() else tables[0][code]
        yield slice(low, low + len(d)), values, values.sum(1)


def sequenced(groups: DataFrame, genome: DataFrame, width: int, k: int = 3, offset: int = 0) -> DataFrame:
    """(id, strand, n, _seq, _minus) of the groups whose window is inside its chromosome, with the width + k - 1 bases from win_start - k // 2 + offset."""
    rows = with_sequence(groups, genome, F.col("win_start") - k // 2 + offset, width + k - 1, "_seq").where(F.length("_seq") == width + k - 1)
    return rows.select("id", "strand", "n", F.col("_seq").cast("binary").alias("_seq"), F.coalesce(F.col("strand") == "-", F.lit(False)).alias("_minus"))


def window_probabilities(groups: DataFrame, genome: DataFrame, sig: DataFrame, width: int, k: int = 3, offset: int = 0, arrays: bool = False) -> DataFrame:
    """(id, strand, n, position, p): for each group the share of each window position by the signature of its context. arrays: one row (id, strand, n, ps) per group, ps null where it is left out.

    The sequence read is width + k - 1 bases from win_start - k // 2 + offset; offset 1 centres context j on the base that
    observed position j counts, offset 0 one base before. Minus-strand groups read the reverse complement. Windows that run
    off their chromosome, and those where no context has a probability, are left out. The contexts of a batch of windows are
    looked up at once, so positions are not shuffled.
    """
    found = probabilities_of(sequenced(groups, genome, width, k, offset), sig, width, k)
    return found if arrays else found.select("id", "strand", "n", F.posexplode("ps").alias("_i", "p")).select("id", "strand", "n", (F.col("_i") + 1).cast("long").alias("position"), "p")


def probabilities_of(rows: DataFrame, sig: DataFrame, width: int, k: int = 3) -> DataFrame:
    """window_probabilities(arrays=True) of sequenced() groups."""
    tables = signature_tables(sig, k)
    kinds = StructType([*rows.select("id", "strand", "n").schema, StructField("ps", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, values, sums in shares(batch.column(3), batch.column(4).to_numpy(zero_copy_only=False), width, k, tables):
                none = sums <= 0
                flat = values / np.where(none, 1.0, sums)[:, None]
                ps = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype="i4") * width), pa.array(flat.ravel()), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([*(c[some] for c in batch.columns[:3]), ps], kinds.names)

    return rows.mapInArrow(run, kinds)


def expected_of(rows: DataFrame, sig: DataFrame, width: int, k: int = 3) -> DataFrame:
    """expected() of sequenced() groups: each task sums the sites of its windows by position as it looks them up."""
    tables = signature_tables(sig, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(width), False
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            for some, values, sums in shares(batch.column(3), batch.column(4).to_numpy(zero_copy_only=False), width, k, tables):
                good = sums > 0
                any_ = any_ or bool(good.any())
                total += np.where(good, n[some] / np.where(good, sums, 1.0), 0.0) @ values
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, width + 1)), pa.array(total)], ["position", "expected"])

    return rows.mapInArrow(run, "position long, expected double").groupBy("position").agg(F.sum("expected").alias("expected"))


def expected(probabilities: DataFrame) -> DataFrame:
    """(position, expected): the sites of each group spread by its probabilities, by position or as arrays, and summed."""
    if "ps" in probabilities.columns:
        probabilities = probabilities.select("n", F.posexplode("ps").alias("_i", "p")).select("n", "p", (F.col("_i") + 1).cast("long").alias("position"))
    return probabilities.groupBy("position").agg(F.sum(F.col("p") * F.col("n")).alias("expected"))


def relative_increase(obs: DataFrame, exp: DataFrame | None = None) -> DataFrame:
    """obs with rel_inc: what is observed beyond the expected, over that; expected comes from exp by position where it is not in obs."""
    both = obs if exp is None else obs.join(exp, "position")
    return both.withColumn("rel_inc", F.try_divide(F.col("observed") - F.col("expected"), F.col("expected")))


def densify(profile: DataFrame, low: int, high: int, value: str, position: str = "position") -> DataFrame:
    """The profile with a row for each position from low to high; missing values are 0."""
    all_ = profile.sparkSession.range(low, high + 1).withColumnRenamed("id", position)
    return all_.join(profile, position, "left").select(position, F.coalesce(value, F.lit(0)).alias(value))


def window_sequences(windows: DataFrame, genome: DataFrame, width: int) -> DataFrame:
    """windows with seq, their width bases from start (1-based); windows cut short are left out."""
    return with_sequence(windows, genome, F.col("start"), width, "seq").where(F.length("seq") == width)


def composition(seqs: DataFrame, k: int = 1) -> DataFrame:
    """(offset, kmer, n): what stands at each offset (from 0) of equally long sequences of ASCII letters, counted in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], int] = {}
        for batch in batches:
            for offset, kmer, n in zip(*arrays.kmer_table(batch.column(0), k), strict=True):
                held[int(offset), kmer] = held.get((int(offset), kmer), 0) + int(n)
            if len(held) > HELD:
                yield told(held)
                held = {}
        yield told(held)

    def told(held: dict[tuple[int, str], int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o for o, _ in held], pa.int64()), pa.array([m for _, m in held], pa.string()), pa.array(held.values(), pa.int64())], ["offset", "kmer", "n"])

    counts = seqs.select(F.col("seq").cast("binary")).mapInArrow(run, "offset long, kmer string, n long")
    return counts.groupBy("offset", "kmer").agg(F.sum("n").alias("n"))


def pair_composition(seqs: DataFrame) -> DataFrame:
    """(offset, kmer, n) with the two pairs that each base is part of: the one that starts at the offset and the one that ends there."""
    pairs = composition(seqs, 2)
    return pairs.unionByName(pairs.withColumn("offset", F.col("offset") + 1)).groupBy("offset", "kmer").agg(F.sum("n").alias("n"))


def chunk_counts(seqs: DataFrame, k: int = 3) -> DataFrame:
    """(kmer, n) over the pieces of k bases that follow each other in each sequence."""
    return seqs.select(F.explode(S.chunks(F.col("seq"), k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def per_base_enrichment(obs: DataFrame, comp: DataFrame, base: str, shift: int = 0, width: int | None = None) -> DataFrame:
    """(position, norm, norm_2): observed over the windows' number of the base at position - shift, and its share of the sum.

    width: positions of obs are counted from the right edge of windows of so many bases, and so are those of the base; without
    it the base's are counted from the left whatever obs does, as the analyses have it.
    """
    at = F.col("offset") if width is None else width - 1 - F.col("offset")
    ref = comp.where(F.col("kmer") == base).select((at + shift).alias("position"), F.col("n").alias("_n"))
    norm = obs.join(ref, "position").select("position", (F.col("observed") / F.col("_n")).alias("norm"))
    return norm.withColumn("norm_2", F.col("norm") / F.sum("norm").over(Window.partitionBy()))  # one row per window position


def random_model(comp: DataFrame, base: str) -> DataFrame:
    """(position, model): share of the base's occurrences at each offset."""
    rows = comp.groupBy(F.col("offset").alias("position")).agg(F.sum(F.when(F.col("kmer") == base, F.col("n")).otherwise(0)).alias("_n"))
    return rows.select("position", (F.col("_n") / F.sum("_n").over(Window.partitionBy())).alias("model"))


def anchored(counts: DataFrame, background: DataFrame) -> DataFrame:
    """(rel_pos, count, norm_count, normalized) of sites counted around anchors, full join with the background; normalized is null where the background is 0."""
    joined = counts.join(background, "rel_pos", "full").na.fill(0, ["count", "norm_count"])
    return joined.select("rel_pos", "count", "norm_count", F.try_divide("count", "norm_count").alias("normalized"))


def with_model(enrichment: DataFrame, model: DataFrame) -> DataFrame:
    """Per-base enrichment with the random model of the same position; positions that one lacks go."""
    return enrichment.join(model, "position")


def recentred(profile: DataFrame, centre: int, position: str = "position") -> DataFrame:
    """The profile with positions counted from centre."""
    return profile.withColumn(position, F.col(position) - centre)


def of_study(sites: DataFrame, study: str, base: str = "base", mer: str = "mer") -> DataFrame:
    """The sites of a base, or of a motif: those whose bases around the middle of mer are the motif, by its right or its left middle."""
    if len(study) == 1:
        return sites.where(F.col(base) == study)
    return sites.where((S.motif_window(F.col(mer), len(study), "right") == study) | (S.motif_window(F.col(mer), len(study), "left") == study))
