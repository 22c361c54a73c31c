"""Column functions on nucleotide sequences. Positions are 1-based, as in Spark's substring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")
#: Stands for a context that runs off its chromosome or cannot be complemented.
NO_CONTEXT = "-"


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def strand_base(base: Column, strand: Column) -> Column:
    """The base as read on the strand; null for other letters on the minus strand."""
    return F.when(strand == "-", F.when(base.isin(*BASES), complement(base))).otherwise(base)


def strand_context(window: Column, strand: Column, k: int) -> Column:
    """A k-base window as read on the strand; NO_CONTEXT if it is cut short, or is on the minus strand and has other letters than ACGT."""
    whole = F.length(window) == k
    minus = F.when(window.rlike("^[ACGT]*$"), reverse_complement(window)).otherwise(NO_CONTEXT)
    return F.when(~F.coalesce(whole, F.lit(False)), NO_CONTEXT).when(strand == "-", minus).otherwise(window)


def window_at(seq: Column, pos: Column, k: int) -> Column:
    """The k bases centred on pos; empty where they would start before the first base."""
    first = pos - k // 2
    return F.when(first >= 1, F.substring(seq, first.cast("int"), F.lit(k))).otherwise("")


def _pieces(seq: Column, k: int, step: int, last: Column) -> Column:
    """The k bases at 1, 1 + step, ... up to last. They are cut from the bytes of the sequence, which are made once a row: a place in a string would be searched from its start each time."""
    cut = F.transform(F.array(seq.cast("binary")), lambda b: F.transform(F.sequence(F.lit(1), last, F.lit(step)), lambda i: F.substring(b, i, F.lit(k)).cast("string")))[0]
    return F.when(last >= 1, cut).otherwise(F.array().cast("array<string>"))


def kmers(seq: Column, k: int) -> Column:
    """Array of the k-mers of a sequence of ASCII letters, step 1; empty for sequences shorter than k."""
    return _pieces(seq, k, 1, F.length(seq) - k + 1)


def chunks(seq: Column, k: int) -> Column:
    """Array of the pieces of k bases that follow each other; the last may be shorter."""
    return _pieces(seq, k, k, F.length(seq))


def mer_context(mer: Column, k: int) -> Column:
    """The k middle bases of an embedded 21-mer."""
    return F.substring(mer, 11 - k // 2, k)


def motif_window(mer: Column, motif_length: int, side: str = "right") -> Column:
    """As many bases around the middle of mer as the motif has: centred if odd; if even, from length/2 - 1 (right) or length/2 (left) before the middle."""
    before = motif_length // 2 - (1 if motif_length % 2 == 0 and side == "right" else 0)
    return F.substring(mer, (F.floor(F.length(mer) / 2) + 1 - before).cast("int"), F.lit(motif_length))


def centre_base(context: Column) -> Column:
    return F.substring(context, (F.floor(F.length(context) / 2) + 1).cast("int"), F.lit(1))


def padded_before(seq: Column, pos: Column, n: int) -> Column:
    """The n bases before pos; N where the sequence has none."""
    first = F.greatest(pos - n, F.lit(1))
    return F.lpad(F.substring(seq, first.cast("int"), F.greatest(pos - first, F.lit(0)).cast("int")), n, "N")


def contexts(spark: SparkSession, k: int, centre: str | None = None) -> DataFrame:
    """All contexts of length k (odd) in the order centre, then flanks, with their number: 4^k rows, or 4^(k-1) with the centre given."""
    if k % 2 == 0:
        raise ValueError("a context has a centre, so its length is odd")
    free = k - 1 if centre else k
    ordinal = spark.range(4**free).withColumnRenamed("id", "ordinal")
    letter = lambda place: F.element_at(F.array(*[F.lit(b) for b in BASES]), (F.shiftright(F.col("ordinal"), 2 * (free - 1 - place)).bitwiseAND(F.lit(3)) + 1).cast("int"))
    digits = [letter(i) for i in range(free)]
    middle = F.lit(centre) if centre else digits.pop(0)
    half = k // 2
    return ordinal.select(F.concat(*digits[:half], middle, *digits[half:]).alias("context"), "ordinal")


#: The names of the chromosomes and their numbers.
CHROMOSOMES = {
    "chrI": 1, "chrII": 2, "chrIII": 3, "chrIV": 4, "chrV": 5, "chrVI": 6, "chrVII": 7, "chrVIII": 8, "chrIX": 9,
    "chrX": 10, "chrXI": 11, "chrXII": 12, "chrXIII": 13, "chrXIV": 14, "chrXV": 15, "chrXVI": 16, "chrM": 17, "chrmt": 17,
}


def chromosome_number(name: Column) -> Column:
    """Number of a chromosome name; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CHROMOSOMES.items() for x in pair]), name)


def chromosome_name(number: Column) -> Column:
    """Name of a chromosome number (17: chrM); null for others."""
    named = {v: k for k, v in reversed(CHROMOSOMES.items())}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), number)
