from pyspark.sql import functions as F

from siteprofile.functions import sequence as S
from siteprofile.operators import contexts


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_kmers_and_complement(spark):
    r = one(spark, S.kmers(F.lit("ACGTA"), 3), S.kmers(F.lit("AC"), 3), S.kmers(F.lit(""), 3), S.reverse_complement(F.lit("AACGN")), S.chunks(F.lit("ACGTA"), 3))
    assert list(r) == [["ACG", "CGT", "GTA"], [], [], "NCGTT", ["ACG", "TA"]]
    assert one(spark, S.reverse_complement(S.reverse_complement(F.lit("ACGTTNA"))))[0] == "ACGTTNA"


def test_names(spark):
    assert list(one(spark, S.chromosome_number(F.lit("chrIX")), S.chromosome_number(F.lit("chrmt")), S.chromosome_number(F.lit("x")), S.chromosome_name(F.lit(17)))) == [9, 17, None, "chrM"]


def test_windows(spark):
    mer = F.lit("ABCDEFGHIJKLMNOPQRSTU")
    assert list(one(spark, S.mer_context(mer, 3), S.mer_context(mer, 5), S.motif_window(mer, 2), S.motif_window(mer, 2, "left"), S.motif_window(mer, 4), S.motif_window(mer, 4, "left"))) == ["JKL", "IJKLM", "KL", "JK", "JKLM", "IJKL"]
    assert list(one(spark, S.padded_before(F.lit("ACGT"), F.lit(3), 4), S.padded_before(F.lit("ACGT"), F.lit(1), 2), S.centre_base(F.lit("ACGTN")))) == ["NNAC", "NN", "G"]


def test_domain(spark):
    assert [r.context for r in S.contexts(spark, 3).orderBy("ordinal").limit(6).collect()] == ["AAA", "AAC", "AAG", "AAT", "CAA", "CAC"]
    assert {r.context[1] for r in S.contexts(spark, 3, "G").collect()} == {"G"} and S.contexts(spark, 5).count() == 1024


def test_annotate(spark):
    genome = spark.createDataFrame([("a", "ACGTNACGT"), ("b", "AC"), ("c", "")], "chrom string, seq string")
    sites = spark.createDataFrame([("a", 1, "+"), ("a", 2, "+"), ("a", 2, "-"), ("a", 3, "-"), ("a", 4, "+"), ("a", 4, "-"), ("a", 9, "-"), ("b", 1, "+"), ("x", 5, "+"), ("a", 50, "+")], "chrom string, pos long, strand string")
    got = {(r.chrom, r.pos, r.strand): (r.base, r.context_3, r.context_5) for r in contexts.annotate(sites, genome).collect()}
    assert got == {
        ("a", 1, "+"): ("A", "-", "-"), ("a", 2, "+"): ("C", "ACG", "-"), ("a", 2, "-"): ("G", "CGT", "-"), ("a", 3, "-"): ("C", "ACG", "-"),
        ("a", 4, "+"): ("T", "GTN", "CGTNA"), ("a", 4, "-"): ("A", "-", "-"), ("a", 9, "-"): ("A", "-", "-"), ("b", 1, "+"): ("A", "-", "-"), ("x", 5, "+"): ("", "-", "-"), ("a", 50, "+"): ("", "-", "-"),
    }


def test_counts_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(contexts, "CHUNK", 4)
    genome = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "G"), (3, "TTACG")], "chrom long, seq string")
    texts = [r.seq for r in genome.collect()]
    for span in (False, True):
        for k in (1, 3, 5):
            joined = ["".join(texts)] if span else texts
            want = {}
            for t in joined:
                for i in range(len(t) - k + 1):
                    want[t[i : i + k]] = want.get(t[i : i + k], 0) + 1
            assert {r.kmer: r.n for r in contexts.genome_kmer_counts(genome, k, span).collect()} == want


def test_signature(spark):
    obs = spark.createDataFrame([("ACG", 4), ("CCG", 2), ("-", 9), ("TTT", 5)], "context string, n long")
    bg = spark.createDataFrame([("ACG", 8), ("CCG", 2)], "kmer string, n long")
    sig = {r.context: (r.ref_norm, round(r.total_norm, 9)) for r in contexts.signature(obs, bg).collect()}
    assert sig == {"ACG": (0.5, round(1 / 3, 9)), "CCG": (1.0, round(2 / 3, 9)), "TTT": (0.0, 0.0)}
