"""Windows and null models at their whole size."""

import random

from pyspark.sql import functions as F

from siteprofile.operators import contexts, statistics
from siteprofile.plans import pipelines, queries


def letters(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_windows_longer_than_the_halo(spark):
    seqs = {"a": letters(60_000, 1), "b": letters(17_000, 2)}
    genome = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    rows = [("a", p, n) for p in (1, 16_200, 16_384, 16_385, 32_760) for n in (0, 5, 1_100, 1_101, 1_300, 20_000, 50_000)]
    rows += [("a", 16_300, 1_300)] * 2 + [("a", 0, 2_000), ("a", 60_001, 2_000), ("a", None, 2_000), ("b", 16_990, 3_000), ("c", 5, 2_000)]
    table = spark.createDataFrame(rows, "chrom string, pos long, n int")
    want = sorted((c, p or -1, n, seqs.get(c, "")[p - 1 : p - 1 + n] if p else "") for c, p, n in rows)
    out = contexts.with_sequence(table, genome, F.col("pos"), F.col("n"), "seq").collect()
    assert sorted((r.chrom, r.pos or -1, r.n, r.seq) for r in out) == want
    for n in (3, 1_300, 20_000):
        out = contexts.with_sequence(table, genome, F.col("pos"), n, "seq").collect()
        assert sorted((r.chrom, r.pos or -1, r.seq) for r in out) == sorted((c, p or -1, seqs.get(c, "")[p - 1 : p - 1 + n] if p else "") for c, p, _ in rows)


def test_transcript_profile_over_a_chunk_end(spark):
    seq = letters(40_000, 3)
    genome = spark.createDataFrame([("a", seq)], "chrom string, seq string")
    starts = [16_200, 16_250, 16_384, 20_000]
    transcripts = spark.createDataFrame([(i, "a", s + 650, s, s + 9, 1) for i, s in enumerate(starts)], "id long, chrom string, tss long, start long, end long, strand int")
    sites = spark.createDataFrame([(i, "a", s + 650, "+") for i, s in enumerate(starts)], "site_id long, chrom string, pos long, strand string")
    out = {r.rel_pos: r.norm_count for r in pipelines.transcript_profile(sites, transcripts, genome).collect()}
    want = {}
    for s in starts:
        for j, x in enumerate(seq[s - 1 : s + 1299]):
            want[j - 649] = want.get(j - 649, 0) + (x == "G")
    assert {k: v for k, v in out.items() if v} == {k: v for k, v in want.items() if v}


def test_null_models_have_a_thousand_replicates(spark, monkeypatch):
    seen = []
    p = spark.createDataFrame([(1, "+", 4, j, 0.25) for j in range(4)], "id long, strand string, n long, position long, p double")
    real = statistics.multinomial_null
    monkeypatch.setattr(queries.profiles, "window_probabilities", lambda *a, **k: p)
    monkeypatch.setattr(statistics, "multinomial_null", lambda *a: seen.append(a[1]) or real(*a))
    for name in ("pairs", "signature3"):
        monkeypatch.setattr(queries, name, lambda *a, **k: p)
    for name in ("sites", "regions", "genome"):
        monkeypatch.setattr(queries.tables, name, lambda *a, **k: p)
    monkeypatch.setattr(queries.profiles, "window_groups", lambda x: x)
    out = queries.QUERIES["multinomial_null"](spark, "").collect()
    assert len({r.replicate for r in out}) == 1000 and sum(r.n for r in out) == 4000
    monkeypatch.setattr(queries.pipelines, "randomised_peak", lambda *a, **k: (seen.append(a[4]), (p, p))[1])
    queries.QUERIES["randomised_peak"](spark, "")
    assert seen == [1000, 1000]
