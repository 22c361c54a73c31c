"""Nested bins, and neighbours, runs and seams over long orders, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from siteprofile.operators import contexts, intervals, ordered


def spans(rng, n, most):
    out = []
    for i in range(n):
        start = rng.randint(0, 5000)
        out.append((i, rng.choice("ab"), start, start + rng.choice([0, 1, 1, 5, 60, 700, most])))
    return out


@pytest.mark.parametrize(("left_most", "right_most"), [(1, 4000), (4000, 1), (4000, 4000), (1, 60)])
def test_nested_bins_against_nested_loops(spark, left_most, right_most):
    rng = random.Random(left_most + right_most)
    left = [r for r in spans(rng, 120, left_most) if r[3] - r[2] <= left_most]
    right = [r for r in spans(rng, 80, right_most) if r[3] - r[2] <= right_most]
    l = spark.createDataFrame([*left, (900, "a", None, None), (901, None, 1, 9)], "i long, chrom string, start long, end long")
    r = spark.createDataFrame([*right, (900, "a", None, 7)], "j long, chrom string, start long, end long")
    want = sorted((a[0], b[0], min(a[3], b[3]) - max(a[2], b[2])) for a in left for b in right if a[1] == b[1] and min(a[3], b[3]) > max(a[2], b[2]))
    alone = sorted(({a[0] for a in left} | {900, 901}) - {w[0] for w in want})
    for known in ({}, {"left_longest": left_most, "right_longest": right_most}):
        for broadcast in (True, False):
            rows = intervals.overlap_join(l, r, bin_size=16, broadcast=broadcast, **known).select("i", "j", "overlap").collect()
            assert sorted(tuple(x) for x in rows) == want
            outer = intervals.overlap_join(l, r, "left", 16, broadcast, **known).select("i", "j", "overlap").collect()
            assert sorted(tuple(x) for x in outer if x.j is not None) == want
            assert sorted((x.i, x.overlap) for x in outer if x.j is None) == [(i, 0) for i in alone]


def test_rows_for_an_interval_are_bounded(spark):
    """An interval of any length touches two bins of its level at most, and few of those above."""
    rng = random.Random(2)
    rows = [(s := rng.randint(0, 10**9), s + rng.randint(1, 4**i)) for i in range(1, 15) for _ in range(50)]
    table = spark.createDataFrame(rows, "start long, end long").withColumn("own", intervals.level(F.col("start"), F.col("end"), 1024))
    each = [F.size(intervals.bins(F.col("start"), F.col("end"), F.col("own") + up, 1024)) for up in range(3)]
    assert table.select(F.max(F.greatest(*each))).first()[0] <= 2
    assert table.where(F.col("end") - F.col("start") <= 1024).agg(F.max("own")).first()[0] == 0


def test_beside_over_many_blocks(spark):
    rng = random.Random(3)
    rows = [(c, x, y) for c in "ab" for x in rng.sample(range(-300, 4000), 150) for y in range(rng.choice([1, 1, 3]))]
    rows += [("c", 5, 0), ("a", 10**9, 0)]
    table = spark.createDataFrame(rows, "part string, at long, tie long").repartition(5)
    got = ordered.beside(table, ["part"], ["at", "tie"], ["at", "tie"], block=8).collect()
    by = {c: sorted(r[1:] for r in rows if r[0] == c) for c in "abc"}
    for r in got:
        own = by[r.part]
        i = own.index((r.at, r.tie))
        assert (tuple(r.prev) if r.prev else None) == (own[i - 1] if i else None)
        assert (tuple(r.next) if r.next else None) == (own[i + 1] if i + 1 < len(own) else None)
    assert len(got) == len(rows)


def test_one_long_chromosome_is_many_tasks(spark):
    """Every window of the plan has a partition, and no block holds the chromosome."""
    start = F.col("id") * 10
    chrom = F.when(F.col("id") >= 0, "a").alias("chrom")
    table = spark.range(20_000).select(chrom, F.col("id").alias("row"), start.alias("start"), (start + 12).alias("end"))
    near = ordered.beside(table, ["chrom"], ["row"], ["start"], block=500)
    plan = near._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert near.where("next.start = start + 10 AND prev.start = start - 10").count() == 19_998
    cut = intervals.clean_overlaps(table)
    assert cut.where("row > 0 AND row < 19999 AND start = row * 10 + 1 AND end = row * 10 + 11").count() == 19_998


@pytest.mark.parametrize("block", [4, 16, 1000])
def test_islands_over_blocks(spark, block):
    rng = random.Random(block)
    values = [(c, v) for c in "ab" for v in rng.choices(range(-40, 200), k=200)] + [("a", v) for v in range(300, 421)] + [("b", 10**12)]
    got = sorted(tuple(r) for r in intervals.islands(spark.createDataFrame(values, "k string, v long"), ["k"], "v", block).select("k", "first", "last", "n").collect())
    want = []
    for c, v in sorted(set(values)):
        if want and want[-1][0] == c and want[-1][2] == v - 1:
            want[-1] = (c, want[-1][1], v, want[-1][3] + 1)
        else:
            want.append((c, v, v, 1))
    assert got == want


def test_kmers_over_chromosome_ends(spark):
    rng = random.Random(6)
    seqs = {f"c{i:03}": "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))) for i in range(90)}
    seqs["c050"] = "".join(rng.choice("ACGT") for _ in range(40_000))
    genome = spark.createDataFrame(list(seqs.items()), "chrom string, seq string").repartition(7)
    for k in (1, 3, 5):
        for spans_ends, texts in ((False, list(seqs.values())), (True, ["".join(s for _, s in sorted(seqs.items()))])):
            want = {}
            for t in texts:
                for i in range(len(t) - k + 1):
                    want[t[i : i + k]] = want.get(t[i : i + k], 0) + 1
            assert {r.kmer: r.n for r in contexts.genome_kmer_counts(genome, k, spans_ends).collect()} == want
