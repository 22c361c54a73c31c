"""Sites and regions counted along chunks of the genome, against plain loops, and plans without a row for each pair."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteprofile.functions import arrays
from siteprofile.operators import contexts, profiles, tracks
from siteprofile.plans import pipelines

COMPLEMENT = str.maketrans("ACGT", "TGCA")


@pytest.fixture(autouse=True)
def short_chunks(monkeypatch):
    monkeypatch.setattr(tracks, "CHUNK", 64)
    monkeypatch.setattr(tracks, "HELD", 50)
    monkeypatch.setattr(tracks, "BYTES", 300)
    monkeypatch.setattr(tracks, "PAIRS", 20)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def genome_of(seed: int) -> dict:
    rng = random.Random(seed)
    return {c: "".join(rng.choices("ACGTNZ", [6, 6, 6, 6, 1, 1], k=n)) for c, n in (("a", 500), ("b", 64), ("c", 65), ("d", 2), ("e", 0))}


def tables_of(spark, seed: int, n_sites: int = 400, n_regions: int = 150, most: int = 90):
    """A genome, sites and regions with equal ones, at and over the chromosomes' ends, on unknown chromosomes, and with nulls."""
    rng = random.Random(seed)
    genome = genome_of(seed)
    sites = [(rng.choice("aaabcdex"), rng.randint(1, 510) if rng.random() < 0.6 else rng.choice((1, 2, 64, 65, 66, 129, 500)), rng.choice(["+", "-", None])) for _ in range(n_sites)]
    sites += [("a", 64, "-")] * 50 + [(None, 5, "+"), ("a", None, "+")]
    regions = []
    for i in range(n_regions):
        start = rng.randint(-5, 520)
        regions.append((i, rng.choice("aaabcdx"), start, start + rng.choice((0, 1, 3, most, -2, 400)), rng.choice(["u", "v", None])))
    regions += [(900, "a", 60, 70, "u")] * 3 + [(901, None, 1, 50, "u"), (902, "a", None, 50, "u")]
    dfs = (
        spark.createDataFrame([(c, s, s[:1]) for c, s in genome.items()], "chrom string, seq string, group string"),
        spark.createDataFrame(sites, "chrom string, pos long, strand string").repartition(3),
        spark.createDataFrame(regions, "id long, chrom string, start long, end long, kind string").repartition(3),
    )
    return genome, sites, regions, dfs


def context(genome: dict, chrom, pos, strand, k: int):
    if chrom not in genome or pos is None or pos <= k // 2:
        return None
    w = genome[chrom][pos - k // 2 - 1 : pos + k // 2]
    if len(w) < k or strand == "-" and set(w) - set("ACGT"):
        return None
    return w.translate(COMPLEMENT)[::-1] if strand == "-" else w


def inside(site, region) -> bool:
    return None not in (site[0], site[1], region[1], region[2]) and site[0] == region[1] and region[2] < site[1] <= region[3]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_contexts_by_genome_and_in_regions(spark, k):
    genome, sites, regions, (g, s, r) = tables_of(spark, k)
    want = Counter((genome[c][:1], w) for c, p, t in sites if (w := context(genome, c, p, t, k)))
    got = tracks.contexts_of(s, g, k, ["group"])
    assert {(x["group"], x.context): x.n for x in got.collect()} == want
    annotated = contexts.context_counts(contexts.annotate(s.where("chrom <> 'x' AND pos IS NOT NULL"), g, (k,)), f"context_{k}").where("context <> '-'")
    assert {x.context: x.n for x in tracks.contexts_of(s, g, k).collect()} == {x.context: x.n for x in annotated.collect()}
    want = Counter((x[4], w) for x in regions for y in sites if inside(y, x) and (w := context(genome, *y, k)))
    assert {(x.kind, x.context): x.n for x in tracks.contexts_in(s, r, g, k, ["kind"]).collect()} == want


@pytest.mark.parametrize("k", [1, 3, 5])
@pytest.mark.parametrize("cells", [arrays.CELLS, 0])
def test_kmers_in_regions(spark, monkeypatch, k, cells):
    monkeypatch.setattr(arrays, "CELLS", cells)
    _, _, _, (g, _, r) = tables_of(spark, 10 + k)
    pos, length = F.col("start") - 1, F.col("end") - F.col("start") + 4
    want = contexts.kmer_counts(contexts.with_sequence(r, g, pos, length, "seq"), k, ["kind"])
    got = tracks.kmers_in(r, g, pos, length, k, ["kind"])
    assert {(x.kind, x.kmer): x.n for x in got.collect()} == {(x.kind, x.kmer): x.n for x in want.collect()}
    total = Counter()
    for x in want.collect():
        total[x.kmer] += x.n
    assert {x.kmer: x.n for x in tracks.kmers_in(r, g, pos, length, k).collect()} == total


@pytest.mark.parametrize("mirror", [False, True])
def test_profiles_without_pairs(spark, mirror):
    genome, sites, regions, (g, s, r) = tables_of(spark, 20 + mirror)
    width = 30
    windows = r.where("start >= 1 AND chrom IS NOT NULL").withColumn("id", F.monotonically_increasing_id()).withColumn("end", F.col("start") + width)
    sig = spark.createDataFrame([(x, random.Random(x).random()) for x in ("ACG", "CGT", "TTT", "GAN", "CCA", "TGA")], "context string, total_norm double")
    pairs = s.join(windows.select("id", F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start")), F.expr("chrom = r_chrom AND r_start < pos AND pos <= r_start + 30"))
    position = F.col("pos") - F.col("r_start")
    seen = profiles.observed(pairs, F.when(F.col("strand") == "-", width + 1 - position).otherwise(position) if mirror else position)
    share = profiles.expected_of(profiles.sequenced(profiles.window_groups(pairs), g, width), sig, width)
    want = {x.position: (x.observed, x.expected) for x in seen.join(share, "position", "left").collect()}
    got = {x.position: (x.observed, x.expected) for x in tracks.profile_in(s, windows, g, sig, width, mirror_minus=mirror).collect()}
    assert {p: x[0] for p, x in got.items()} == {p: x[0] for p, x in want.items()} and len(want) == width
    assert [got[p][1] for p in sorted(got)] == pytest.approx([want[p][1] for p in sorted(want)])
    if not mirror:
        assert {x.position: x.observed for x in tracks.observed_in(s, windows, width).collect()} == {p: x[0] for p, x in want.items()}
        of_base = Counter(p - w for c, p, t in sites for i, o, w, *_ in regions if None not in (c, p, w) and c == o and w >= 1 and w < p <= w + width and context(genome, c, p, t, 1) == "C")
        assert {x.position: x.observed for x in tracks.observed_in(s, windows, width, g, "C").collect()} == of_base
    comp = {(x.offset, x.kmer): x.n for x in profiles.composition(profiles.window_sequences(windows, g, width)).collect()}
    assert {(x.offset, x.kmer): x.n for x in tracks.composition_in(windows, g, width).collect()} == comp


def test_nothing_to_count(spark):
    _, _, _, (g, s, r) = tables_of(spark, 30)
    none, sig = r.where("id < 0"), spark.createDataFrame([("ACG", 0.0)], "context string, total_norm double")
    assert tracks.contexts_in(s, none, g, 3, ["kind"]).count() == tracks.kmers_in(none, g, F.col("start"), F.lit(9), 3).count() == 0
    assert tracks.observed_in(s, none, 30).count() == tracks.composition_in(none, g, 30).count() == 0
    assert tracks.contexts_of(s.where("pos < 0"), g, 3).count() == 0
    assert all(x.expected is None for x in tracks.profile_in(s, r.where("start >= 1"), g, sig, 30).collect())


def test_no_row_for_each_pair(spark):
    """Ten thousand equal sites in a thousand equal regions are one number in a chunk, where a join would make ten million rows."""
    _, _, _, (g, _, _) = tables_of(spark, 40)
    s = spark.range(10_000).select(F.lit("a").alias("chrom"), F.lit(100).cast("long").alias("pos"), F.lit("+").alias("strand"))
    r = spark.range(1_000).select("id", F.lit("a").alias("chrom"), F.lit(100).cast("long").alias("center"), F.lit("u").alias("class"))
    whole = spark.createDataFrame([("ACG", 1.0)], "context string, total_norm double")
    profile = pipelines.nucleosome_profile(s, r, g, whole, 20, 21)
    regions = r.withColumn("start", F.lit(90).cast("long")).withColumn("end", F.lit(120).cast("long"))
    compared = pipelines.region_comparison(s, g, regions, whole)
    for df in (profile, compared):
        assert "_bin" not in plan(df)
    assert [tuple(x) for x in tracks.observed_in(s, r.withColumn("start", F.lit(80).cast("long")), 41).collect()] == [(20, 10_000_000)]
    assert sum(x.n for x in tracks.contexts_in(s, regions, g, 1, ["class"]).collect()) == 10_000_000


def test_tally_with_weights_and_strands(monkeypatch):
    rng = np.random.default_rng(2)
    data = np.frombuffer(b"ACGTNACCA" * 30, "u1")
    here = np.flatnonzero(rng.random(len(data) - 5) < 0.5)
    label, weight, minus = rng.integers(0, 3, len(here)), rng.integers(1, 1 << 40, len(here)), rng.random(len(here)) < 0.5
    text = data.tobytes().decode()
    want = Counter()
    for h, a, w, m in zip(here, label, weight, minus, strict=True):
        x = text[h : h + 5]
        want[int(a), x.translate(COMPLEMENT)[::-1] if m else x] += int(w)
    for cells in (arrays.CELLS, 0):
        monkeypatch.setattr(arrays, "CELLS", cells)
        assert {(int(a), x): int(n) for a, x, n in zip(*arrays.tally(data, here, 5, label, weight, minus), strict=True)} == want
