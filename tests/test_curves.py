"""Two-sample tests, adapters, splines, densities and spectra against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteprofile.operators import adapters, levels, profiles, smoothing, spectral
from siteprofile.plans import pipelines

READS = "chrom string, strand string, pos long, treated boolean, level double"


def plain_two_sample(a, b):
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    n, m, pooled = len(a), len(b), a + b
    ties = sum(pooled.count(v) ** 3 - pooled.count(v) for v in set(pooled))
    s = math.sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1))))
    z = (u - n * m / 2) / s if s else None
    ks = max(abs(sum(x <= v for x in a) / n - sum(y <= v for y in b) / m) for v in pooled)
    x = ks * math.sqrt(n * m / (n + m))
    p_ks = 1.0 if x < 0.2 else min(1.0, max(0.0, sum((2 if k % 2 else -2) * math.exp(-2 * k * k * x * x) for k in range(1, 51))))
    return u, z, ks, None if z is None else math.erfc(abs(z) / math.sqrt(2)), p_ks


def test_two_sample_against_all_pairs(spark):
    rng = random.Random(1)
    rows, sites = [], {}
    for pos in [10, 11, 12, 14, 15, 30, 31]:
        a = [rng.choice([rng.gauss(0, 1), 0.5, -0.5]) for _ in range(rng.randint(20, 60))]
        b = [rng.choice([rng.gauss(pos % 3, 1), 0.5]) for _ in range(rng.randint(20, 60))]
        if pos == 31:
            a, b = [2.0] * 25, [2.0] * 25
        sites[pos] = plain_two_sample(a, b)
        rows += [("c", "+", pos, True, x) for x in a] + [("c", "+", pos, False, x) for x in b]
    rows += [("c", "+", 13, i < 19, float(i)) for i in range(60)]  # one read short
    rows += [("c", "+", 10, None, 1.0), ("c", "+", 10, True, None), ("c", "+", 10, True, float("nan"))]
    tested = levels.fisher(levels.two_sample(spark.createDataFrame(rows, READS).repartition(5)))
    got = {r.pos: r for r in tested.collect()}
    assert set(got) == set(sites)
    for pos, want in sites.items():
        for v, w in zip((got[pos].u, got[pos].z, got[pos].ks, got[pos].p_u, got[pos].p_ks), want, strict=True):
            assert v == (None if w is None else pytest.approx(w, abs=1e-9)), pos
        near = [sites[p][4] for p in sites if abs(p - pos) <= 2]
        h = -sum(math.log(max(p, 2.3e-308)) for p in near)
        assert got[pos].n_combined == len(near)
        assert got[pos].p_combined == pytest.approx(min(1, math.exp(-h) * sum(h**i / math.factorial(i) for i in range(len(near)))), abs=1e-9)
    assert levels.two_sample(spark.createDataFrame([], READS)).collect() == []


def test_crowded_site(spark):
    """A site with most of the reads: its cells of levels are apart, and the result is that of sorting them."""
    reads = spark.range(60_000).select(
        F.lit("c").alias("chrom"), F.lit("+").alias("strand"), F.when(F.col("id") < 59_000, 5).otherwise(F.col("id") % 9).cast("long").alias("pos"),
        (F.col("id") % 3 == 0).alias("treated"), (F.pmod(F.xxhash64("id"), F.lit(10_007)) + F.when(F.col("id") % 3 == 0, 40).otherwise(0)).cast("double").alias("level"),
    )
    got = next(r for r in levels.two_sample(reads).collect() if r.pos == 5)
    own = reads.where("pos = 5").select("treated", "level").toPandas()
    a, b = np.sort(own.level[own.treated]), np.sort(own.level[~own.treated])
    assert got.u == np.searchsorted(b, a, "left").sum() + 0.5 * (np.searchsorted(b, a, "right") - np.searchsorted(b, a, "left")).sum()
    at = np.concatenate([a, b])
    assert got.ks == pytest.approx(np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        above, row = row, [i]
        for j, t in enumerate(b, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (c != t)))
    return row[-1]


def plain_end(text, adapter, rate, least):
    m = len(adapter)
    whole = [(e, j) for j in range(len(text) + 1) for i in range(max(0, j - 2 * m), j + 1) if (e := edits(adapter, text[i:j])) <= int(rate * m)]
    if whole:
        return min(whole)[1]
    for k in range(m - 1, least - 1, -1):
        e, j = min((edits(adapter[m - k :], text[:j]), j) for j in range(min(len(text), m + int(rate * m)) + 1))
        if e <= int(rate * k):
            return j
    return -1


def test_adapters_against_all_alignments(spark, monkeypatch):
    monkeypatch.setattr(adapters, "WINDOW", 16)
    rng = random.Random(2)
    adapter = "GATTACAGC"

    def noisy(s):
        s = list(s)
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.choice([0, 1])] = rng.choice(["", "A", "T"])
        return "".join(s)

    texts = ["", "G", adapter, adapter[3:], "A" * 50, "é😀" + adapter]
    for _ in range(120):
        body = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40)))
        kind = rng.randrange(3)
        texts.append(body if kind == 0 else body[: rng.randrange(len(body) + 1)] + noisy(adapter) + body if kind == 1 else noisy(adapter[rng.randrange(6) :]) + body)
    for rate, least in ((0.0, 9), (0.12, 5), (0.25, 4)):
        want = [plain_end(t, adapter, rate, least) for t in texts]
        assert adapters.match_ends(texts, adapter, rate, least) == want
        assert any(w > 0 for w in want) and any(w < 0 for w in want)
    table = spark.createDataFrame([*enumerate(texts), (999, None)], "i long, t string").repartition(3)
    got = {r.i: (r.rounds_t, r.trimmed_t) for r in adapters.trimmed(table, adapter, ("t",), 0.25, 4, 3).collect()}
    assert got.pop(999) == (0, None)
    for i, t in enumerate(texts):
        n = 0
        while n < 3 and (end := plain_end(t, adapter, 0.25, 4)) >= 0:
            t, n = t[end:], n + 1
        assert got[i] == (n, t)
    kept = {r.i for r in adapters.without_adapter(table, adapter, ("t",), 0.25, 4).collect()}
    assert kept == {i for i, (n, _) in got.items() if not n} | {999}


def test_long_text_is_aligned_whole():
    text = "ab" * 40_000 + "GATTXACAGC" + "ab" * 20_000
    assert adapters.match_ends([text, "ab"], "GATTACAGC", 0.12, 9) == [80_010, -1]


def test_suffixes_of_a_batch_are_aligned_together(monkeypatch):
    """A text that many rows have, and that a suffix matches, is not aligned row by row."""
    calls, real = [], adapters._first_end
    monkeypatch.setattr(adapters, "_first_end", lambda *a: calls.append(a) or real(*a))
    adapter, rng = "GATTACAGC", random.Random(3)
    texts = ["ACAGC" + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["TACAXGCTTT"] * 400
    rng.shuffle(texts)
    want = {t: plain_end(t, adapter, 0.2, 4) for t in set(texts)}
    assert adapters.match_ends(texts, adapter, 0.2, 4) == [want[t] for t in texts]
    assert want["TACAXGCTTT"] == 7 and 0 < len(calls) <= len(adapter)


@pytest.mark.parametrize("rows", [2, 2048])
def test_adapters_of_odd_rows(spark, monkeypatch, rows):
    """Nulls, empty, equal and long texts, letters beyond the first plane, ids that come twice or are null, an adapter as long as least."""
    monkeypatch.setattr(adapters, "WINDOW", 64)
    monkeypatch.setattr(adapters, "ROWS", rows, raising=False)
    adapter, rate, least = "GATTACAGC", 0.25, 4
    texts = ["", None, "", "G", "GATT", "AGC", "CAGC", adapter, adapter, "\0GATTACAGC", "é😀" + adapter + "😀", "A" * 150 + adapter + "T" * 150, None, "CAGCCAGCCAGC"]
    reads = [(i // 2 if i % 5 else None, t) for i, t in enumerate(texts)] * 2
    table = spark.createDataFrame(reads, "id long, t string").coalesce(1)
    match = lambda t, n: t is not None and plain_end(t, adapter, rate, n) >= 0
    for n in (least, len(adapter)):
        kept = [tuple(r) for r in adapters.without_adapter(table, adapter, ("t",), rate, n).collect()]
        assert sorted(kept, key=repr) == sorted((r for r in reads if not match(r[1], n)), key=repr)
    assert adapters.without_adapter(table.limit(0), adapter, ("t",)).collect() == []
    assert adapters.match_ends([], adapter) == [] and adapters.match_ends([""], adapter) == [-1]


def test_reads_of_one_split_are_aligned_in_many_tasks(spark, tmp_path):
    """One row group with a key and a text that a fifth of the rows have, columns of any name and kind: no task gets most of the rows, none is lost."""
    hot = F.col("id") % 5 == 0
    rows = spark.range(0, 8000, 1, 1).select(
        F.when(~hot, F.col("id")).alias("the id"), F.when(hot, "TTTTT").otherwise(F.concat(F.lit("CCC"), F.col("id"))).alias("t"), F.create_map(F.lit("a"), "id").alias("m"), F.array("id").alias("l")
    )
    rows.write.parquet(f"{tmp_path}/reads.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = adapters.without_adapter(spark.read.parquet(f"{tmp_path}/reads.parquet"), "GATTACAGC", ("t",), 0.12, 5)
        sizes = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
        assert sorted(tuple(r) for r in kept.select(F.element_at("m", "a"), "t", F.col("l")[0], F.col("the id").isNull()).collect()) == [
            (i, "CCC" + str(i) if i % 5 else "TTTTT", i, i % 5 == 0) for i in range(8000)
        ]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == spark.sparkContext.defaultParallelism and sum(sizes) == 8000 and max(sizes) < 1.3 * min(sizes)


def test_equal_reads_are_all_kept(spark):
    reads = [(1, "TTTTT")] * 50 + [(None, None)] * 3 + [(2, "")] * 2 + [(3, "GATTACAGC")]
    table = spark.createDataFrame(reads, "id long, t string")
    kept = [tuple(r) for r in adapters.without_adapter(table, "GATTACAGC", ("t",)).collect()]
    assert sorted(kept, key=repr) == sorted(reads[:-1], key=repr)


@pytest.mark.parametrize("penalty", [None, 3.0])
def test_spline_against_dense_solve(spark, penalty):
    rng = np.random.default_rng(4)
    x = np.sort(rng.choice(np.arange(200), 60, replace=False)).astype(float)
    signals = {"wave": np.sin(x / 15) + rng.normal(0, 0.2, 60), "noise": rng.normal(0, 1, 60), "line": 2 * x - 5}
    rows = [(k, int(i), float(v)) for k, s in signals.items() for i, v in zip(x, s, strict=True)] + [("short", 1, 5.0), ("short", 2, 7.0), ("wave", 7, None)]
    got = {}
    for r in smoothing.spline(spark.createDataFrame(rows, "k string, i long, x double").repartition(3), ["k"], penalty).orderBy("i").collect():
        got.setdefault(r.k, []).append((r.x, r.penalty))
    assert [v for v, _ in got["short"]] == [5.0, 7.0]
    h, n = np.diff(x), len(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < n - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    k = q @ np.linalg.solve(r, q.T)
    for name, y in signals.items():
        values, used = np.array([v for v, _ in got[name]]), got[name][0][1]
        assert np.allclose(values, np.linalg.solve(np.eye(n) + used * k, y), atol=1e-6)
        if penalty is None and name != "line":
            def score(lam, y=y):
                hat = np.linalg.inv(np.eye(n) + lam * k)
                return ((y - hat @ y) ** 2).sum() / np.trace(np.eye(n) - hat) ** 2

            scale = np.trace(r) / np.trace(q.T @ q)
            assert score(used) <= min(score(scale * 10.0**d) for d in np.arange(-8, 8, 0.5)) * (1 + 1e-9)
    if penalty is None:
        assert np.abs(np.array([v for v, _ in got["wave"]]) - np.sin(x / 15)).mean() < 0.15


def test_density_against_direct_sum(spark):
    rng = np.random.default_rng(5)
    values = {"a": np.round(rng.normal(3, 2, 700), 1), "b": rng.exponential(1, 50), "one": np.array([4.0]), "same": np.array([2.0, 2.0])}
    rows = [(k, float(v)) for k, s in values.items() for v in s] + [("a", None), ("a", float("nan"))]
    table = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {}
    for r in smoothing.density(table, "v", ["k"]).orderBy("j").collect():
        got.setdefault(r.k, []).append((r.at, r.density))
    assert set(got) == {"a", "b"}
    for k, points in got.items():
        v = values[k]
        h = v.std(ddof=1) * len(v) ** -0.2
        at = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 200)
        want = np.exp(-(((at[:, None] - v) / h) ** 2) / 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))
        assert np.allclose([p[0] for p in points], at) and np.allclose([p[1] for p in points], want, atol=2e-6 / h)
    whole = smoothing.density(table.where("k = 'a'"), "v").orderBy("j").collect()
    assert [r.density for r in whole] == pytest.approx([p[1] for p in got["a"]])


def test_spectra_are_spectrum_by_a_product(spark):
    rng = np.random.default_rng(6)
    rows = [(k, i, float(np.sin(i * 2 * np.pi / 10) + rng.normal() + (80 * i if k == 2 else 0))) for k in range(4) for i in range(147)]
    rows += [(9, i, 1.0 * (i % 3)) for i in range(60) if i != 7]
    table = spark.createDataFrame(rows, "k long, i long, x double").repartition(3)
    got = {(r.k, r.j): (r.period, r.power) for r in spectral.spectra(table, 0, 145, 5, 50, ["k"]).collect()}
    want = {(r.k, r.j): (r.period, r.power) for r in spectral.spectrum(table, 0, 145, 5, 50, ["k"]).collect()}
    assert set(got) == set(want) and len(got) == 500
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-6, abs=1e-6), key


def test_flags_of_strands(spark):
    """Minus-strand sites mirrored in a profile, complemented backgrounds of transcripts, positions counted from the right."""
    genome = spark.createDataFrame([("c", "GGGGGACGTT" * 40)], "chrom string, seq string")
    sites = spark.createDataFrame([("c", 160, "+"), ("c", 160, "-"), ("c", 175, "-")], "chrom string, pos long, strand string")
    regions = spark.createDataFrame([(1, "c", 150, "x")], "id long, chrom string, center long, class string")
    contexts_ = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"]
    sig = spark.createDataFrame([(c, 1.0, 1 / 64) for c in contexts_], "context string, ref_norm double, total_norm double")
    seen = {}
    for mirror in (False, True):
        rows = pipelines.nucleosome_profile(sites, regions, genome, sig, mirror_minus=mirror).collect()
        seen[mirror] = {r.position: r.observed for r in rows}
    assert seen[False] == {83: 2, 98: 1} and seen[True] == {83: 1, 148 - 83: 1, 148 - 98: 1}
    transcripts = spark.createDataFrame([(1, "c", 150, 150, 190, 1), (2, "c", 250, 210, 250, -1)], "id long, chrom string, tss long, start long, end long, strand int")
    counts = {}
    for stranded in (False, True):
        rows = pipelines.transcript_profile(sites, transcripts, genome, "G", 20, stranded=stranded).collect()
        counts[stranded] = {r.rel_pos: r.norm_count for r in rows}
    seq = "GGGGGACGTT" * 40
    for rel, n in counts[False].items():
        assert n == sum(seq[c + rel - 2] == "G" for c in (150, 250))  # windows are read one base before, as the analyses have it
    for rel, n in counts[True].items():
        assert n == (seq[148 + rel] == "G") + (seq[248 + rel] == "C")
    obs = spark.createDataFrame([(p, 10) for p in range(4)], "position long, observed long")
    comp = spark.createDataFrame([(o, "G", o + 1) for o in range(4)], "offset long, kmer string, n long")
    plain = {r.position: r.norm for r in profiles.per_base_enrichment(obs, comp, "G").collect()}
    right = {r.position: r.norm for r in profiles.per_base_enrichment(obs, comp, "G", width=4).collect()}
    assert plain == {p: 10 / (p + 1) for p in range(4)} and right == {p: 10 / (4 - p) for p in range(4)}


def test_selected_filters_in_order(spark):
    """The top comes first, then chromosomes and bases, then the threshold, and the correction sees what is left."""
    genome = spark.createDataFrame([("a", "GATC" * 20), ("b", "GATC" * 20)], "chrom string, seq string")
    sites = [("a" if i % 3 else "b", i + 1, "+", 1e-5 * (i + 1) ** 2) for i in range(40)]
    got = pipelines.selected(spark.createDataFrame(sites, "chrom string, pos long, strand string, pvalue double"), genome, 0.006, ["G", "C"], 30, 0.004, ("b",))
    left = [s for s in sorted(sites, key=lambda s: s[3])[:30] if s[0] == "a" and "GATC"[(s[1] - 1) % 4] in "GC" and s[3] < 0.006]
    q, least = {}, 1.0
    for rank in range(len(left), 0, -1):
        least = min(least, left[rank - 1][3] * len(left) / rank)
        q[left[rank - 1][1]] = least
    want = sorted(s[1] for s in left if q[s[1]] <= 0.004)
    assert sorted(r.pos for r in got.collect()) == want and 0 < len(want) < len(left)
