import math
import random

import numpy as np
import pytest

from siteprofile.operators import profiles, spectral, statistics


def test_benjamini_hochberg(spark):
    rng = random.Random(3)
    p = [round(rng.random() ** 3, 3) for _ in range(300)] + [0.0, 1.0, 0.5, 0.5]
    got = statistics.benjamini_hochberg(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i long, pvalue double")).orderBy("i").collect()
    n = len(p)
    rank = {x: sum(y <= x for y in p) for x in p}
    want = [min(1.0, min(y * n / rank[y] for y in p if y >= x)) for x in p]
    assert [r.q for r in got] == pytest.approx(want)


def test_g_test(spark):
    r = statistics.g_test(spark.createDataFrame([(30, 10.0), (5, 5.0), (4, 0.0)], "observed long, expected double")).collect()
    assert r[0].g == pytest.approx(2 * (30 * math.log(1.5) + 10 * math.log(0.5))) and r[0].p_value == pytest.approx(math.erfc(math.sqrt(r[0].g / 2)))
    assert r[1].g == pytest.approx(0) and r[1].p_value == pytest.approx(1) and r[2].g == pytest.approx(8 * math.log(2))


def test_multinomial_null_keeps_the_sites(spark):
    rows = [(i, "+", 10 + i, j, (j + 1) / 15) for i in range(4) for j in range(5)]
    p = spark.createDataFrame(rows, "id long, strand string, n long, position long, p double")
    a = statistics.multinomial_null(p, 20).collect()
    assert {sum(r.n for r in a if r.replicate == k) for k in range(20)} == {10 + 11 + 12 + 13}
    assert sorted(map(tuple, a)) == sorted(map(tuple, statistics.multinomial_null(p.repartition(3), 20).collect()))
    assert {r.position: r.expected for r in profiles.expected(p).collect()}[4] == pytest.approx(46 / 3)


def test_dirichlet_and_empirical(spark):
    draws = statistics.dirichlet_null(spark, [1.0] * 16, 500, 2.0)
    assert draws.count() == 500 and draws.select("draw").distinct().count() == 500
    assert statistics.null_score(draws, 2.0).first().share == 0
    null = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0)], "snr double")
    assert statistics.empirical_p(null, spark.createDataFrame([(2.0,)], "snr double")).first()[0] == pytest.approx(0.5)


def test_cosine(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "context string, total_norm double")
    b = spark.createDataFrame([("y", 2.0), ("z", 1.0)], "context string, total_norm double")
    assert statistics.cosine(a, a).first()[0] == pytest.approx(1) and statistics.cosine(a, b).first()[0] == pytest.approx(4 / 5)
    assert sorted(tuple(r) for r in statistics.difference(a, b).collect()) == [("x", 1.0, 0.0, 1.0), ("y", 2.0, 2.0, 0.0), ("z", 0.0, 1.0, -1.0)]


def test_spectrum_of_a_cosine(spark):
    signal = spark.createDataFrame([(i, math.cos(2 * math.pi * i / 10) + 0.001 * i * i) for i in range(150)], "i long, x double")
    peak = spectral.signal_to_noise(spectral.spectrum(signal, 0, 145, 5, 50)).first()
    assert abs(peak.peak - 10) < 0.5 and peak.snr > 5


def test_smoothers(spark):
    rng = random.Random(2)
    x = [rng.random() for _ in range(40)]
    signal = spark.createDataFrame(list(enumerate(x)), "i long, x double")
    z = np.arange(38.0)
    smooth = np.convolve(x, np.ones(3) / 3, "valid")
    assert [r.x for r in spectral.smooth3(signal).orderBy("i").collect()] == pytest.approx(smooth.tolist())
    flat = smooth - np.polyval(np.polyfit(z, smooth, 2), z)
    assert [r.x for r in spectral.detrend(spectral.smooth3(signal)).orderBy("i").collect()] == pytest.approx(flat.tolist(), abs=1e-9)
    v, want = x[0] * 0.8, []
    for y in x:
        v = 0.8 * v + 0.2 * y
        want.append(v)
    assert [r.x for r in spectral.ewma(signal).orderBy("i").collect()] == pytest.approx(want)
    fit = []
    for i in range(40):
        low = min(max(i - 4, 0), 31)
        fit.append(float(np.polyval(np.polyfit(np.arange(9.0), x[low : low + 9], 3), i - low)))
    assert [r.x for r in spectral.savgol(signal, 9).orderBy("i").collect()] == pytest.approx(fit)


def test_subset_quantile_replicates(spark):
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(100)], "i long, v double")
    a = [r.i for r in statistics.random_subset(rows, 10, ["i"]).collect()]
    assert len(a) == 10 and a == [r.i for r in statistics.random_subset(rows.repartition(5), 10, ["i"]).collect()]
    some = [i % 7 for i in range(100) if i % 7]
    assert {r.v for r in statistics.above_quantile(rows, "v", 0.5).collect()} == {float(x) for x in some if x > np.quantile(some, 0.5)}
    x, y = spark.createDataFrame([("k", 1.0, "a"), ("l", 5.0, "b")], "id string, p double, g string"), spark.createDataFrame([("k", 2.0, "c"), ("m", 1.0, "d")], "id string, p double, g string")
    assert [tuple(r) for r in statistics.replicate_mean(x, y, "id", ["p"], ["g"]).collect()] == [("k", 1.5, "a/c")]
    assert {r.id for r in statistics.symmetric_difference(x, y, "id").collect()} == {"l", "m"}
