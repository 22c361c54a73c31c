"""Exact quantiles, scans, bounded fits and sweeps against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteprofile.operators import spectral, statistics


@pytest.mark.parametrize("q", [0.0, 0.37, 0.9, 1.0])
def test_exact_quantile_by_refinement(spark, q):
    rng = random.Random(7)
    different = [rng.gauss(0, 1) * 10 ** rng.randint(-9, 9) for _ in range(2000)]
    cases = [different, [3.0] * 500 + [4.0] * 500, [rng.choice([1.0, 2.0, 2.5]) for _ in range(999)] + [1e308, -1e308], [5.0], [1.0, float("inf"), -float("inf"), 2.0, 3.0]]
    for values in cases:
        table = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double").repartition(6)
        place = q * (len(values) - 1)
        ordered_, k = sorted(values), int(place)
        low, high = ordered_[k], ordered_[min(k + 1, len(values) - 1)]
        want = low if place == k or low == high else low + (high - low) * (place - k)
        assert statistics.exact_quantile(table, "x", q, cells=256, single=20) == pytest.approx(want, rel=1e-12, nan_ok=True)
    assert statistics.exact_quantile(spark.createDataFrame([], "x double"), "x", q) is None


def test_above_quantile(spark):
    rows = spark.createDataFrame([(i, float(i % 100)) for i in range(1000)], "i long, x double")
    some = sorted(i % 100 for i in range(1000) if i % 100)
    cut = some[890] + 0.1 * 0
    got = statistics.above_quantile(rows, "x")
    assert got.count() == sum(v > np.quantile(some, 0.9) for v in some) and cut <= np.quantile(some, 0.9)
    assert statistics.above_quantile(rows.where("x = 0"), "x").count() == 0


def plain_ewma(xs, beta):
    v, out = xs[0] * beta, []
    for x in xs:
        v = beta * v + (1 - beta) * x
        out.append(v)
    return out


@pytest.mark.parametrize("block", [5, 256])
def test_ewma_by_blocks(spark, block):
    rng = random.Random(block)
    signals = {k: sorted(rng.sample(range(-50, 400), n)) for k, n in (("a", 300), ("b", 1), ("c", 40))}
    values = {k: [rng.gauss(0, 5) for _ in at] for k, at in signals.items()}
    table = spark.createDataFrame([(k, i, x) for k, at in signals.items() for i, x in zip(at, values[k], strict=True)], "k string, i long, x double").repartition(4)
    for beta in (0.8, 0.0):
        got = {(r.k, r.i): r.x for r in spectral.ewma(table, beta, ["k"], block).collect()}
        assert len(got) == 341
        for k, at in signals.items():
            for i, v in zip(at, plain_ewma(values[k], beta), strict=True):
                assert got[k, i] == pytest.approx(v, abs=1e-9)
    assert spectral.ewma(table.limit(0)).collect() == []


def test_ewma_of_a_long_signal(spark):
    n = 1_000_000
    signal = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("x"))
    got = {r.i: r.x for r in spectral.ewma(signal).where("i % 99999 = 0").collect()}
    want = plain_ewma([float(i % 7) for i in range(n)], 0.8)
    assert all(v == pytest.approx(want[i], abs=1e-9) for i, v in got.items()) and len(got) == 11


def test_bounded_detrend(spark):
    """Steep signals: the least squares over slopes and curvatures between the bounds, by coordinate descent."""
    rng = np.random.default_rng(8)
    i = np.arange(60.0)
    signals = {"flat": rng.normal(0, 1, 60), "slope": 25 * i + rng.normal(0, 1, 60), "curve": 14 * i * i, "both": -12 * i * i + 300 * i, "down": -30 * i + 0.5 * i * i}
    table = spark.createDataFrame([(k, int(a), float(b)) for k, x in signals.items() for a, b in zip(i, x, strict=True)], "k string, i long, x double")
    got = {}
    for r in spectral.detrend(table, ["k"]).orderBy("i").collect():
        got.setdefault(r.k, []).append(r.x)
    basis = np.column_stack([i - i.mean(), i * i - (i * i).mean()])
    for k, x in signals.items():
        y, a = x - x.mean(), np.zeros(2)
        for _ in range(200_000):
            before = a.copy()
            for j in (0, 1):
                rest = y - basis[:, 1 - j] * a[1 - j]
                a[j] = np.clip(basis[:, j] @ rest / (basis[:, j] @ basis[:, j]), -10, 10)
            if np.abs(a - before).max() < 1e-13:
                break
        assert np.allclose(got[k], y - basis @ a, atol=1e-4 * max(1, np.abs(x).max() / 100)), k
    free = np.polynomial.polynomial.polyfit(i, signals["flat"], 2)
    assert np.allclose(got["flat"], signals["flat"] - np.polynomial.polynomial.polyval(i, free), atol=1e-9)


def test_alpha_sweep_is_one_plan(spark):
    signature = [1.0, 2.0, 3.0, 4.0]
    swept = statistics.alpha_sweep(spark, signature, [0.5, 2.0, 50.0], 3000)
    got = {r.alpha: r for r in swept.collect()}
    assert swept._jdf.queryExecution().toString().count("Union") == 0
    for i, a in enumerate((0.5, 2.0, 50.0)):
        own = [r.cosine for r in statistics.dirichlet_null(spark, signature, 3000, a, 42 + i, 4).collect()]
        assert got[a].share == pytest.approx(sum(c >= 0.85 for c in own) / 3000) and got[a].mean_cosine == pytest.approx(sum(own) / 3000)
