"""Curves through profiles and samples: a penalised cubic spline and a kernel density."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Decades of the penalty, about that which weighs roughness and distance alike, and steps of a decade, that cross-validation looks at.
DECADES, STEPS = 9, 8


def _bands(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q (rows of the second differences), and the bands (main and above) of R and of Q'Q, of a natural cubic spline at the places x."""
    h = np.diff(x)
    q = np.column_stack([1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]])
    n = len(q)
    r = np.zeros((3, n))
    r[0], r[1, :-1] = (h[:-1] + h[1:]) / 3, h[1:-1] / 6
    s = np.zeros((3, n))
    s[0] = (q * q).sum(1)
    s[1, :-1] = q[:-1, 1] * q[1:, 0] + q[:-1, 2] * q[1:, 1]
    s[2, :-2] = q[:-2, 2] * q[2:, 0]
    return q, r, s


def spline_values(x: np.ndarray, y: np.ndarray, penalty: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values and penalties of the smoothing splines of signals (the rows of y) at the places x, ascending.

    The spline f makes sum (y - f)^2 + penalty * integral f''^2 least. With the second derivatives c it is y - penalty Q c, where
    (R + penalty Q'Q) c = Q'y has five bands; one elimination for all penalties and signals, a step a place, solves it. Without a
    penalty, that with the least generalised cross-validation score is taken; the trace that it needs comes from the
    bands of the inverse, in the same steps backwards. Signals of fewer than 4 places stay.
    """
    if len(x) < 4:
        return y.copy(), np.zeros(len(y))
    q, r, s = _bands(x)
    n = len(q)
    scale = r[0].sum() / s[0].sum()
    lam = np.array([penalty]) if penalty is not None else scale * 10.0 ** (np.arange(-DECADES * STEPS, DECADES * STEPS + 1) / STEPS)
    a = r[:, :, None] + lam * s[:, :, None]  # bands, places, penalties
    d, l1, l2 = np.zeros((n, len(lam))), np.zeros((n + 2, len(lam))), np.zeros((n + 2, len(lam)))
    c = np.repeat((q[:, :1] * y.T[:-2] + q[:, 1:2] * y.T[1:-1] + q[:, 2:] * y.T[2:])[:, None, :], len(lam), 1)  # places, penalties, signals
    for i in range(n):
        d[i] = a[0, i] - (l1[i - 1] ** 2 * d[i - 1] if i else 0) - (l2[i - 2] ** 2 * d[i - 2] if i > 1 else 0)
        l1[i] = (a[1, i] - (l1[i - 1] * l2[i - 1] * d[i - 1] if i else 0)) / d[i]
        l2[i] = a[2, i] / d[i]
        if i:
            c[i] -= l1[i - 1, :, None] * c[i - 1]
        if i > 1:
            c[i] -= l2[i - 2, :, None] * c[i - 2]
    c /= d[:, :, None]
    zero = np.zeros(len(lam))
    inverse = [[zero, zero, zero], [zero, zero, zero]]  # of the two places after: main, first, second band
    trace = zero.copy()
    for i in reversed(range(n)):
        if i + 1 < n:
            c[i] -= l1[i, :, None] * c[i + 1]
        if i + 2 < n:
            c[i] -= l2[i, :, None] * c[i + 2]
        (m1, f1, _), (m2, _, _) = inverse
        first = -l1[i] * m1 - l2[i] * f1
        second = -l1[i] * f1 - l2[i] * m2
        main = 1 / d[i] - l1[i] * first - l2[i] * second
        trace += s[0, i] * main + 2 * s[1, i] * first + 2 * s[2, i] * second
        inverse = [[main, first, second], inverse[0]]
    rough = np.zeros((len(x), *c.shape[1:]))
    for j in range(3):
        rough[j : j + n] += q[:, j, None, None] * c
    rough *= lam[None, :, None]
    if penalty is not None:
        return y - rough[:, 0].T, np.full(len(y), penalty)
    score = np.log((rough**2).sum(0) + 1e-300) - 2 * np.log(np.maximum(lam * trace, 1e-300))[:, None]
    best = score.argmin(0)
    return y - rough[:, best, np.arange(len(y))].T, lam[best]


def spline(signals: DataFrame, by: list[str] | None = None, penalty: float | None = None) -> DataFrame:
    """(by..., i, x, penalty): a smoothing cubic spline through each signal (i, x), the penalty given or by generalised cross-validation.

    A signal is a profile, gathered to an array; many go in batches, those of the same places together. Nulls are left out;
    a place that occurs twice in a signal counts by its mean.
    """
    keys = by or []
    means = signals.where("x IS NOT NULL").groupBy(*keys, F.col("i").cast("double").alias("i")).agg(F.avg("x").alias("x"))
    rows = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    rows = rows.select(*keys, F.col("s.i").alias("_i"), F.col("s.x").alias("_x"))
    kinds = StructType([*rows.select(*keys).schema, *StructType.fromDDL("s array<struct<i:double,x:double>>, penalty double")])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [tuple(v) for v in batch.column(n).to_pylist()]
            out, used = [None] * len(places), [0.0] * len(places)
            for own in dict.fromkeys(places):
                at = [r for r, p in enumerate(places) if p == own]
                for low in range(0, len(at), 64):
                    some = at[low : low + 64]
                    values, chosen = spline_values(np.array(own), np.array([batch.column(n + 1)[r].as_py() for r in some], float), penalty)
                    for r, v, p in zip(some, values, chosen, strict=True):
                        out[r], used[r] = [{"i": a, "x": b} for a, b in zip(own, v.tolist(), strict=True)], float(p)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.list_(pa.struct([("i", pa.float64()), ("x", pa.float64())]))), pa.array(used)], kinds.names)

    return rows.mapInArrow(run, kinds).select(*keys, F.explode("s").alias("s"), "penalty").select(*keys, "s.i", "s.x", "penalty")


def density(values: DataFrame, value: str, by: list[str] | None = None, points: int = 200, cut: float = 3.0, reach: float = 5.0, adjust: float = 1.0) -> DataFrame:
    """(by..., j, at, density): the Gaussian kernel density of the values at points evenly spaced places, cut bandwidths beyond both ends.

    The bandwidth is the sample's standard deviation times n^(-1/5), times adjust, from one aggregation. Equal values are
    counted first; each is then added at the places at most reach bandwidths away, and sums are made before anything is
    shuffled. Nulls and NaN take no part; fewer than two different values give no rows.
    """
    keys = by or []
    held = values.select(*keys, F.col(value).cast("double").alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)")
    stats = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_s"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).where("_s > 0")
    h = F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * adjust
    grid = stats.withColumn("_h", h).withColumn("_from", F.col("_lo") - cut * F.col("_h"))
    grid = grid.withColumn("_step", (F.col("_hi") + cut * F.col("_h") - F.col("_from")) / (points - 1)).select(*keys, "_n", "_h", "_from", "_step")
    join = lambda a: a.join(grid, keys) if keys else a.crossJoin(F.broadcast(grid))  # noqa: E731  one row without keys
    counted = join(held.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c")))
    first = F.greatest(F.ceil((F.col("_x") - reach * F.col("_h") - F.col("_from")) / F.col("_step")), F.lit(0))
    last = F.least(F.floor((F.col("_x") + reach * F.col("_h") - F.col("_from")) / F.col("_step")), F.lit(points - 1))
    near = counted.withColumn("j", F.explode(F.when(first <= last, F.sequence(first, last))))
    z = (F.col("_from") + F.col("j") * F.col("_step") - F.col("_x")) / F.col("_h")
    sums = near.groupBy(*keys, "j").agg(F.sum(F.col("_c") * F.exp(-z * z / 2)).alias("_v"))
    all_ = join(values.sparkSession.range(points).select(F.col("id").alias("j"))) if not keys else grid.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    full = all_.join(sums, [*keys, "j"], "left")
    weight = F.coalesce("_v", F.lit(0.0)) / (F.col("_n") * F.col("_h") * F.sqrt(2 * F.pi()))
    return full.select(*keys, "j", (F.col("_from") + F.col("j") * F.col("_step")).alias("at"), weight.alias("density"))
