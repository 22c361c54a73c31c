"""Periodicity and smoothing of positional profiles. A signal has a whole-number column i (0, 1, ...) and a value x; keys (such as a replicate) make many signals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def _over(by: list[str]):
    return Window.partitionBy(*by)


def smooth3(signal: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of three neighbours; the signal becomes two shorter."""
    keys = by or []
    w = _over(keys).orderBy("i")
    return signal.select(*keys, "i", F.avg("x").over(w.rowsBetween(0, 2)).alias("x"), F.count(F.lit(1)).over(w.rowsBetween(0, 2)).alias("_c")).where("_c = 3").drop("_c")


#: The fit's bounds on the slope and the curvature, in the abscissa as it is.
STEEPEST = 10.0


def bounded(m: Column, n: Column, s2: Column, s3: Column, s4: Column, t0: Column, t1: Column, t2: Column, most: float = STEEPEST) -> Column:
    """Struct a1, a2: slope and curvature, both between -most and most, of the least-squares parabola, from sums about the mean abscissa m.

    The constant is free, so this is a quadratic form in two unknowns over a square. Its least value is that of the whole
    plane, of one of the four sides or of a corner; of those inside the square the best is taken.
    """
    mean = s2 / n
    s11, s12, s22 = s2, s3 + 2 * m * s2, s4 + 4 * m * s3 + 4 * m * m * s2 - s2 * mean
    r1, r2 = t1, t2 + 2 * m * t1 - t0 * mean
    cost = lambda a, b: s11 * a * a + 2 * s12 * a * b + s22 * b * b - 2 * r1 * a - 2 * r2 * b
    ends = [F.lit(-most), F.lit(most)]
    found = [(a, F.try_divide(r2 - s12 * a, s22)) for a in ends] + [(F.try_divide(r1 - s12 * b, s11), b) for b in ends] + [(a, b) for a in ends for b in ends]
    each = [F.when((F.abs(a) <= most) & (F.abs(b) <= most), F.struct(cost(a, b).alias("cost"), a.alias("a1"), b.alias("a2"))) for a, b in found]
    return F.array_min(F.array_compact(F.array(*each)))


def detrend(signal: DataFrame, by: list[str] | None = None, most: float = STEEPEST) -> DataFrame:
    """The signal less its least-squares parabola a0 + a1 i + a2 i^2 with a1 and a2 between -most and most, from the sums of one aggregation.

    The abscissa is centred first, which makes the normal equations of a regular grid well conditioned. Where the free
    parabola is outside the bounds, the best one inside is taken.
    """
    keys = by or []
    mid = signal.groupBy(*keys).agg(F.avg("i").alias("_m"))
    join = lambda a, b: a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))  # noqa: E731  one row, or one per signal of any number
    z = join(signal, mid).withColumn("_z", F.col("i") - F.col("_m"))
    powers = [F.sum(F.col("_z") ** k).alias(f"_s{k}") for k in range(5)] + [F.sum(F.col("x") * F.col("_z") ** k).alias(f"_t{k}") for k in range(3)]
    m = z.groupBy(*keys).agg(F.first("_m").alias("_m"), *powers)
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("_s0", "_s1", "_s2", "_s3", "_s4", "_t0", "_t1", "_t2"))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    a0 = (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det
    a1 = (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - t1 * s2)) / det
    a2 = (s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det
    free = m.where(F.abs(det) > 0).select("*", a0.alias("_a0"), a1.alias("_a1"), a2.alias("_a2"))
    steep = (F.abs(F.col("_a1") - 2 * F.col("_a2") * F.col("_m")) > most) | (F.abs("_a2") > most)
    edge = free.withColumn("_e", F.when(steep, bounded(F.col("_m"), s0, s2, s3, s4, t0, t1, t2, most)))
    fit = edge.select(
        *keys,
        F.when(steep, t0 / s0 - F.col("_e.a2") * s2 / s0).otherwise(F.col("_a0")).alias("_a0"),
        F.when(steep, F.col("_e.a1") + 2 * F.col("_e.a2") * F.col("_m")).otherwise(F.col("_a1")).alias("_a1"),
        F.when(steep, F.col("_e.a2")).otherwise(F.col("_a2")).alias("_a2"),
    )
    return join(z, fit).select(*keys, "i", (F.col("x") - F.col("_a0") - F.col("_a1") * F.col("_z") - F.col("_a2") * F.col("_z") ** 2).alias("x"))


def periods(spark, low: float, high: float, n: int = 100) -> DataFrame:
    """(j, period): n periods, evenly spaced from low to high."""
    return spark.range(n).select(F.col("id").alias("j"), (F.lit(float(low)) + F.col("id") * F.lit((high - low) / (n - 1))).alias("period"))


def power(signal: DataFrame, grid: DataFrame, first: int, last: int, by: list[str] | None = None) -> DataFrame:
    """(by..., j, period, power) of the discrete-time Fourier transform over i from first to last - 1, the mean of the whole signal removed."""
    keys = by or []
    centred = signal.select(*keys, "i", (F.col("x") - F.avg("x").over(_over(keys))).alias("x")).where(F.col("i").between(first, last - 1))
    angle = F.col("i") * F.lit(2.0) * F.pi() / F.col("period")
    long = centred.crossJoin(F.broadcast(grid))  # a grid of some hundred periods
    sums = long.groupBy(*keys, "j", "period").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    return sums.select(*keys, "j", "period", ((F.col("re") ** 2 + F.col("im") ** 2) / (last - first)).alias("power"))


def spectrum(signal: DataFrame, low_t: int, high_t: int, low_p: int, high_p: int, by: list[str] | None = None, n: int = 100) -> DataFrame:
    """(by..., j, period, power): smoothed, detrended, transformed, and normalised by the sum over the whole periods from low_p to high_p - 1."""
    keys, spark = by or [], signal.sparkSession
    flat = detrend(smooth3(signal, keys), keys)
    whole = spark.range(low_p, high_p).select((-F.col("id")).alias("j"), F.col("id").cast("double").alias("period"))
    both = power(flat, periods(spark, low_p, high_p, n).unionByName(whole), low_t, high_t, keys)
    total = F.sum(F.when(F.col("j") < 0, F.col("power"))).over(_over(keys))
    return both.withColumn("_t", total).where("j >= 0").select(*keys, "j", "period", (F.lit(float(high_p - low_p)) * F.col("power") / F.col("_t")).alias("power"))


def _smooth_and_detrend(x: np.ndarray, i: np.ndarray, most: float) -> np.ndarray:
    """smooth3() and detrend() of signals as the rows of a matrix."""
    x = (x[:, :-2] + x[:, 1:-1] + x[:, 2:]) / 3
    z = i[:-2].astype(float)
    m = z.mean()
    z = z - m
    basis = np.column_stack([np.ones_like(z), z, z * z])
    fit = np.linalg.lstsq(basis, x.T, rcond=None)[0]
    for r in np.flatnonzero((np.abs(fit[1] - 2 * fit[2] * m) > most) | (np.abs(fit[2]) > most)):
        p = np.column_stack([z, z * z + 2 * m * z])
        p -= p.mean(0)
        y = x[r] - x[r].mean()
        s, t = p.T @ p, p.T @ y
        sides = [(e, (t[1] - s[0, 1] * e) / s[1, 1]) for e in (-most, most)] + [((t[0] - s[0, 1] * e) / s[0, 0], e) for e in (-most, most)]
        inside = [a for a in sides if max(map(abs, a)) <= most] + [(e, f) for e in (-most, most) for f in (-most, most)]
        a1, a2 = min(inside, key=lambda a: s[0, 0] * a[0] ** 2 + 2 * s[0, 1] * a[0] * a[1] + s[1, 1] * a[1] ** 2 - 2 * t[0] * a[0] - 2 * t[1] * a[1])
        fit[:, r] = x[r].mean() - a2 * (z * z).mean(), a1 + 2 * a2 * m, a2
    return x - (basis @ fit).T


def spectra(signals: DataFrame, low_t: int, high_t: int, low_p: int, high_p: int, by: list[str], n: int = 100) -> DataFrame:
    """spectrum() of many signals of the same places: (by..., j, period, power).

    A signal's values are gathered to an array, as long as a profile; arrays go in batches through smoothing and detrending
    and are multiplied with one matrix of cosines and sines. Signals that lack a value, or have other places than most
    of their batch, go one by one with the places that they have.
    """
    grid = np.concatenate([low_p + np.arange(n) * ((high_p - low_p) / (n - 1)), np.arange(low_p, high_p, dtype=float)])
    rows = signals.where("x IS NOT NULL").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")))).alias("s"))
    rows = rows.select(*by, F.col("s.i").alias("_i"), F.col("s.x").alias("_x"))
    kinds = StructType([*rows.select(*by).schema, *StructType.fromDDL("power array<double>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [tuple(v) for v in batch.column(len(by)).to_pylist()]
            out: list = [None] * len(places)
            for own in dict.fromkeys(places):
                at = [r for r, p in enumerate(places) if p == own]
                i = np.array(own)
                if len(i) < 5:
                    continue
                flat = _smooth_and_detrend(np.array([batch.column(len(by) + 1)[r].as_py() for r in at], float), i, STEEPEST)
                i = i[:-2]
                flat = (flat - flat.mean(1, keepdims=True))[:, (i >= low_t) & (i < high_t)]
                angle = 2 * np.pi * i[(i >= low_t) & (i < high_t), None] / grid[None, :]
                power = ((flat @ np.cos(angle)) ** 2 + (flat @ np.sin(angle)) ** 2) / (high_t - low_t)
                for r, p in zip(at, (high_p - low_p) * power[:, :n] / power[:, n:].sum(1, keepdims=True), strict=True):
                    out[r] = p
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(out, pa.list_(pa.float64()))], kinds.names)

    found = rows.mapInArrow(run, kinds).select(*by, F.posexplode("power").alias("j", "power"))
    return found.select(*by, F.col("j").cast("long").alias("j"), (F.lit(float(low_p)) + F.col("j") * F.lit((high_p - low_p) / (n - 1))).alias("period"), "power")


def signal_to_noise(spec: DataFrame, by: list[str] | None = None, centre: float | None = None, half: float = 0.25) -> DataFrame:
    """(by..., snr, peak). The foreground is within half of the peak (the strongest period, or centre), the noise the median of the rest. If the strongest foreground sample is its first or last, the sample closest to the peak is taken."""
    keys = by or []
    w = _over(keys)
    peak = F.lit(float(centre)) if centre is not None else F.max(F.struct("power", (-F.col("j")).alias("k"), "period")).over(w)["period"]
    rows = spec.withColumn("_peak", peak).withColumn("_fore", F.col("period").between(F.col("_peak") - half, F.col("_peak") + half))
    fore = lambda *c: F.when(F.col("_fore"), F.struct(*c))
    nearest = F.min(fore(F.abs(F.col("period") - F.col("_peak")).alias("d"), "j", "power", "period"))
    found = rows.groupBy(*keys).agg(
        F.median(F.when(~F.col("_fore"), F.col("power"))).alias("_noise"),
        F.max(fore("power", (-F.col("j")).alias("k"), "period")).alias("_best"),
        F.min(F.when(F.col("_fore"), F.col("j"))).alias("_first"),
        F.max(F.when(F.col("_fore"), F.col("j"))).alias("_last"),
        nearest.alias("_near"),
    )
    edge = (-F.col("_best.k") == F.col("_first")) | (-F.col("_best.k") == F.col("_last"))
    take = lambda c: F.when(edge, F.col(f"_near.{c}")).otherwise(F.col(f"_best.{c}"))
    return found.select(*keys, F.try_divide(take("power"), F.col("_noise")).alias("snr"), take("period").alias("peak"))


#: Places of a block of a scan.
SCAN = 256


def affine_scan(maps: DataFrame, keys: list[str], levels: int, block: int = SCAN) -> DataFrame:
    """(keys..., i, before, upto): the maps v -> a v + b of a signal, composed in the order of i, before each place and up to it.

    maps has keys, i, a and b. A block of places is folded at a time; the whole maps of the blocks are scanned in the same
    way, levels deep, and what comes before a block is put in front of its own. At the lowest level a key is one block.
    """
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    then = lambda first, a, b: F.struct((first["a"] * a).alias("a"), (first["b"] * a + b).alias("b"))
    blocked = maps.withColumn("_b", F.floor(F.col("i") / block) if levels else F.lit(0))
    rows = blocked.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), "a", "b"))).alias("_s"))
    kind = "struct<a:double,b:double>"
    start = F.struct(one.alias("at"), F.array().cast(f"array<struct<i:bigint,before:{kind},upto:{kind}>>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        upto = then(state["at"], s["a"], s["b"])
        return F.struct(upto.alias("at"), F.concat(state["out"], F.array(F.struct(s["i"].alias("i"), state["at"].alias("before"), upto.alias("upto")))).alias("out"))

    folded = rows.select(*keys, "_b", F.aggregate("_s", start, step, lambda s: s["out"]).alias("out"))
    if not levels:
        return folded.select(*keys, F.explode("out").alias("e")).select(*keys, "e.i", "e.before", "e.upto")
    whole = folded.select(*keys, F.col("_b").alias("i"), F.element_at("out", -1)["upto"].alias("w")).select(*keys, "i", "w.a", "w.b")
    ahead = affine_scan(whole, keys, levels - 1, block).select(*keys, F.col("i").alias("_b"), F.col("before").alias("_f"))
    near = folded.join(ahead, [*keys, "_b"]).select(*keys, "_f", F.explode("out").alias("e"))
    joined = lambda c: then(F.col("_f"), F.col(f"e.{c}.a"), F.col(f"e.{c}.b")).alias(c)
    return near.select(*keys, "e.i", joined("before"), joined("upto"))


def ewma(signal: DataFrame, beta: float = 0.8, by: list[str] | None = None, block: int = SCAN) -> DataFrame:
    """Exponentially weighted mean: v starts at x0 * beta, and each value gives v = beta * v + (1 - beta) * x.

    A step is an affine map of v, and the steps are composed by blocks, so a signal of any length is spread over many tasks
    and each value is handled once a level; the range of i, read first, gives the number of levels.
    """
    keys = by or []
    low, high = signal.agg(F.min("i"), F.max("i")).first()
    levels, reach = 0, block
    while low is not None and high - low >= reach:
        levels, reach = levels + 1, reach * block
    maps = signal.select(*keys, "i", F.lit(float(beta)).alias("a"), (F.col("x") * (1 - beta)).alias("b"))
    first = signal.groupBy(*keys).agg((F.min_by("x", "i") * beta).alias("_v"))
    scanned = affine_scan(maps, keys, levels, block)
    joined = scanned.join(first, keys) if keys else scanned.crossJoin(F.broadcast(first))  # one row without keys
    return joined.select(*keys, "i", (F.col("upto.a") * F.col("_v") + F.col("upto.b")).alias("x"))


def savgol_weights(window: int, order: int = 3, at: int | None = None) -> list[float]:
    """Weights that give the least-squares polynomial of a window at one of its places (the middle by default)."""
    half = window // 2
    z = np.arange(-half, half + 1, dtype=float)
    place = float((half if at is None else at) - half)
    basis = np.vander(z, order + 1, increasing=True)
    return (np.linalg.pinv(basis).T @ np.array([place**k for k in range(order + 1)])).tolist()


def savgol(signal: DataFrame, window: int, order: int = 3, by: list[str] | None = None) -> DataFrame:
    """Savitzky-Golay smoothing. Inside, a weighted sum over the neighbours; the first and last window // 2 values are those of the polynomial of the first and last window."""
    keys = by or []
    half = window // 2
    w = _over(keys).orderBy("i")
    values, last = F.collect_list("x").over(w.rowsBetween(-half, half)), F.count(F.lit(1)).over(_over(keys))
    rows = signal.withColumn("_v", values).withColumn("_n", last).withColumn("_r", F.row_number().over(w) - 1).where(F.col("_n") >= window)
    # The values of the first and the last window of each signal: window of them each, whatever its length.
    end = lambda inside: F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("i", "x")))), lambda s: s["x"])
    edge = (F.col("_r") < window) | (F.col("_r") >= F.col("_n") - window)
    ends = rows.where(edge).groupBy(*keys).agg(end(F.col("_r") < window).alias("_first"), end(F.col("_r") >= F.col("_n") - window).alias("_last"))
    rows = rows.join(ends, keys) if keys else rows.crossJoin(F.broadcast(ends))  # one row without keys
    weights = F.array(*[F.array(*[F.lit(x) for x in savgol_weights(window, order, at)]) for at in range(window)])
    place = F.when(F.col("_r") < half, F.col("_r")).when(F.col("_r") >= F.col("_n") - half, F.col("_r") - F.col("_n") + window).otherwise(half)
    part = F.when(F.col("_r") < half, F.col("_first")).when(F.col("_r") >= F.col("_n") - half, F.col("_last")).otherwise(F.col("_v"))
    dot = F.aggregate(F.zip_with(part, F.element_at(weights, (place + 1).cast("int")), lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
    return rows.select(*keys, "i", dot.alias("x"))


#: Period of the helix, in bases.
TURN = 10.3


def groove(position: Column, turns: int = 7, turn: float = TURN) -> Column:
    """Where a position relative to the dyad faces: out within a quarter turn of a whole turn, in for the rest up to the last, else other."""
    x = F.abs(position.cast("double"))
    label = F.lit("other")
    for i in reversed(range(1, turns + 1)):
        whole = turn * i
        label = F.when((x >= whole - turn / 4) & (x <= whole + turn / 4), "out").when((x > whole + turn / 4) & (x <= whole + turn * 3 / 4), "in").otherwise(label)
    return label


def zone(position: Column, maxima: list[float], half: int = 73) -> Column:
    """nucleosome within half of a maximum, linker between two neighbouring nucleosomes (both ends counted, and first asked), else other."""
    centres = [int(m) for m in sorted(maxima)]
    inside = F.lit(False)
    between = F.lit(False)
    for m in centres:
        inside = inside | position.between(m - half, m + half)
    for a, b in zip(centres, centres[1:]):
        between = between | position.between(a + half, b - half)
    return F.when(between, "linker").when(inside, "nucleosome").otherwise("other")
