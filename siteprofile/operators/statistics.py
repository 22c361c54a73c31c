"""Tests, corrections, null models, comparisons and set operations on keyed tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.special import chi2_sf


def g_statistic(observed: Column, expected: Column) -> Column:
    """G of two cells against their mean: 2 (o ln(2o / (o+e)) + e ln(2e / (o+e))); a cell of 0 adds nothing."""
    total = (observed + expected).cast("double")
    part = lambda x: F.when(x > 0, x * F.ln(2.0 * x / total)).otherwise(F.lit(0.0))
    return 2.0 * (part(observed.cast("double")) + part(expected.cast("double")))


def g_test(rows: DataFrame, observed: str = "observed", expected: str = "expected") -> DataFrame:
    """rows with g and p_value (chi-square, one degree of freedom)."""
    return rows.withColumn("g", g_statistic(F.col(observed), F.col(expected))).withColumn("p_value", chi2_sf("g"))


def benjamini_hochberg(rows: DataFrame, p: str = "pvalue") -> DataFrame:
    """rows with q, the least p * n / rank over this and all larger p-values, at most 1.

    Distinct p-values are counted first, so the windows run over them and not over the rows; the running sums go by blocks
    of p and then within, so that no task sorts all of them. The blocks are even in the logarithm, 32 to a factor of 2, as
    most p-values of interest are tiny; there are 34,401 at most.
    """
    log = F.when(F.col("_p") > 0, F.floor(F.log2("_p") * 32)).otherwise(-40_000).cast("int")
    counts = rows.groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c")).where("_p is not null").withColumn("_b", log)
    block = counts.groupBy("_b").agg(F.sum("_c").alias("_bc"))  # one row a block
    up = Window.orderBy("_b")
    block = block.withColumn("_before", F.coalesce(F.sum("_bc").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_bc").over(Window.partitionBy()))
    inside = F.sum("_c").over(Window.partitionBy("_b").orderBy("_p"))
    ranked = counts.withColumn("_in", inside).join(F.broadcast(block), "_b").withColumn("_raw", F.col("_p") * F.col("_n") / (F.col("_before") + F.col("_in")))
    later = ranked.groupBy("_b").agg(F.min("_raw").alias("_m")).withColumn("_later", F.min("_m").over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)))
    best = F.min("_raw").over(Window.partitionBy("_b").orderBy(F.desc("_p")))
    q = ranked.withColumn("_best", best).join(F.broadcast(later.select("_b", "_later")), "_b").select("_p", F.least(F.lit(1.0), "_best", F.coalesce("_later", F.lit(1.0))).alias("q"))
    return rows.join(q, rows[p] == q["_p"], "left").drop("_p")


def cosine(a: DataFrame, b: DataFrame, key: str = "context", value: str = "total_norm") -> DataFrame:
    """One row: cosine of two vectors by key; keys that one lacks count as 0."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full").na.fill(0.0)
    return both.agg(F.try_divide(F.sum(F.col("_a") * F.col("_b")), F.sqrt(F.sum(F.col("_a") ** 2)) * F.sqrt(F.sum(F.col("_b") ** 2))).alias("cosine"))


def cosine_matrix(long: DataFrame, name: str = "name", key: str = "context", value: str = "total_norm") -> DataFrame:
    """(left, right, cosine) of all pairs of a few named vectors in long form."""
    norm = long.groupBy(name).agg(F.sqrt(F.sum(F.col(value) ** 2)).alias("_norm"))
    l, r = long.select(F.col(name).alias("left"), key, F.col(value).alias("_l")), long.select(F.col(name).alias("right"), key, F.col(value).alias("_r"))
    dot = l.join(r, key).groupBy("left", "right").agg(F.sum(F.col("_l") * F.col("_r")).alias("_dot"))
    ln, rn = norm.select(F.col(name).alias("left"), F.col("_norm").alias("_ln")), norm.select(F.col(name).alias("right"), F.col("_norm").alias("_rn"))
    return dot.join(ln, "left").join(rn, "right").select("left", "right", F.try_divide("_dot", F.col("_ln") * F.col("_rn")).alias("cosine"))


def difference(a: DataFrame, b: DataFrame, key: str = "context", value: str = "total_norm", renormalize: bool = False) -> DataFrame:
    """(key, norm_a, norm_b, diff); keys that one lacks count as 0. renormalize: keys with N are dropped first."""

    def side(df: DataFrame, out: str) -> DataFrame:
        if not renormalize:
            return df.select(key, F.col(value).alias(out))
        clean = df.where(~F.col(key).contains("N"))
        return clean.select(key, (F.col(value) / F.sum(value).over(Window.partitionBy())).alias(out))

    both = side(a, "norm_a").join(side(b, "norm_b"), key, "full").na.fill(0.0)
    return both.withColumn("diff", F.col("norm_a") - F.col("norm_b"))


#: Places drawn one by one up to so many sites of a group, numbers that are drawn before they are counted, and cells that guide a draw to its place.
FEW_SITES, DRAWN, GUIDES = 800, 1 << 16, 256


def restricted(sig: DataFrame, other: DataFrame, key: str = "context") -> DataFrame:
    """The rows of a signature whose context the other one has too."""
    return sig.join(other.select(key).distinct(), key, "left_semi")


def with_background(sig: DataFrame, background: str) -> DataFrame:
    """The rows of a comparison table with a background of 0 or more; those without one go."""
    return sig.where(F.col(background) >= 0)


def mixed(x: np.ndarray) -> np.ndarray:
    """Random bits from counters, in place (the mixing of SplitMix64)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def few_draws(seeds: np.ndarray, n: np.ndarray, p: np.ndarray, n_random: int, total: np.ndarray) -> None:
    """Adds to total (replicates x places) a place for each site of each group (rows of p, n sites each) and replicate.

    A site draws a number of 32 bits a replicate from its group's seed and its own number. The upper bits lead to a cell of
    the distribution function, from whose first place the search goes on; a place without a share is never met.
    """
    width, half = p.shape[1], (n_random + 1) // 2
    upto = p.cumsum(1)
    ends = np.minimum(upto / upto[:, -1:] * 2.0**32, 2.0**32 - 1).astype("u4")
    last = width - 1 - (p[:, ::-1] > 0).argmax(1)  # of the places with a share
    ends[np.arange(width) >= last[:, None]] = 2**32 - 1
    cell = (ends.astype("i8") + (2**32 // GUIDES - 1)) // (2**32 // GUIDES)  # the first cell that starts at an end or beyond
    filled = np.bincount((cell + np.arange(len(p))[:, None] * (GUIDES + 1)).ravel(), minlength=len(p) * (GUIDES + 1))
    guide = np.minimum(filled.reshape(-1, GUIDES + 1)[:, :GUIDES].cumsum(1), last[:, None]).astype("i4")
    flat, guide = ends.ravel(), (guide + (np.arange(len(p)) * width)[:, None]).ravel().astype("i8")
    group = np.repeat(np.arange(len(p)), n)
    number = np.arange(len(group)) - np.repeat(n.cumsum() - n, n)
    stride = np.uint64(0x9E3779B97F4A7C15)
    start = seeds.astype("u8")[group] + number.astype("u8") * np.uint64(half) * stride
    row = np.arange(half, dtype="u8") * stride
    place = np.arange(2 * half) * width
    rows_a_time = max(DRAWN // (2 * half), 1)
    for low in range(0, len(group), rows_a_time):
        some = slice(low, low + rows_a_time)
        u = mixed(start[some, None] + row).view("u4")[:, :n_random]
        at = guide.take((u >> np.uint32(32 - GUIDES.bit_length() + 1)) + (group[some] * GUIDES)[:, None]).ravel()
        u = np.minimum(u, np.uint32(2**32 - 2)).ravel()
        at += u >= flat.take(at)
        moved = np.flatnonzero(u >= flat.take(at))
        while len(moved):
            at[moved] += 1
            moved = moved[u[moved] >= flat[at[moved]]]
        at = at.reshape(-1, n_random) + (place[:n_random] - (group[some] * width)[:, None])
        total += np.bincount(at.ravel(), minlength=total.size).reshape(total.shape)


def multinomial_null(probabilities: DataFrame, n_random: int, seed: int = 42) -> DataFrame:
    """(replicate, position, n): per replicate the sites of each group are dealt anew over its positions, and summed over the groups.

    probabilities has id, strand, n and either position and p, or ps with the shares of positions 1, 2, ... Each task draws
    all replicates of its groups and sums them before anything is shuffled: the few sites of most groups place by place, many
    groups at once, more as counts of a multinomial law. A group's draws follow from seed, id and strand alone.
    """
    s = F.pmod(F.xxhash64(F.lit(seed), "id", "strand"), F.lit(1 << 62)).alias("s")
    if "ps" in probabilities.columns:
        groups = probabilities.select("n", s, F.lit(None).cast("array<bigint>").alias("position"), F.col("ps").alias("p"))
    else:
        groups = probabilities.groupBy("id", "strand").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("position", "p"))).alias("ps"))
        groups = groups.select("n", s, F.transform("ps", lambda x: x["position"].cast("bigint")).alias("position"), F.transform("ps", lambda x: x["p"]).alias("p"))
    groups = groups.where("p IS NOT NULL AND n > 0").select(F.col("n").cast("long").alias("n"), "s", "position", F.col("p").cast("array<double>").alias("p"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, ...], np.ndarray] = {}  # groups of the same positions are summed as one table
        for batch in batches:
            n, seeds = (batch.column(c).to_numpy() for c in (0, 1))
            sizes = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], sizes.cumsum()])
            values = batch.column(3).flatten().to_numpy()
            if batch.column(2).null_count == len(n):
                kinds = {(int(width),): np.flatnonzero(sizes == width) for width in np.unique(sizes)}
            else:
                names: dict[tuple[int, ...], list[int]] = {}
                for r, where in enumerate(batch.column(2).to_pylist()):
                    names.setdefault(tuple(where), []).append(r)
                kinds = {where: np.array(rows) for where, rows in names.items()}
            for where, rows in kinds.items():
                width = int(sizes[rows[0]])
                if width and where not in total:
                    total[where] = np.zeros((n_random, width), "i8")
                many = n[rows] > FEW_SITES
                for r in rows[many] if width else ():
                    p = values[first[r] : first[r] + width]
                    total[where] += np.random.default_rng(int(seeds[r])).multinomial(n[r], p / p.sum(), size=n_random)
                few = rows[~many]
                for low in range(0, len(few) if width else 0, 128):
                    some = few[low : low + 128]
                    few_draws(seeds[some], n[some], values[first[some][:, None] + np.arange(width)], n_random, total[where])
        for where, counts in total.items():
            names_ = np.arange(1, where[0] + 1) if counts.shape[1] != len(where) else np.array(where)
            for low in range(0, n_random, 100):
                some = counts[low : low + 100]
                columns = np.repeat(np.arange(low, low + len(some)), some.shape[1]), np.tile(names_, len(some)), some.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["replicate", "position", "n"])

    return groups.mapInArrow(draw, "replicate long, position long, n long").groupBy("replicate", "position").agg(F.sum("n").alias("n"))


def empirical_p(null: DataFrame, observed: DataFrame, value: str = "snr") -> DataFrame:
    """One row: p_value = (number of null values above the observed one + 1) / (number + 1)."""
    one = observed.select(F.col(value).alias("_o"))
    return null.crossJoin(F.broadcast(one)).agg(((F.count_if(F.col(value) > F.col("_o")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))  # one row


def cosines(target: np.ndarray, alpha: float, n_draws: int, seed: int, block: int, blocks: int) -> np.ndarray:
    """Cosines to target of a block's share of the draws."""
    size = n_draws // blocks + (block < n_draws % blocks)
    x = np.random.default_rng([seed, block]).dirichlet(np.full(len(target), alpha), size)
    return x @ target / (np.linalg.norm(x, axis=1) * np.linalg.norm(target))


def dirichlet_null(spark: SparkSession, signature: list[float], n_draws: int, alpha: float = 2.0, seed: int = 42, blocks: int = 64) -> DataFrame:
    """(draw, cosine) of n_draws symmetric Dirichlet vectors to a signature of a few dozen channels. Draws follow from seed and block, whatever the number of tasks."""
    target = np.asarray(signature, float)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch["id"]:
                cos = cosines(target, alpha, n_draws, seed, int(block), blocks)
                yield pd.DataFrame({"draw": np.arange(len(cos)) * blocks + int(block), "cosine": cos})

    return spark.range(blocks).mapInPandas(draw, "draw long, cosine double")


def null_score(draws: DataFrame, observed: float) -> DataFrame:
    """One row: share of draws at least as similar as observed, and -log10 of it, at most log10 of their number."""
    n = F.count(F.lit(1))
    return draws.agg((F.count_if(F.col("cosine") >= observed) / n).alias("share"), (-F.log10(F.greatest(F.count_if(F.col("cosine") >= observed), F.lit(1)) / n)).alias("score"))


def alpha_sweep(spark: SparkSession, signature: list[float], alphas: list[float], n_draws: int, level: float = 0.85, seed: int = 42) -> DataFrame:
    """(alpha, share, mean_cosine): share of draws with at least this similarity, for each alpha."""
    target, blocks = np.asarray(signature, float), 4
    values = F.array(*[F.lit(float(a)) for a in alphas])
    each = spark.range(len(alphas) * blocks).select(F.floor(F.col("id") / blocks).alias("i"), (F.col("id") % blocks).alias("block"))
    each = each.select("i", "block", F.element_at(values, (F.col("i") + 1).cast("int")).alias("alpha")).repartition("i", "block")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, block, alpha in batch.itertuples(index=False):
                cos = cosines(target, alpha, n_draws, seed + int(i), int(block), blocks)
                yield pd.DataFrame({"alpha": [alpha], "n": [len(cos)], "above": [int((cos >= level).sum())], "total": [float(cos.sum())]})

    sums = each.mapInPandas(draw, "alpha double, n long, above long, total double").groupBy("alpha").agg(F.sum("n").alias("n"), F.sum("above").alias("above"), F.sum("total").alias("total"))
    return sums.select("alpha", (F.col("above") / F.col("n")).alias("share"), (F.col("total") / F.col("n")).alias("mean_cosine"))


#: Equal cells that a range of values is cut into, and so many values at most that are counted one by one.
CELLS, SINGLE = 4096, 10_000


def exact_quantile(rows: DataFrame, value: str, q: float, cells: int = CELLS, single: int = SINGLE) -> float | None:
    """The quantile of the values, with linear interpolation between neighbours; None if there are none. Nulls and NaN take no part.

    A round counts the values in equal cells between the least and the largest, and keeps the cell that the rank falls in,
    until that holds few values, which are counted one by one, or one value, however often. So a task holds as many
    counts as there are cells, and the driver sees these. A round makes the range cells times shorter at least.
    """
    x = F.col(value).cast("double")
    held = rows.select(x.alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    finite = F.when(F.abs("x") < float("inf"), F.col("x"))
    count = held.agg(F.count("x").alias("n"), F.count_if(F.col("x") == -float("inf")).alias("low"), F.count(finite).alias("m"), F.min(finite).alias("a"), F.max(finite).alias("b"))
    n, before, m, a, b = count.first()
    if not n:
        return None
    place = q * (n - 1)
    rank = min(int(place), n - 1)

    def value_at(rank: int, before: int, m: int, a: float, b: float) -> float:
        """The value of a rank, of which m values from a to b, after before others, are left."""
        while True:
            if rank < before:
                return -float("inf")
            if rank >= before + m:
                return float("inf")
            if a == b:
                return a
            inside = held.where(F.col("x").between(a, b))
            if m <= single:
                for r in sorted(inside.groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()):
                    before += r.n
                    if rank < before:
                        return r.x
            half = 0.5 if b - a == float("inf") else 1.0
            cell = F.least(F.floor((F.col("x") * half - a * half) / (b * half - a * half) * cells), F.lit(cells - 1))
            for r in sorted(inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()):
                if rank < before + r.n:
                    m, a, b = r.n, r.a, r.b
                    break
                before += r.n

    low = value_at(rank, before, m, a, b)
    if place == rank:
        return low
    high = value_at(rank + 1, before, m, a, b)
    return low if low == high else low + (high - low) * (place - rank)


def above_quantile(rows: DataFrame, value: str, q: float = 0.9) -> DataFrame:
    """The rows above the exact quantile (linear interpolation) of the non-zero values; none if there are none."""
    some = rows.where(F.col(value) != 0)
    cut = exact_quantile(some, value, q)
    return some.where(F.col(value) > F.lit(cut).cast("double"))


def replicate_mean(a: DataFrame, b: DataFrame, key: str, means: list[str], texts: list[str] | None = None) -> DataFrame:
    """Rows of two replicates with the same key: the mean of each number, and x/y of each text. Keys that repeat pair with each other."""
    l, r = a.alias("x"), b.alias("y")
    joined = l.join(r, F.col(f"x.{key}") == F.col(f"y.{key}"))
    return joined.select(F.col(f"x.{key}").alias(key), *[((F.col(f"x.{c}") + F.col(f"y.{c}")) / 2).alias(c) for c in means], *[F.concat_ws("/", F.col(f"x.{c}").cast("string"), F.col(f"y.{c}").cast("string")).alias(c) for c in texts or []])


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of either side whose key the other lacks."""
    return a.join(b, key, "left_anti").unionByName(b.join(a, key, "left_anti"))


def random_subset(rows: DataFrame, k: int, key: list[str], seed: int = 42) -> DataFrame:
    """k rows, the same on each run: those with the smallest hashes of seed and key."""
    return rows.withColumn("_h", F.xxhash64(F.lit(seed), *key)).orderBy("_h", *key).limit(k).drop("_h")


def top_sites(sites: DataFrame, k: int, p: str = "pvalue", ties: tuple[str, ...] = ("chrom", "pos", "strand")) -> DataFrame:
    """The k sites with the smallest p-values; ties by position."""
    return sites.orderBy(F.asc(p), *ties).limit(k)


def mean_and_spread(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


