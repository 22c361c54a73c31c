"""Exact centroid clustering with Drake's adaptive bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lloyd
from .common import discard, materialize

#: Lower bounds of single centroids that a vector starts with, at least; later passes keep what the last one used.
BOUNDS = 4
#: Notes of a pass: the bounds it used, and the exact distances it took.
_USED, _TAKEN = -1, -2
_NAMES = ["id", "q", "wide", "cluster", "upper", "near", "lower"]
_STATE = "id long, q array<int>, wide array<double>, cluster int, upper double, near array<int>, lower array<double>"


class Clustering(NamedTuple):
    """members: id, cluster and distance (squared) of each vector; centroids; the exact distances of each pass."""

    members: DataFrame
    centroids: lloyd.Table
    taken: list[int]


def scan(x: np.ndarray, centres: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cluster, upper, near (the b next centroids) and lower (their bounds and one for the rest), from all distances."""
    d = lloyd.squared(x, centres)
    order = np.argsort(d, axis=1, kind="stable")  # ties: the smaller number
    root = np.sqrt(np.take_along_axis(d, order, 1))
    rest = lloyd.down(root[:, b + 1 : b + 2]) if len(centres) > b + 1 else np.full((len(x), 1), np.inf)
    return order[:, 0], lloyd.up(root[:, 0]), order[:, 1 : b + 1], np.hstack([lloyd.down(root[:, 1 : b + 1]), rest])


def narrowed(near: np.ndarray, lower: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The first b bounds; the bound of the rest then covers the others too."""
    return near[:, :b], np.hstack([lower[:, :b], lower[:, b:].min(1, keepdims=True)])


def follow(
    x: np.ndarray, centres: np.ndarray, moves: np.ndarray, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray
) -> tuple[int, int]:
    """Bring the states to moved centroids, in place; gives the bounds used and the distances taken.

    The bounds move with their centroids, the last one with the farthest move. A vector whose upper bound is under the
    least of them keeps its centroid. One whose upper bound is under the least from place z on ranks its centroid and
    the z before it by exact distances. Where not even the bound of the rest is above, all centroids are ranked.
    """
    b = near.shape[1]
    upper[:] = lloyd.up(upper + moves[cluster])
    lower[:, :b] = lloyd.down(lower[:, :b] - moves[near])
    lower[:, b] = lloyd.down(lower[:, b] - moves.max())
    least = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]
    asks = (upper[:, None] >= least).sum(1)
    used = taken = 0
    for z in np.unique(asks).tolist():
        rows = np.flatnonzero(asks == z)
        if z == b + 1:
            cluster[rows], upper[rows], near[rows], lower[rows] = scan(x[rows], centres, b)
            taken += len(rows) * len(centres)
        elif z:
            some = np.hstack([cluster[rows, None], near[rows, :z]])
            gap = x[rows][:, None, :] - centres[some]
            d = np.einsum("ijk,ijk->ij", gap, gap)
            order = np.lexsort((some, d), axis=1)
            some, root = np.take_along_axis(some, order, 1), np.sqrt(np.take_along_axis(d, order, 1))
            cluster[rows], upper[rows] = some[:, 0], lloyd.up(root[:, 0])
            near[rows, :z], lower[rows, :z] = some[:, 1:], lloyd.down(root[:, 1:])
            taken += some.size
        used = max(used, min(z, b))
    return used, taken


def assign(table: DataFrame, centroids: lloyd.Table, moves: np.ndarray | None, b: int) -> DataFrame:
    """One pass: each vector's state for these centroids, and the sums of each task.

    moves: how far the centroids went since the states were made, or None where there are no states.
    """
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, used, taken, states = lloyd.Sums(), 0, 0, None
        for batch in batches:
            for some, x, plain in lloyd.parted(batch, 1, [centroids]):
                n = some.num_rows
                if not plain:  # all distances, and no bounds
                    cluster, upper = np.array([lloyd.nearest(row, centroids)[1] for row in x]), np.full(n, np.inf)
                    near, lower = np.zeros((n, b), int), np.full((n, b + 1), -np.inf)
                    for slot, row in zip(cluster.tolist(), x, strict=True):
                        sums.add_wide(slot, row)
                    taken += n * k
                else:
                    c = np.array(centroids, "f8")
                    if moves is None:
                        cluster, upper, near, lower = scan(x, c, b)
                        taken += n * k
                    else:
                        cluster, upper = some.column(3).to_numpy().astype(int), some.column(4).to_numpy().copy()
                        near, lower = narrowed(lloyd.matrix(some.column(5), "i8", n), lloyd.matrix(some.column(6), "f8", n), b)
                        u, t = follow(x, c, moves, cluster, upper, near, lower)
                        used, taken = max(used, u), taken + t
                    sums.add(cluster, x)
                columns = [*some.columns[:3], pa.array(cluster, pa.int32()), pa.array(upper), lloyd.lists(near, pa.int32()), lloyd.lists(lower, pa.float64())]
                out = lloyd.with_states(columns, _NAMES)
                states = pa.schema(list(out.schema)[: len(_NAMES)])
                yield out
        if states is not None:
            yield sums.batch(states, {_USED: used, _TAKEN: taken})

    return table.mapInArrow(run, f"{_STATE}, {lloyd.SUMS}")


def distances(states: DataFrame, centroids: lloyd.Table) -> DataFrame:
    """id, cluster and the exact squared distance to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x, plain in lloyd.parted(batch, 1, [centroids]):
                cluster = some.column(3).to_numpy()
                if plain:
                    gap = x - np.array(centroids, "f8")[cluster]
                    far = pa.array(np.einsum("ij,ij->i", gap, gap).astype("i8"))
                else:
                    each = [sum((a - b) ** 2 for a, b in zip(row, centroids[c], strict=True)) for row, c in zip(x, cluster, strict=True)]
                    far = pa.array([min(d, lloyd.MOST) for d in each], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(3), far], ["id", "cluster", "distance"])

    return states.select("id", "q", "wide", "cluster").mapInArrow(run, "id long, cluster int, distance long")


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, scale: float = 1024.0, dim: int = 64, seed: str = "3",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> Clustering:
    """Lloyd's iterations over whole numbers, exact: the result is that of comparing every vector with every centroid each round.

    Components become floor(scale * x). The first centroids are the k vectors with the smallest sha256 of "seed:id" (of equal
    ids those with smaller components). Each round assigns the vectors to their nearest centroids (ties: the smaller number)
    and puts each centroid with members at their mean, rounded down. A vector's row holds its centroid, an upper bound of
    the distance to it, lower bounds for several next nearest centroids and one for all others; bounds are rounded
    away from the distances, so a vector is passed over only where its order is certain. How many single bounds a pass
    keeps follows from how many the one before used. Each pass reads the states of the one before from the shared folder,
    writes its own beside the sums of its tasks, and the older ones go; the driver sees k rows of sums. It ends early where
    no centroid moves.

    Left out: null vectors, those of another length than dim, and those with components that are null or not finite after
    scaling. A null id is an id like others, but last in the order of hashes. Rows that repeat are rows of their own. Fewer
    than k vectors: as many centroids; none, an empty table: no rows and no centroids. Distances over a long are given
    as its largest value. Vectors beyond what floats hold exactly are compared in whole numbers with all centroids.
    """
    rows = vectors.where(lloyd.usable(F.col(vector_col), dim, scale)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("_v"))
    table = materialize(lloyd.whole(rows, scale, ["id"], "_v"), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = table.select(key.alias("key"), "q", "wide").orderBy(F.asc_nulls_last("key"), "q", "wide").limit(k).collect()
    centroids = [[int(v) for v in (r.q if r.q is not None else r.wide)] for r in first]
    if not centroids:
        return Clustering(table.selectExpr("id", "cast(null AS int) AS cluster", "cast(null AS long) AS distance"), [], [])
    b = min(len(centroids) - 1, max(BOUNDS, -(-len(centroids) // 4)))
    least = min(b, -(-len(centroids) // 8))
    moves, taken = None, []
    for i in range(rounds + 1):
        passed = materialize(assign(table, centroids, moves, b), "assigned")
        discard(table)
        table = passed.where(F.col("slot").isNull()).select(*_NAMES)
        sums, notes = lloyd.totals(passed, dim)
        taken.append(notes[_TAKEN][1])
        if i == rounds:
            break
        if i:
            b = max(least, min(b, notes[_USED][0]))
        new = lloyd.means(centroids, sums)
        if new == centroids:
            break
        moves, centroids = lloyd.moved(centroids, new), new
    return Clustering(distances(table, centroids), centroids, taken)


def report(done: Clustering) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 (of its components as decimals joined by commas).

    A table of as many rows as centroids is broadcast to the members.
    """
    spark = done.members.sparkSession
    members = materialize(done.members, "members")
    found = members.groupBy("cluster").agg(lloyd.capped(F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()
    whole = min(sum(r.s for r in found), lloyd.MOST)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in done.centroids]
    each = [(r.cluster, r.s, whole, sha[r.cluster]) for r in found]
    small = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(small), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
