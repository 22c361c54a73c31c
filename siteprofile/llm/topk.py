"""Exact top-k search over vectors: vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, materialize, small

#: Rows of a block of cells and of a block of queries; cells that each dimension is cut into, at most 256.
BLOCK, QUERIES, CELLS = 8192, 512, 64
#: Parts that the blocks of cells of one dimension are dealt to, at most; components of the queries, or scores of theirs if these are more, that a task holds at a time.
PARTS, HELD = 48, 1 << 21
_EXACT = float(1 << 53)
#: Columns of a row of queries or of cells where they meet in a task.
_MET = ["dim", "part", "group", "cell", "block", "ids", "rows", "data", "more", "least", "step"]


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def narrowed(x: np.ndarray) -> bytes:
    """Whole numbers in 1, 2 or 4 bytes each, the fewest that hold them all, or as 64-bit floats."""
    least, most = x.min(initial=0), x.max(initial=0)
    kind = next((k for k in ("i1", "i2", "i4") if np.iinfo(k).min <= least and most <= np.iinfo(k).max), "f8")
    return x.astype(kind).tobytes()


def widened(data: bytes | pa.Buffer, n: int, dim: int) -> np.ndarray:
    """The n vectors that narrowed() wrote, as 64-bit floats."""
    kind = {1: "i1", 2: "i2", 4: "i4", 8: "f8"}[memoryview(data).nbytes // (n * dim)] if n * dim else "f8"
    return np.frombuffer(data, kind).reshape(n, dim).astype("f8")


def joined(data: list[bytes], dim: int) -> np.ndarray:
    """Vectors of dim components that are narrowed each for itself."""
    if len({len(x) for x in data}) == 1:
        return widened(b"".join(data), len(data), dim)
    return np.concatenate([widened(x, 1, dim) for x in data])


def packed(rows: DataFrame) -> DataFrame:
    """(dim, id, asks, row, data): each vector of whole numbers narrowed, so that equal vectors have equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column(0).to_numpy()
            for d in np.unique(dim).tolist():
                some = batch.filter(pa.array(dim == d))
                x = some.column(4).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(some), d)
                data = pa.array([narrowed(v) for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns[:4], data], ["dim", "id", "asks", "row", "data"])

    return rows.select("dim", "id", "asks", "row", "vector").mapInArrow(run, "dim int, id long, asks boolean, row long, data binary")


def cell_sizes(rows: DataFrame, cells: int) -> DataFrame:
    """(dim, least, step): for each dimension of the vectors, where its equal cells begin and how wide they are. One row per length of vector; each task sends its own least and largest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column(0).to_numpy()
            for d in np.unique(dim).tolist():
                if not d:
                    continue
                x = joined(batch.filter(pa.array(dim == d)).column(1).to_pylist(), d)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d), pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(x.min(0)), pa.array(x.max(0))], ["dim", "i", "least", "most"])

    ends = rows.select("dim", "data").mapInArrow(run, "dim int, i int, least double, most double").groupBy("dim", "i").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    step = F.greatest(F.lit(1.0), F.ceil((F.col("most") - F.col("least") + 1) / F.lit(cells)).cast("double"))
    each = F.array_sort(F.collect_list(F.struct("i", "least", step.alias("step"))))
    return ends.groupBy("dim").agg(each.alias("e")).select("dim", F.col("e.least").alias("least"), F.col("e.step").alias("step"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(dim, block, ids, rows, data): rows (dim, id, row, data), about size of one dimension in a row, their vectors joined."""
    counts = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("n"))
    dealt = rows.join(small(counts), "dim").withColumn("block", F.pmod(F.xxhash64("row"), F.col("n")))
    ordered = dealt.select("dim", "block", "id", "row", "data").repartition("dim", "block").sortWithinPartitions("dim", "block", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            ids, numbers = (np.concatenate([h.column(i).to_numpy().astype("i8") for h in held]).tobytes() for i in (2, 3))
            data = narrowed(joined([x for h in held for x in h.column(4).to_pylist()], key[0]))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids, numbers, data))], ["dim", "block", "ids", "rows", "data"])

        for batch in batches:
            dim, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((dim[1:] != dim[:-1]) | (block[1:] != block[:-1])) + 1
            for low, high in zip([0, *edges], [*edges, len(dim)], strict=True):
                if high == low:
                    continue
                if (dim[low], block[low]) != key:
                    if key:
                        yield close()
                    key, held = (dim[low], block[low]), []
                held.append(batch.slice(low, high - low))
        if key:
            yield close()

    return ordered.mapInArrow(run, "dim int, block long, ids binary, rows binary, data binary")


def quantised(whole: DataFrame, sizes: DataFrame) -> DataFrame:
    """(dim, block, ids, rows, cells, whole, least, step): beside the blocks of exact vectors the approximation file, a byte for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                least, step = (np.array(batch.column(c)[i].as_py(), "f8") for c in (5, 6))
                x = widened(batch.column(4)[i].as_buffer(), batch.column(3)[i].as_buffer().size // 8, len(least))
                made = [np.clip((x - least) // step, 0, 255).astype(np.uint8).tobytes(), least.tobytes(), step.tobytes()]
                cells, least, step = (pa.array([y], pa.binary()) for y in made)
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns[:4], cells, one.column(4), least, step], ["dim", "block", "ids", "rows", "cells", "whole", "least", "step"])

    schema = "dim int, block long, ids binary, rows binary, cells binary, whole binary, least binary, step binary"
    return whole.join(small(sizes), "dim").select("dim", "block", "ids", "rows", "data", "least", "step").mapInArrow(run, schema)


def bounds(middle: np.ndarray, step: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the queries with twice the middles of cells, and for each query how far off twice the inner product with a vector there can be; a margin covers the rounding of large numbers."""
    most = np.abs(q).sum(1) * (np.abs(middle).max(initial=0) + step.max(initial=0))
    kind = "f4" if most.max(initial=0) < 1 << 23 else "f8"  # sums of whole numbers, exact in any order
    centre = q.astype(kind) @ middle.astype(kind).T
    return centre, np.abs(q) @ (step - 1) + np.where(most * 4 < _EXACT, 0, most * 1e-12)


def at_least(centre: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Where a row of centre reaches its limit, which is taken a little low."""
    with np.errstate(over="ignore"):
        return centre >= np.nextafter(limit.astype(centre.dtype), centre.dtype.type(-np.inf))[:, None]


def some_kth(centre: np.ndarray, k: int) -> np.ndarray:
    """A number for each row that k of its values reach at least: the kth of the largest ones of 4 k sets of columns."""
    n, m = centre.shape
    if m < 8 * k:
        return np.full(n, -np.inf)
    sets = centre[:, : m - m % (4 * k)].reshape(n, -1, 4 * k).max(1)
    return np.partition(sets, 3 * k, axis=1)[:, 3 * k].astype("f8")


def own(q_rows: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a query meets its own row; rows are in order."""
    at = np.minimum(np.searchsorted(rows, q_rows), len(rows) - 1)
    same = np.flatnonzero(rows[at] == q_rows)
    return same, at[same]


def largest(best: np.ndarray, a: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The k largest of each row of best (of k columns) and of the values, whose rows a are in order."""
    n = np.bincount(a, minlength=len(best))
    more = np.full((len(best), n.max(initial=0)), -np.inf)
    more[a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)] = value
    return np.partition(np.concatenate([best, more], 1), more.shape[1], axis=1)[:, more.shape[1] :]


def exact(q: np.ndarray, x: np.ndarray) -> int:
    """The inner product of two vectors of whole numbers, at most a 64-bit number."""
    if x.size and np.abs(x).max() * np.abs(q).sum() < _EXACT:
        return int(q @ x)
    return min(max(sum(int(a) * int(b) for a, b in zip(q, x, strict=True)), -(1 << 63)), (1 << 63) - 1)


class _Best:
    """The k best of a block of queries among the vectors that a task has seen: those with the highest scores, ties to the smaller id."""

    def __init__(self, level: np.ndarray, k: int) -> None:
        self.k, self.limit = k, level.copy()  # of twice the score
        self.kth, self.kth_id = np.full(len(level), np.iinfo("i8").min), np.full(len(level), np.iinfo("i8").max)
        self.held = tuple(np.empty(0, "i8") for _ in range(4))  # query, score, id, row

    def add(self, a: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        some = (2.0 * score >= self.limit[a]) & ((score > self.kth[a]) | (score == self.kth[a]) & (ids <= self.kth_id[a]))
        if not some.any():
            return
        a, score, ids, rows = (np.concatenate([x, y[some]]) for x, y in zip(self.held, (a, score, ids, rows), strict=True))
        order = np.lexsort((rows, ids, ~score, a))
        place = np.arange(len(a)) - np.searchsorted(a[order], a[order])
        self.held = tuple(x[order][place < self.k] for x in (a, score, ids, rows))
        last = order[place == self.k - 1]
        self.kth[a[last]], self.kth_id[a[last]] = score[last], ids[last]
        reached = np.where(score[last] == np.iinfo("i8").min, -np.inf, np.nextafter(2.0 * score[last], -np.inf))
        self.limit[a[last]] = np.maximum(self.limit[a[last]], reached)

    def meet(self, q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, centre: np.ndarray, reach: np.ndarray) -> None:
        """Take in a block of vectors x. Those whose upper bound reaches the limit are multiplied, in the order of these bounds, which raises the limit; where the bounds rule out little, all are."""
        same = own(q_rows, rows)
        centre[same] = -np.inf
        a, b = np.nonzero(at_least(centre, self.limit - reach))
        a, b = a[other := centre[a, b] > -np.inf], b[other]
        fits = np.abs(x).max(initial=0) * np.abs(q).sum(1).max(initial=0) < _EXACT
        if fits and len(a) * 16 > centre.size:
            scores = q @ x.T
            scores[same] = -np.inf
            if scores.shape[1] > self.k:
                self.limit = np.maximum(self.limit, 2 * np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
            a, b = np.nonzero((2 * scores >= self.limit[:, None]) & (scores > -np.inf))
            for at in range(0, len(a), 1 << 18):
                i, j = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
                self.add(i, scores[i, j].astype("i8"), ids[j], rows[j])
            return
        upper = centre[a, b] + reach[a]
        order = np.argsort(-upper, kind="stable")
        size = max(1, HELD // max(1, x.shape[1]))
        for at in range(0, len(a), size):
            some = order[at : at + size]
            some = some[upper[some] >= self.limit[a[some]]]
            i, j = a[some], b[some]
            score = np.einsum("ij,ij->i", q[i], x[j]).astype("i8") if fits else np.array([exact(q[g], x[h]) for g, h in zip(i, j, strict=True)], "i8")
            self.add(i, score, ids[j], rows[j])


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, cells: int = CELLS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: for each row that meets the condition queries, the k rows with the highest inner product, itself left out.

    Components become floor(scale * x), so scores are whole numbers and exact. The approximation file has a byte per
    component: its cell. Both passes deal its blocks to PARTS parts at most and the blocks of queries to groups that a task can
    hold, and each group meets each part in a task: the queries come first and stay, the blocks of the file go past them. So
    a block is sent once for each group, and a query once for each part, not once for each block. Pass one: the cells bound
    every score from both sides, and what comes out is each query's k largest lower bounds of a part, merged over the parts.
    Pass two reads the file again with its exact vectors beside it and lets through those whose upper bound reaches the kth of
    these. Only they are multiplied, in the order of their upper bounds, until the next bound is below the kth score of the
    task. What leaves it is k rows a query at most.

    Null vectors and those with null or non-finite components take no part; a query with null id does not either, nor does
    a vector with null id. Vectors of other dimensions are not compared. Rows that repeat an id or a vector are rows of
    their own; ties go to the smaller id. Of rows with the same vector only the k + 1 smallest ids can be in a result, so
    the others are not searched. Fewer than k rows: all. Empty table: no rows. Empty vectors: scores of 0 with each other.
    """
    bound_batches(vectors.sparkSession)
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.size(vector_col).alias("dim"), whole.alias("vector"))
    rows = materialize(packed(rows.withColumn("row", F.monotonically_increasing_id())), "vectors")
    alike = Window.partitionBy("dim", "data").orderBy("id", "row")
    stored = materialize(rows.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k + 1).select("dim", "id", "row", "data"), "stored")
    empty = rows.where("dim = 0").limit(1).select("dim", *[F.array().cast("array<double>").alias(c) for c in ("least", "step")])
    sizes = materialize(cell_sizes(rows, min(cells, 256)).unionByName(empty), "cell-sizes")
    file = materialize(quantised(blocks(stored, BLOCK), sizes), "cells")
    asked = materialize(blocks(rows.where("asks").select("dim", "id", "row", "data"), QUERIES), "query-blocks")
    n_blocks, n_asked = (t.groupBy("dim").agg((F.max("block") + 1).alias(c)) for t, c in ((file, "n"), (asked, "n_asked")))
    together = F.greatest(F.lit(1), F.floor(F.lit(HELD) / (F.lit(QUERIES) * F.greatest("dim", F.lit(k), F.lit(1)))))
    grid = n_blocks.join(n_asked, "dim").select("dim", F.least("n", F.lit(PARTS)).alias("parts"), F.ceil(F.col("n_asked") / together).alias("groups"))
    grid = materialize(grid, "grid")
    tasks = grid.agg(F.sum(F.col("parts") * F.col("groups"))).first()[0] or 1

    def meet(asks: Column, vectors: Column, questions: DataFrame) -> DataFrame:
        """Rows of queries with asks beside them, then of cells with vectors beside them, by part and group in a task."""
        none, few = F.lit(None).cast("binary"), small(grid)
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = questions.join(few, "dim").select("*", each("parts").alias("part")).select("dim", "part", F.pmod("block", "groups").alias("group"), F.lit(False).alias("cell"), "block", "ids", "rows", "data", asks.alias("more"), none.alias("least"), none.alias("step"))
        right = file.join(few, "dim").select("*", each("groups").alias("group")).select("dim", F.pmod("block", "parts").alias("part"), "group", F.lit(True).alias("cell"), "block", "ids", "rows", F.col("cells").alias("data"), vectors.alias("more"), "least", "step")
        by = ["dim", "part", "group"]
        return left.unionByName(right).select(_MET).repartition(min(2 * tasks, 10_000), *by).sortWithinPartitions(*by, "cell", "block")

    def numbers(batch: pa.RecordBatch, i: int, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(batch.column(_MET.index(name))[i].as_buffer(), kind)

    def vectors_of(batch: pa.RecordBatch, i: int, name: str) -> np.ndarray:
        return widened(batch.column(_MET.index(name))[i].as_buffer(), len(numbers(batch, i, "rows", "i8")), batch.column(0)[i].as_py())

    def middles(batch: pa.RecordBatch, i: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        least, step = (numbers(batch, i, c, "f8") for c in ("least", "step"))
        return 2 * least + step - 1 + 2 * step * numbers(batch, i, "data", "u1").reshape(n, len(least)), step

    def pass_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # block, rows, vectors, lower bounds

        def out() -> Iterator[pa.RecordBatch]:
            for block, _, _, best in held:
                low = best.astype("f4")
                low = np.where(low > best, np.nextafter(low, np.float32(-np.inf)), low)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([block], pa.int64()), pa.array([low.tobytes()], pa.binary())], ["dim", "block", "lower"])

        for batch in batches:
            for i in range(batch.num_rows):
                *name, cell, block = (batch.column(c)[i].as_py() for c in range(5))
                if name != key:
                    yield from out()
                    key, held = name, []
                rows = numbers(batch, i, "rows", "i8").copy()
                if not cell:
                    held.append([block, rows, vectors_of(batch, i, "data"), np.full((len(rows), k), -np.inf)])
                    continue
                middle, step = middles(batch, i, len(rows))
                for h in held:
                    _, q_rows, q, best = h
                    centre, reach = bounds(middle, step, q)
                    centre[own(q_rows, rows)] = -np.inf
                    a, b = np.nonzero(at_least(centre, np.maximum(best.min(1) + reach, some_kth(centre, k))))
                    h[3] = largest(best, a, centre[a, b] - reach[a])
        yield from out()

    def kth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def out() -> pa.RecordBatch:
            level, end = held.min(1).astype("f8"), float(1 << 64)  # scores end at 64 bits, and may tie there
            level = np.where(level <= -end, -np.inf, np.minimum(level, end - 4096))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([level.tobytes()], pa.binary())], ["dim", "block", "kth"])

        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                lower = np.frombuffer(batch.column(2)[i].as_buffer(), "f4").reshape(-1, k)
                if name != key:
                    if key:
                        yield out()
                    key, held = name, lower
                else:
                    held = np.partition(np.concatenate([held, lower], 1), k, axis=1)[:, k:]
        if key:
            yield out()

    def pass_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # ids, rows, vectors, best

        def out() -> Iterator[pa.RecordBatch]:
            for q_ids, q_rows, _, best in held:
                a, score, ids, rows = best.held
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_rows[a], q_ids[a], ids, score, rows)], ["q_row", "query_id", "vec_id", "score", "row"])

        for batch in batches:
            for i in range(batch.num_rows):
                *name, cell, _ = (batch.column(c)[i].as_py() for c in range(5))
                if name != key:
                    yield from out()
                    key, held = name, []
                ids, rows = (numbers(batch, i, c, "i8").copy() for c in ("ids", "rows"))
                if not cell:
                    held.append((ids, rows, vectors_of(batch, i, "data"), _Best(numbers(batch, i, "more", "f8"), k)))
                    continue
                x, (middle, step) = vectors_of(batch, i, "more"), middles(batch, i, len(rows))
                for _, q_rows, q, best in held:
                    best.meet(q, q_rows, x, ids, rows, *bounds(middle, step, q))
        yield from out()

    none = F.lit(None).cast("binary")
    lows = meet(none, none, asked).mapInArrow(pass_one, "dim int, block long, lower binary").repartition("dim", "block").sortWithinPartitions("dim", "block")
    level = materialize(lows.mapInArrow(kth, "dim int, block long, kth binary"), "kth")
    levelled = asked.join(level.hint("merge"), ["dim", "block"])
    found = meet(F.col("kth"), F.col("whole"), levelled).mapInArrow(pass_two, "q_row long, query_id long, vec_id long, score long, row long")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
