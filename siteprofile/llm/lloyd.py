"""What the two exact Lloyd iterations share: whole-number vectors, exact distances, sums of a pass and the means from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Below it whole numbers are exact in 64-bit floats.
EXACT = float(1 << 53)
#: The largest long: longer distances and errors are given as this.
MOST = (1 << 63) - 1
#: Sums leave a task in pieces of so many bits, so that no sum over tasks leaves a long.
PIECE = 40
#: What a pass writes besides its vectors: the sums of its tasks, in rows of their own.
SUMS = "slot int, members long, piece int, sums array<long>"
Table = list[list[int]]


def schema(table: DataFrame, keep: Sequence[str], more: str) -> StructType:
    """Columns of a table, followed by others."""
    return StructType([*(table.schema[c] for c in keep), *StructType.fromDDL(more)])


def usable(vector: Column, dim: int, scale: float) -> Column:
    """Vectors of dim components, all finite, also after scaling."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * F.lit(scale)) < float("inf"), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) == dim) & finite


def whole(vectors: DataFrame, scale: float, keep: Sequence[str], vector_col: str) -> DataFrame:
    """keep, q and wide: the components as floor(scale * x). Vectors of 32-bit numbers are in q, others in wide, as floats; the other is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.floor(batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(batch.num_rows, -1) * scale)
            wide = np.abs(x).max(1) >= 1 << 31
            if wide.any():
                q = pa.array([None if w else row for w, row in zip(wide, np.where(wide[:, None], 0, x).astype("i4"), strict=True)], pa.list_(pa.int32()))
                large = pa.array([row if w else None for w, row in zip(wide, x, strict=True)], pa.list_(pa.float64()))
            else:
                q, large = lists(x.astype("i4"), pa.int32()), pa.nulls(len(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], q, large], [*keep, "q", "wide"])

    return vectors.select(*keep, vector_col).mapInArrow(run, schema(vectors, keep, "q array<int>, wide array<double>"))


def matrix(column: pa.Array, kind: str, rows: int) -> np.ndarray:
    """A column of equally long lists as a matrix that can be changed."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(kind).reshape(rows, -1) if rows else np.zeros((0, 0), kind)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a column of lists."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def fits(x: np.ndarray, centres: Table) -> bool:
    """Whether all squared distances, and the terms they are made of, are exact in 64-bit floats."""
    most = max(float(np.abs(x).max(initial=0)), float(max((abs(v) for c in centres for v in c), default=0)))
    return 4 * x.shape[1] * most * most < EXACT


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """All squared distances of rows and centres that fit, exact."""
    return (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)


def nearest(x: Sequence[int], centres: Table) -> tuple[int, int]:
    """(squared distance, number) of the nearest centre, for numbers of any size; ties to the smaller number."""
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def parted(batch: pa.RecordBatch, at: int, tables: list[Table]) -> Iterator[tuple[pa.RecordBatch, np.ndarray | list[list[int]], bool]]:
    """A batch in two: rows whose vectors (column at, or the next) fit the tables, as a matrix of floats, and the others, as whole numbers of any size."""
    wide = np.array(batch.column(at).is_null())
    x = matrix(batch.column(at).filter(pa.array(~wide)), "f8", int((~wide).sum()))
    part = x.shape[1] // len(tables)
    if not all(fits(x[:, p * part : (p + 1) * part], t) for p, t in enumerate(tables)):
        wide[:] = True
    if not wide.all():
        yield batch.filter(pa.array(~wide)), x, True
    if wide.any():
        some = batch.filter(pa.array(wide))
        both = zip(some.column(at), some.column(at + 1), strict=True)
        yield some, [[int(v) for v in (q.as_py() if q.is_valid else w.as_py())] for q, w in both], False


def moved(old: Table, new: Table) -> np.ndarray:
    """Upper bounds of how far each centre went."""
    squares = [min(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), 1 << 1000) for x, y in zip(old, new, strict=True)]
    return np.array([up(up(np.sqrt(float(s)))) if s else 0.0 for s in squares])


class Sums:
    """Members and component sums of each slot, of any size, within one task."""

    def __init__(self) -> None:
        self.plain: dict[int, list] = {}
        self.wide: dict[int, list] = {}

    def add(self, slots: np.ndarray, x: np.ndarray) -> None:
        if not len(slots):
            return
        order = np.argsort(slots, kind="stable")
        slots, starts = np.unique(slots[order], return_index=True)
        counts = np.diff([*starts, len(order)])
        for slot, n, total in zip(slots.tolist(), counts.tolist(), np.add.reduceat(x[order].astype("i8"), starts), strict=True):
            held = self.plain.setdefault(slot, [0, 0])
            held[0] += n
            held[1] = held[1] + total

    def add_wide(self, slot: int, x: Sequence[int]) -> None:
        n, total = self.wide.get(slot, [0, [0] * len(x)])
        self.wide[slot] = [n + 1, [a + b for a, b in zip(total, x, strict=True)]]

    def rows(self) -> Iterator[tuple[int, int, int, list[int]]]:
        for slot in {*self.plain, *self.wide}:
            (n, total), (m, more) = self.plain.get(slot, (0, 0)), self.wide.get(slot, (0, None))
            left = [int(v) for v in total] if n else [0] * len(more)
            left, n, piece = [a + b for a, b in zip(left, more or [0] * len(left), strict=True)], n + m, 0
            while any(abs(v) >> PIECE for v in left):
                yield slot, 0, piece, [v & ((1 << PIECE) - 1) for v in left]
                left, piece = [v >> PIECE for v in left], piece + 1
            yield slot, n, piece, left

    def batch(self, states: pa.Schema, notes: dict[int, int]) -> pa.RecordBatch:
        """The sums, and notes (numbers below 0 with a value), as rows beside the states, which are null there."""
        rows = [*self.rows(), *((k, v, 0, None) for k, v in notes.items())]
        columns = [pa.nulls(len(rows), f.type) for f in states]
        columns += [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays(columns, [*states.names, "slot", "members", "piece", "sums"])


def with_states(columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    n = len(columns[0])
    empty = [pa.nulls(n, kind) for kind in (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*columns, *empty], [*names, "slot", "members", "piece", "sums"])


def totals(passed: DataFrame, dim: int) -> tuple[dict[int, tuple[int, list[int]]], dict[int, tuple[int, int]]]:
    """Of a pass: members and sums of each slot, and of each note its largest value and its sum.

    The tasks' rows are summed up by slot and component; as many rows come to the driver.
    """
    own = passed.where(F.col("slot").isNotNull()).select("slot", "piece", "members", F.posexplode_outer("sums").alias("i", "s"))
    sums: dict[int, tuple[int, list[int]]] = {}
    notes: dict[int, tuple[int, int]] = {}
    found = own.groupBy("slot", "piece", "i").agg(F.sum("members").alias("n"), F.max("members").alias("most"), F.sum("s").alias("s"))
    for r in found.collect():
        if r.slot < 0:
            notes[r.slot] = (r.most, r.n)
            continue
        n, total = sums.setdefault(r.slot, (0, [0] * dim))
        total[r.i] += r.s << (PIECE * r.piece)
        if not r.i and r.n:
            sums[r.slot] = (n + r.n, total)
    return sums, notes


def means(centres: Table, sums: dict[int, tuple[int, list[int]]], first: int = 0) -> Table:
    """Each centre's members' mean, rounded down in every component; a centre without members stays."""
    return [[v // sums[first + j][0] for v in sums[first + j][1]] if sums.get(first + j, (0,))[0] else c for j, c in enumerate(centres)]


def capped(total: Column) -> Column:
    return F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long")
