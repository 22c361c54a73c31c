"""Codes of vectors: a codebook for each part, by Lloyd's iterations with Elkan's bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lloyd
from .common import discard, materialize, small

#: Pairs of a part and an entry whose distances are made at a time.
PAIRS = 200_000
#: Note of a pass: the exact distances it took.
_TAKEN = -1
_NAMES = ["row", "q", "wide", "codes", "upper", "lower"]
_STATE = "q array<int>, wide array<double>, codes array<int>, upper array<double>, lower binary"
_HALF_MOST = np.float32(65504)


class Codes(NamedTuple):
    """members: row (columns of the input), code (bytes, an index a part) and error (squared distances of the parts).

    taken: the exact distances of each pass.
    """

    members: DataFrame
    codebooks: list[lloyd.Table]
    taken: list[int]


def held(bounds: np.ndarray) -> np.ndarray:
    """Lower bounds as 16-bit floats, rounded down."""
    bounds = np.minimum(bounds.astype("f4"), _HALF_MOST)
    out = bounds.astype("f2")
    over = out > bounds
    out[over] = np.nextafter(out[over], np.float16(-np.inf))
    return out


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """code, upper and lower (a bound for each entry), from all distances."""
    d = lloyd.squared(x, book)
    code = d.argmin(1)  # ties: the lower index
    return code, lloyd.up(np.sqrt(d[np.arange(len(x)), code])), np.maximum(np.sqrt(d) * (1 - 1e-6), 0)


def follow(
    x: np.ndarray, book: np.ndarray, moves: np.ndarray, apart: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray
) -> int:
    """Bring the states of one part to moved entries, in place; gives the distances taken.

    The bounds move with their entries. An entry is passed over only where the upper bound is strictly under its lower
    bound, or strictly under half its distance from the own entry (apart, rounded down). Vectors with entries left take
    the exact distance to their own first; of entries that are then still left all distances are taken, as whole numbers.
    """
    upper[:] = lloyd.up(upper + moves[code])
    lower[:] = np.maximum(lower * np.float32(1 - 1e-6) - np.minimum(moves, 1e30).astype("f4")[None, :] * np.float32(1 + 1e-6), 0)
    rows = np.flatnonzero(upper >= apart.min(1)[code])

    def left() -> np.ndarray:
        return (upper[rows, None] >= np.maximum(lower[rows], apart[code[rows]])) & (np.arange(len(book)) != code[rows, None])

    rows = rows[left().any(1)]
    if not len(rows):
        return 0
    gap = x[rows] - book[code[rows]]
    best = np.full((len(rows), len(book)), np.inf)
    own = np.einsum("ij,ij->i", gap, gap)
    best[np.arange(len(rows)), code[rows]] = own
    upper[rows] = lloyd.up(np.sqrt(own))
    i, j = np.nonzero(left())
    for low in range(0, len(i), PAIRS):
        a, b = i[low : low + PAIRS], j[low : low + PAIRS]
        gap = x[rows[a]] - book[b]
        best[a, b] = d = np.einsum("ij,ij->i", gap, gap)
        lower[rows[a], b] = np.sqrt(d) * (1 - 1e-6)
    lower[rows, code[rows]] = np.sqrt(own) * (1 - 1e-6)
    code[rows] = best.argmin(1)  # whole numbers: ties go to the lower index
    upper[rows] = lloyd.up(np.sqrt(best[np.arange(len(rows)), code[rows]]))
    return len(rows) + len(i)


def halves(book: np.ndarray) -> np.ndarray:
    """Half the distance of each two entries, rounded down; of an entry from itself infinite."""
    d = np.maximum(lloyd.down(np.sqrt(lloyd.squared(book, book)) / 2), 0)
    np.fill_diagonal(d, np.inf)
    return d


def assign(table: DataFrame, books: list[lloyd.Table], moves: list[np.ndarray] | None) -> DataFrame:
    """One pass: each vector's codes and bounds for these codebooks, and the sums of each task; slot part * entries + entry."""
    parts, k = len(books), len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, taken, states, apart = lloyd.Sums(), 0, None, None
        for batch in batches:
            for some, x, plain in lloyd.parted(batch, 1, books):
                n = some.num_rows
                code, upper, lower = np.zeros((parts, n), int), np.full((parts, n), np.inf), np.zeros((parts, n, k), "f4")
                width = len(x[0]) // parts
                if not plain:  # all distances, and no bounds
                    for r, row in enumerate(x):
                        for p in range(parts):
                            code[p, r] = lloyd.nearest(own := row[p * width : (p + 1) * width], books[p])[1]
                            sums.add_wide(p * k + int(code[p, r]), own)
                    taken += n * k * parts
                else:
                    tables = [np.array(t, "f8") for t in books]
                    if moves is not None:
                        apart = apart or [halves(t) for t in tables]
                        code[:], upper[:] = lloyd.matrix(some.column(3), "i8", n).T, lloyd.matrix(some.column(4), "f8", n).T
                        stored = np.frombuffer(b"".join(some.column(5).to_pylist()), "f2")
                        lower[:] = stored.reshape(n, parts, k).transpose(1, 0, 2)
                    for p in range(parts):
                        own = x[:, p * width : (p + 1) * width]
                        if moves is None:
                            code[p], upper[p], lower[p] = scan(own, tables[p])
                            taken += n * k
                        else:
                            taken += follow(own, tables[p], moves[p], apart[p], code[p], upper[p], lower[p])
                        sums.add(p * k + code[p], own)
                bytes_ = [b.tobytes() for b in held(lower.transpose(1, 0, 2))]
                columns = [*some.columns[:3], lloyd.lists(code.T, pa.int32()), lloyd.lists(upper.T, pa.float64()), pa.array(bytes_, pa.binary())]
                out = lloyd.with_states(columns, _NAMES)
                states = pa.schema(list(out.schema)[: len(_NAMES)])
                yield out
        if states is not None:
            yield sums.batch(states, {_TAKEN: taken})

    return table.mapInArrow(run, lloyd.schema(table, ["row"], f"{_STATE}, {lloyd.SUMS}"))


def coded(states: DataFrame, books: list[lloyd.Table]) -> DataFrame:
    """row, code (bytes) and the exact error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x, plain in lloyd.parted(batch, 1, books):
                code = lloyd.matrix(some.column(3), "i8", some.num_rows)
                if plain:
                    gap = x - np.hstack([np.array(t, "f8")[code[:, p]] for p, t in enumerate(books)])
                    error = np.einsum("ij,ij->i", gap, gap).astype("i8").tolist()
                else:
                    entries = [[v for p, c in enumerate(own) for v in books[p][c]] for own in code]
                    error = [min(sum((a - b) ** 2 for a, b in zip(*both, strict=True)), lloyd.MOST) for both in zip(x, entries, strict=True)]
                text = pa.array([c.tobytes() for c in code.astype("u1")], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), text, pa.array(error, pa.int64())], ["row", "code", "error"])

    return states.select("row", "q", "wide", "codes").mapInArrow(run, lloyd.schema(states, ["row"], "code binary, error long"))


def encode(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, dim: int = 64,
    keep: list[str] | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
) -> Codes:
    """A byte for each of the vector's equal consecutive parts: the nearest entry of that part's codebook.

    Components become floor(scale * x). A codebook starts as that part of the vectors with the smallest ids, ascending
    (of equal ids those with smaller components first). Each round assigns every part to its nearest entry (squared
    distance, ties to the lower index), then puts each used entry at its parts' mean, rounded down; at the end parts are
    assigned again. A row carries for each part an upper bound of the distance to its entry and a lower bound for every
    entry, as 16-bit floats rounded down; bounds only rule out what they put strictly farther, all else is decided by whole
    numbers. The states of a pass are written to the shared folder beside the sums of its tasks, and the ones before go.
    The driver sees parts x entries rows of sums. No more rounds follow one in which no entry moves.

    keep: the columns of the input to carry in row (all but the vector, if None). Left out: null vectors, those of another
    length than dim, and those with components that are null or not finite after scaling. Null ids come after all others.
    Rows that repeat are rows of their own. Fewer vectors than entries: as many entries; none, an empty table: no rows.
    Errors over a long are given as its largest value. Clashing columns stay apart, inside row. Vectors beyond what
    floats hold exactly are compared in whole numbers with all entries. entries: 256 at most; dim is a multiple of parts.
    """
    if entries > 256 or dim % parts:
        raise ValueError("at most 256 entries, and a dim that is a multiple of parts")
    names = [c for c in vectors.columns if c != vector_col] if keep is None else keep
    usable = vectors.where(lloyd.usable(F.col(vector_col), dim, scale))
    usable = usable.select(F.struct(*names).alias("row"), F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))
    table = materialize(lloyd.whole(usable, scale, ["_id", "row"], "_v"), "vectors")
    first = table.select("_id", "q", "wide").orderBy(F.asc_nulls_last("_id"), "q", "wide").limit(entries).collect()
    start = [[int(v) for v in (r.q if r.q is not None else r.wide)] for r in first]
    table = table.select("row", "q", "wide")
    if not start:
        return Codes(table.selectExpr("row", "cast(null AS binary) AS code", "cast(null AS long) AS error"), [[] for _ in range(parts)], [])
    width = dim // parts
    books = [[x[p * width : (p + 1) * width] for x in start] for p in range(parts)]
    moves, taken = None, []
    for i in range(rounds + 1):
        passed = materialize(assign(table, books, moves), "coded")
        discard(table)
        table = passed.where(F.col("slot").isNull()).select(*_NAMES)
        sums, notes = lloyd.totals(passed, width)
        taken.append(notes[_TAKEN][1])
        if i == rounds:
            break
        new = [lloyd.means(t, sums, p * len(t)) for p, t in enumerate(books)]
        if new == books:
            break
        moves, books = [lloyd.moved(a, b) for a, b in zip(books, new, strict=True)], new
    return Codes(coded(table, books), books, taken)


def report(done: Codes, label: str = "label") -> DataFrame:
    """row, code (two hex digits a part), error, label_error (errors summed over rows of an equal label, nulls together) and codebooks_sha256.

    Labels are summed before they are shuffled; few of them are broadcast, by a count, more are joined by a shuffle that
    adaptive execution splits.
    """
    sha = hashlib.sha256(",".join(str(v) for t in done.codebooks for c in t for v in c).encode()).hexdigest()
    members = materialize(done.members, "members").withColumn("_l", F.struct(F.col("row")[label].alias("l")))
    errors = members.groupBy("_l").agg(lloyd.capped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    joined = members.join(small(errors), "_l")
    return joined.select("row", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
