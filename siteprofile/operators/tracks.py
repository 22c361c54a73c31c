"""Sites and regions counted along chunks of the genome: contexts, k-mers and profiles of what regions cover, without a row for each pair of a site and a region.

Equal sites, and equal ends of regions, are counted first. So a chunk holds at most a number for each base, strand and label, however
many sites and regions lie there, and a task counts a batch of chunks at once. Regions of any length are cut at the chunks' ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import arrays
from .contexts import CHUNK, HELD, _labels, chunked
from .profiles import DIGIT, LETTERS, signature_tables

#: Bases of chunks, and pairs of a site and a window, that are looked at together.
BYTES, PAIRS = 1 << 19, 1 << 21


def _chunk(position: Column) -> Column:
    """The number of the chunk of a position (from 1)."""
    return F.floor((position - 1) / CHUNK).cast("int")


def _site_rows(sites: DataFrame, reach: int = 0) -> DataFrame:
    """(chrom, chunk, _sites): the sites (chrom, pos, strand) in each chunk and up to reach bases behind it: place in the chunk (from 1), strand and number."""
    minus = F.coalesce(F.col("strand") == "-", F.lit(False)).alias("minus")
    counts = sites.where("chrom IS NOT NULL AND pos IS NOT NULL").groupBy("chrom", F.col("pos").cast("long").alias("pos"), minus).agg(F.count(F.lit(1)).alias("n"))
    own = F.explode(F.sequence(_chunk(F.col("pos") - reach), _chunk(F.col("pos")))) if reach else _chunk(F.col("pos"))
    placed = counts.withColumn("chunk", own)
    at = (F.col("pos") - F.col("chunk").cast("long") * CHUNK).cast("int").alias("at")
    return placed.groupBy("chrom", "chunk").agg(F.collect_list(F.struct(at, "minus", "n")).alias("_sites"))


def _cover_rows(regions: DataFrame, first: Column, end: Column, by: list[str]) -> DataFrame:
    """(chrom, chunk, _cover): by label, places in the chunk where regions from first to end (from 1, exclusive) begin or end there, and how many more do the one than the other."""
    cut = regions.where("chrom IS NOT NULL").select("chrom", *by, first.cast("long").alias("_from"), end.cast("long").alias("_to")).where("_from < _to")
    cut = cut.withColumn("chunk", F.explode(F.sequence(_chunk(F.col("_from")), _chunk(F.col("_to") - 1))))
    before = F.col("chunk").cast("long") * CHUNK
    begin = F.struct(F.greatest(F.col("_from") - before, F.lit(1)).cast("int").alias("at"), F.lit(1).cast("long").alias("d"))
    stop = F.struct((F.col("_to") - before).cast("int").alias("at"), F.lit(-1).cast("long").alias("d"))
    ends = cut.select("chrom", "chunk", *by, F.explode(F.when(F.col("_to") - before <= CHUNK, F.array(begin, stop)).otherwise(F.array(begin))).alias("_e"))
    counts = ends.groupBy("chrom", "chunk", *by, F.col("_e.at").alias("at")).agg(F.sum("_e.d").alias("d")).where("d <> 0")
    return counts.groupBy("chrom", "chunk").agg(F.collect_list(F.struct(*by, "at", "d")).alias("_cover"))


def _window_rows(windows: DataFrame, start: Column) -> DataFrame:
    """(chrom, chunk, _windows): the windows by the chunk of their start: its place there (from 1) and how many have it."""
    counts = windows.where("chrom IS NOT NULL").groupBy("chrom", start.cast("long").alias("start")).agg(F.count(F.lit(1)).alias("n")).where("start IS NOT NULL")
    placed = counts.withColumn("chunk", _chunk(F.col("start")))
    at = (F.col("start") - F.col("chunk").cast("long") * CHUNK).cast("int").alias("at")
    return placed.groupBy("chrom", "chunk").agg(F.collect_list(F.struct(at, "n")).alias("_windows"))


def _parts(genome: DataFrame, halo: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The genome's chunks with halo more bases on both sides: chrom, chunk, _part, and in it the place of the chunk's first base, from 0."""
    parts = chunked(genome, CHUNK, halo, True, keep)
    return parts.select("chrom", "chunk", *keep, F.col("part").alias("_part"), (F.col("chunk").cast("long") * CHUNK + 1 - F.col("first")).cast("int").alias("_origin"))


class _Held:
    """Counts by key that a task holds until there are many."""

    def __init__(self, kinds: StructType, types: list[pa.DataType]):
        self.names, self.types, self.counts = kinds.names, types, {}

    def add(self, values: list[tuple], found: tuple[np.ndarray, list[str], np.ndarray]) -> None:
        for label, kmer, n in zip(*found, strict=True):
            key = (*values[label], kmer)
            self.counts[key] = self.counts.get(key, 0) + int(n)

    def told(self) -> pa.RecordBatch:
        columns = zip(*((*key, n) for key, n in self.counts.items()), strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*self.types, pa.string(), pa.int64()], strict=True)], self.names)
        self.counts = {}
        return batch


def _slices(batch: pa.RecordBatch, column: int | None) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about BYTES of a column of sequences, or CHUNK a row."""
    sizes = np.full(batch.num_rows, CHUNK) if column is None else np.diff(arrays.letters(batch.column(column))[1])
    step = (np.cumsum(sizes) - sizes) // BYTES
    for low, n in zip(*np.unique(step, return_index=True, return_counts=True)[1:], strict=True):
        yield batch.slice(int(low), int(n))


def _listed(column: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """The row of each element of a column of arrays of structs, and the elements' fields."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().flatten()


def _covered(row: np.ndarray, label: np.ndarray, n_labels: int, at: np.ndarray, d: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, labels, where each begins, counts): for each row and label that has regions, how many cover each of the row's places, and a cell of 0 behind them."""
    segments, own = np.unique(row * n_labels + label, return_inverse=True)
    rows, labels = segments // n_labels, segments % n_labels
    length = size[rows] + 1
    begin = np.cumsum(length) - length
    last = begin + length - 1
    change = np.bincount(np.minimum(begin[own] + at - 1, last[own]), d, int(length.sum()))
    change[last] -= np.add.reduceat(change, begin)
    return rows, labels, begin, np.cumsum(change)


def _of_chunks(rows: DataFrame, by: list[str], listed: str | None, run: Callable[[pa.RecordBatch, _Held], None], labels: StructType) -> DataFrame:
    """(by..., context, n): what run counts in slices of the rows' chunks, added up."""
    kinds = StructType([*labels, StructField("context", StringType()), StructField("n", LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is None:
                types = [batch.schema.field(c).type for c in by] if listed is None else [batch.schema.field(listed).type.value_type.field(c).type for c in by]
                held = _Held(kinds, types)
            for some in _slices(batch, 0):
                run(some, held)
                if len(held.counts) > HELD:
                    yield held.told()
        if held is not None and held.counts:
            yield held.told()

    return rows.mapInArrow(task, kinds).groupBy(*by, "context").agg(F.sum("n").alias("n"))


def _readable(data: np.ndarray, at: np.ndarray, row: np.ndarray, middle: np.ndarray, minus: np.ndarray, k: int) -> np.ndarray:
    """Whether the k bases around each middle are in its row's part and, on the minus strand, all of ACGT."""
    first = middle - k // 2
    good = (first >= at[row]) & (first + k <= at[row + 1])
    other = np.concatenate([[0], np.cumsum(~arrays.IS_BASE[data])])
    back = good & minus
    good[back] = other[first[back] + k] == other[first[back]]
    return good


def contexts_of(sites: DataFrame, genome: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """(by..., context, n): the contexts of k bases of the sites (chrom, pos, strand), as annotate() reads them, by columns of the genome. Sites without a context are left out."""
    keys = by or []
    rows = _parts(genome, k, tuple(keys)).join(_site_rows(sites), ["chrom", "chunk"]).select("_part", "_origin", "_sites", *keys)

    def run(batch: pa.RecordBatch, held: _Held) -> None:
        data, at = arrays.letters(batch.column(0))
        row, (place, minus, n) = _listed(batch.column(2))
        label, values = _labels(batch.select(keys), len(keys)) if keys else (np.zeros(batch.num_rows, "i8"), [()])
        minus = minus.to_numpy(zero_copy_only=False)
        middle = at[row] + batch.column(1).to_numpy()[row] + place.to_numpy() - 1
        good = _readable(data, at, row, middle, minus, k)
        held.add(values, arrays.tally(data, middle[good] - k // 2, k, label[row[good]], n.to_numpy()[good], minus[good]))

    return _of_chunks(rows, keys, None, run, rows.select(*keys).schema)


def contexts_in(sites: DataFrame, regions: DataFrame, genome: DataFrame, k: int, by: list[str]) -> DataFrame:
    """(by..., context, n): the contexts of the sites in regions (chrom, start, end, by...), each once for every region that it lies in. Sites without a context are left out."""
    covers = _cover_rows(regions, F.col("start") + 1, F.col("end") + 1, by)
    rows = _parts(genome, k).join(covers, ["chrom", "chunk"]).join(_site_rows(sites), ["chrom", "chunk"]).select("_part", "_origin", "_sites", "_cover")

    def run(batch: pa.RecordBatch, held: _Held) -> None:
        data, at = arrays.letters(batch.column(0))
        origin = batch.column(1).to_numpy()
        row, (place, minus, n) = _listed(batch.column(2))
        minus, place = minus.to_numpy(zero_copy_only=False), place.to_numpy()
        middle = at[row] + origin[row] + place - 1
        good = _readable(data, at, row, middle, minus, k)
        row, place, minus, n, middle = row[good], place[good], minus[good], n.to_numpy()[good], middle[good]
        own, (*columns, places, d) = _listed(batch.column(3))
        label, values = _labels(pa.RecordBatch.from_arrays(columns, by), len(by))
        size = np.diff(at) - origin
        rows_, labels, begin, counts = _covered(own, label, len(values), places.to_numpy(), d.to_numpy(), size)
        # Each site meets the labels of its row: those of a row stand together, as rows are in order.
        low, high = np.searchsorted(rows_, row), np.searchsorted(rows_, row, "right")
        site = np.repeat(np.arange(len(row)), high - low)
        segment = np.arange(len(site)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[site]
        weight = counts[begin[segment] + place[site] - 1] * n[site]
        met = weight > 0
        site = site[met]
        held.add(values, arrays.tally(data, middle[site] - k // 2, k, labels[segment[met]], weight[met], minus[site]))

    return _of_chunks(rows, by, "_cover", run, regions.select(*by).schema)


def kmers_in(regions: DataFrame, genome: DataFrame, pos: Column, length: Column, k: int, by: list[str] | None = None) -> DataFrame:
    """(by..., kmer, n): kmer_counts() of the length bases from pos of each region, as with_sequence() reads them, without a row for each of these."""
    keys = by or []
    whole = regions.where(pos >= 1)
    rows = _parts(genome, k).join(_cover_rows(whole, pos, pos + length - (k - 1), keys), ["chrom", "chunk"]).select("_part", "_origin", "_cover")

    def run(batch: pa.RecordBatch, held: _Held) -> None:
        data, at = arrays.letters(batch.column(0))
        origin = batch.column(1).to_numpy()
        own, (*columns, places, d) = _listed(batch.column(2))
        label, values = _labels(pa.RecordBatch.from_arrays(columns, keys), len(keys)) if keys else (np.zeros(len(own), "i8"), [()])
        # Of the halo behind a chunk no k-mer starts in it.
        size = np.minimum(np.diff(at) - origin, CHUNK)
        rows_, labels, begin, counts = _covered(own, label, len(values), places.to_numpy(), d.to_numpy(), size)
        quick = arrays.covered_kmers(data, at, k, labels, at[rows_] + origin[rows_], begin, counts) if len(labels) else None
        if quick is not None:
            held.add(values, quick)
            return
        cell = np.flatnonzero(counts)
        segment = np.searchsorted(begin, cell, "right") - 1
        r = rows_[segment]
        first = at[r] + origin[r] + cell - begin[segment]
        inside = first + k <= at[r + 1]
        held.add(values, arrays.tally(data, first[inside], k, labels[segment[inside]], counts[cell[inside]]))

    return _of_chunks(rows, keys, "_cover", run, regions.select(*keys).schema).withColumnRenamed("context", "kmer")


def _blocks(many: np.ndarray) -> Iterator[slice]:
    """Slices of rows that make about PAIRS pairs each."""
    step = (np.cumsum(many) - many) // PAIRS
    for low, n in zip(*np.unique(step, return_index=True, return_counts=True)[1:], strict=True):
        yield slice(int(low), int(low + n))


class _Meeting:
    """The sites of a slice of chunks in order, and of each window those that it holds."""

    def __init__(self, sites: pa.Array, windows: pa.Array, width: int):
        row, (place, minus, n) = _listed(sites)
        self.wide = CHUNK + width + 2
        key = row * self.wide + place.to_numpy()
        order = np.argsort(key, kind="stable")
        self.key, self.minus, self.n = key[order], minus.to_numpy(zero_copy_only=False)[order], n.to_numpy()[order]
        self.row, (at, count) = _listed(windows)
        self.at, self.count = at.to_numpy(), count.to_numpy()
        start = self.row * self.wide + self.at
        self.low, self.high = np.searchsorted(self.key, start, "right"), np.searchsorted(self.key, start + width, "right")
        self.start = start

    def keep(self, data: np.ndarray, at: np.ndarray, origin: np.ndarray, base: str) -> None:
        """Only the sites at a base count from here on."""
        row = self.key // self.wide
        middle = at[row] + origin[row] + self.key % self.wide - 1
        good = _readable(data, at, row, middle, self.minus, 1)
        letter = data[middle[good]]
        good[good] = np.where(self.minus[good], arrays.COMPLEMENT[letter], letter) == ord(base)
        self.n = np.where(good, self.n, 0)

    def observed(self, width: int, mirror: bool) -> np.ndarray:
        """Pairs by the site's distance from the window's start, from 1; mirror: on the minus strand from behind."""
        total, many = np.zeros(width + 1, "i8"), self.high - self.low
        for some in _blocks(many):
            m = many[some]
            window = np.repeat(np.arange(some.start, some.stop), m)
            site = np.arange(len(window)) - np.repeat(np.cumsum(m) - m, m) + self.low[window]
            position = self.key[site] - self.start[window]
            if mirror:
                position = np.where(self.minus[site], width + 1 - position, position)
            total += np.bincount(position, self.count[window] * self.n[site].astype(float), width + 1).astype("i8")
        return total[1:]

    def on(self, minus: bool) -> np.ndarray:
        """Sites of a strand in each window."""
        before = np.concatenate([[0], np.cumsum(np.where(self.minus == minus, self.n, 0))])
        return before[self.high] - before[self.low]


def observed_in(sites: DataFrame, windows: DataFrame, width: int, genome: DataFrame | None = None, base: str = "") -> DataFrame:
    """(position, observed): pairs of sites and windows [start, start + width) by pos - start, from 1. With a genome only the sites at a base, as read on the strand. Positions without a site have no row."""
    rows = _window_rows(windows, F.col("start")).join(_site_rows(sites, width), ["chrom", "chunk"])
    by_base = genome is not None
    rows = rows.join(_parts(genome, width), ["chrom", "chunk"]).select("_windows", "_sites", "_part", "_origin") if by_base else rows.select("_windows", "_sites")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, "i8")
        for batch in batches:
            for some in _slices(batch, 2 if by_base else None):
                meeting = _Meeting(some.column(1), some.column(0), width)
                if by_base:
                    meeting.keep(*arrays.letters(some.column(2)), some.column(3).to_numpy(), base)
                total += meeting.observed(width, False)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found + 1), pa.array(total[found])], ["position", "observed"])

    return rows.mapInArrow(task, "position long, observed long").groupBy("position").agg(F.sum("observed").alias("observed"))


def composition_in(windows: DataFrame, genome: DataFrame, width: int) -> DataFrame:
    """(offset, kmer, n): composition() of the window_sequences() of windows, of width bases from start."""
    rows = _parts(genome, width).join(_window_rows(windows.where("start >= 1"), F.col("start")), ["chrom", "chunk"]).select("_part", "_origin", "_windows")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, 256))
        for batch in batches:
            for some in _slices(batch, 0):
                data, at = arrays.letters(some.column(0))
                row, (place, n) = _listed(some.column(2))
                first = at[row] + some.column(1).to_numpy()[row] + place.to_numpy() - 1
                whole = first + width <= at[row + 1]
                first, n = first[whole], n.to_numpy()[whole].astype(float)
                for j in range(width if len(first) else 0):
                    total[j] += np.bincount(data[j:].take(first), n, 256)
        offset, letter = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(offset), pa.array([chr(x) for x in letter], pa.string()), pa.array(total[offset, letter].astype("i8"))], ["offset", "kmer", "n"])

    return rows.mapInArrow(task, "offset long, kmer string, n long").groupBy("offset", "kmer").agg(F.sum("n").alias("n"))


def profile_in(sites: DataFrame, windows: DataFrame, genome: DataFrame, sig: DataFrame, width: int, k: int = 3, offset: int = 0, mirror_minus: bool = False) -> DataFrame:
    """(position, observed, expected) of the sites in windows [start, start + width), as observed() counts them and expected_of() spreads them.

    Windows with the same start have the same probabilities, so they go together. Each window is its own: an id is not used.
    Positions without a site have no row.
    """
    tables = signature_tables(sig, k)
    before = k // 2 - offset
    halo = width + k + abs(offset)
    both = _window_rows(windows, F.col("start")).join(_site_rows(sites, width), ["chrom", "chunk"])
    rows = both.join(_parts(genome, halo), ["chrom", "chunk"], "left").select("_part", "_origin", "_windows", "_sites")
    base = len(LETTERS) + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, any_ = np.zeros(width, "i8"), np.zeros(width), False
        for batch in batches:
            for some in _slices(batch, 0):
                meeting = _Meeting(some.column(3), some.column(2), width)
                seen += meeting.observed(width, mirror_minus)
                data, at = arrays.letters(some.column(0))
                if len(data) < k:
                    continue
                code = np.zeros(len(data) - k + 1, "i8")
                for j in range(k):
                    code = code * base + DIGIT[data[j : j + len(code)]]
                row = meeting.row
                origin = some.column(1).fill_null(0).to_numpy()[row]
                first = at[row] + origin + meeting.at - 1 - before
                # A sequence that starts before the first base, or runs off the end, is left out.
                inside = (first >= at[row]) & (first + width + k - 1 <= at[row + 1]) & (meeting.at > 0)
                for minus in (False, True):
                    n = meeting.on(minus)
                    use = np.flatnonzero(inside & (n > 0))
                    if not len(use):
                        continue
                    p, starts = tables[int(minus)][code], first[use]
                    sums = np.zeros(len(use))
                    for j in range(width):
                        sums += p[j:].take(starts)
                    good = sums > 0
                    any_ = any_ or bool(good.any())
                    weight, starts = (n[use] * meeting.count[use])[good] / sums[good], starts[good]
                    for j in range(width if len(starts) else 0):
                        total[width - 1 - j if minus else j] += weight @ p[j:].take(starts)
        if seen.any():
            expected = pa.array(total) if any_ else pa.nulls(width, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, width + 1)), pa.array(seen), expected], ["position", "observed", "expected"])

    sums = rows.mapInArrow(task, "position long, observed long, expected double").groupBy("position")
    return sums.agg(F.sum("observed").alias("observed"), F.sum("expected").alias("expected")).where("observed > 0")
