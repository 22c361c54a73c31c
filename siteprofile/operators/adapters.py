"""Adapters at the start of reads, found by alignment with errors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Letters of a text that are aligned at a time; long texts are cut, with an overlap that no match is longer than.
WINDOW = 1024
#: Texts, or pieces of them, that are aligned at a time.
ROWS = 2048


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' code points one after another, where each text starts in them, and its length."""
    length = np.array([len(t) for t in texts], "i8")
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "u4"), np.cumsum(length) - length, length


def _sweep(texts: Sequence[str], adapter: str, anchored: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Before the first and after each letter of the texts, which come in the order of their lengths: the first text that has the letter, and
    the fewest edits of each prefix of the adapter (a row) against a part of each text (a column) that ends there, if anchored the text so far.

    Texts that have ended keep the edits of their last letter.
    """
    codes, start, length = _codes(texts)
    own = _codes([adapter])[0][:, None]
    d = np.repeat(np.arange(len(own) + 1, dtype="i4")[:, None], len(texts), axis=1)
    yield 0, d
    for j in range(length[-1]):
        first = int(np.searchsorted(length, j, "right"))
        above = d[:, first:]
        edits = above + 1
        if not anchored:
            edits[0] = 0
        np.minimum(edits[1:], above[:-1] + (codes[start[first:] + j] != own), out=edits[1:])
        for i in range(1, len(edits)):
            np.minimum(edits[i], edits[i - 1] + 1, out=edits[i])
        d[:, first:] = edits
        yield first, d


def _first_end(texts: Sequence[str], suffix: str) -> list[int]:
    """The fewest letters of each text that the suffix aligns to with the fewest edits; texts come in the order of their lengths."""
    k = len(suffix)
    best, end = np.full(len(texts), k + 1), np.zeros(len(texts), "i8")
    for j, (first, d) in enumerate(_sweep(texts, suffix, anchored=True)):
        _keep_better(best[first:], end[first:], d[k, first:], j)
    return end.tolist()


def _keep_better(best: np.ndarray, end: np.ndarray, edits: np.ndarray, j: int) -> None:
    """Where edits are fewer than best, they are the best, and the match ends after j letters."""
    end[edits < best] = j
    np.minimum(best, edits, out=best)


def match_ends(texts: Sequence[str], adapter: str, rate: float = 0.1, least: int = 9) -> list[int]:
    """Where the adapter's match in each text ends, or -1.

    A match is the whole adapter anywhere in the text, or a suffix of at least least letters at its start; edits are
    replaced, left out and added letters, at most rate times the letters of the adapter that are aligned. A whole one comes
    before a suffix, a longer suffix before a shorter one, fewer edits before more, and then the match that ends first.
    """
    m, most = len(adapter), int(rate * len(adapter))
    overlap = m + most
    pieces = [(r, low, t[low : low + WINDOW + overlap]) for r, t in enumerate(texts) for low in range(0, max(len(t), 1), WINDOW)]
    pieces.sort(key=lambda p: len(p[2]))
    found: list[tuple[int, int] | None] = [None] * len(texts)
    for begin in range(0, len(pieces), ROWS):
        some = pieces[begin : begin + ROWS]
        best, end = np.full(len(some), most + 1), np.full(len(some), -1)
        for j, (first, d) in enumerate(_sweep([p[2] for p in some], adapter)):
            if j:
                _keep_better(best[first:], end[first:], d[m, first:], j)
        for p in np.flatnonzero(end >= 0).tolist():
            r, low, _ = some[p]
            match = (int(best[p]), low + int(end[p]))
            if found[r] is None or match < found[r]:
                found[r] = match
    out = [-1 if f is None else f[1] for f in found]
    rest = sorted((r for r, f in enumerate(found) if f is None), key=lambda r: len(texts[r])) if m > least else []
    for begin in range(0, len(rest), ROWS):
        some = rest[begin : begin + ROWS]
        heads = [texts[r][:overlap] for r in some]
        d = None
        for _, d in _sweep([h[::-1] for h in heads], adapter[::-1]):  # noqa: B007  backwards, a suffix ends where the text starts
            pass
        longest = np.full(len(some), -1)
        for k in range(least, m):
            longest[d[k] <= int(rate * k)] = k
        for k in np.unique(longest[longest >= 0]).tolist():
            at = np.flatnonzero(longest == k).tolist()
            for p, e in zip(at, _first_end([heads[p] for p in at], adapter[m - k :]), strict=True):
                out[some[p]] = e
    return out


def trimmed(reads: DataFrame, adapter: str, columns: Sequence[str] = ("seq1", "seq2"), rate: float = 0.1, least: int = 9, times: int = 5) -> DataFrame:
    """reads with, for each column, rounds_<column> and trimmed_<column>: how often a match was cut off, times at most, and what is left behind the last.

    Whole texts are aligned, of any length, in batches over windows. Null texts have 0 rounds and stay null.
    """
    kinds = StructType([*reads.schema, *StructType.fromDDL(", ".join(f"rounds_{c} int, trimmed_{c} string" for c in columns))])
    at = [reads.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = []
            for i in at:
                texts = batch.column(i).to_pylist()
                rounds, open_ = [0] * len(texts), [r for r, t in enumerate(texts) if t is not None]
                for _ in range(times):
                    ends = match_ends([texts[r] for r in open_], adapter, rate, least)
                    open_ = [r for r, e in zip(open_, ends, strict=True) if e >= 0]
                    for r, e in zip(open_, (e for e in ends if e >= 0), strict=True):
                        texts[r], rounds[r] = texts[r][e:], rounds[r] + 1
                    if not open_:
                        break
                more += [pa.array(rounds, pa.int32()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], kinds.names)

    return reads.mapInArrow(run, kinds)


def dealt(reads: DataFrame) -> DataFrame:
    """The rows dealt out by all their columns, as few splits of a file may hold most of them and aligning costs far more than a shuffle.

    There are as many partitions as cores; adaptive execution joins small ones and splits those beyond its advisory size. The rows
    of a frequent text or key go to different tasks; only rows equal in every column meet.
    """
    return reads.hint("rebalance", reads.sparkSession.sparkContext.defaultParallelism, *[F.col(f"`{c}`") for c in reads.columns])


def without_adapter(reads: DataFrame, adapter: str, columns: Sequence[str] = ("seq1", "seq2"), rate: float = 0.1, least: int = 9) -> DataFrame:
    """The reads, or pairs, none of whose texts has a match; their order may change."""
    none = F.lit(True)
    for c in columns:
        none = none & (F.col(f"rounds_{c}") == 0)
    return trimmed(dealt(reads), adapter, columns, rate, least, 1).where(none).select(*reads.columns)
