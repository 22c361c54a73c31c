"""Sequences of an Arrow batch as one array of bytes, and k-mers counted in it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Counts held as one table, of so many cells at most; where there may be more k-mers, those that occur are sorted.
CELLS = 1 << 21
#: The byte on the other strand, and which bytes are bases.
COMPLEMENT = np.arange(256).astype("u1")
COMPLEMENT[[ord(x) for x in "ACGT"]] = [ord(x) for x in "TGCA"]
IS_BASE = np.zeros(256, bool)
IS_BASE[[ord(x) for x in "ACGT"]] = True


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings or binaries of a column behind each other, and where each starts and the last ends. Nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "i8", len(column) + 1, 8 * column.offset)
    whole = np.frombuffer(data, "u1") if data is not None and data.size else np.zeros(0, "u1")
    return whole[at[0] : at[-1]], at - at[0]


def starts(at: np.ndarray, k: int) -> np.ndarray:
    """Which bytes start a k-mer inside their sequence."""
    inside = np.ones(at[-1], bool)
    for j in range(1, k):
        inside[at[1:][at[1:] - j >= at[:-1]] - j] = False
    return inside


def kmer_table(column: pa.Array, k: int, label: np.ndarray | None = None) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(labels, k-mers, counts) of what occurs in the sequences, each with the label of its row; without labels, with its offset in the sequence."""
    data, at = letters(column)
    sizes = np.diff(at)
    here = np.flatnonzero(starts(at, k))
    own = np.arange(at[-1]) - np.repeat(at[:-1], sizes) if label is None else np.repeat(label.astype("i8"), sizes)
    return tally(data, here, k, own[here])


def covered_kmers(data: np.ndarray, at: np.ndarray, k: int, own: np.ndarray, first: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray] | None:
    """tally() of runs of k-mers: that of number i has the label own[i], starts at first[i] and has the weights counts[begin[i]] and on, which end where the next begin. K-mers over the ends in at have none. None where a table of all k-mers would be large."""
    present = np.flatnonzero(np.bincount(data, minlength=256))
    base, n_labels = len(present), int(own.max()) + 1
    most = base**k
    if (most + 1) * n_labels > CELLS:
        return None
    digit = np.zeros(256, "i4")
    digit[present] = np.arange(base)
    d = digit[data]
    code = np.zeros(len(d), "i4")
    for j in range(k):
        code *= base
        code[: len(d) - j] += d[j:]
    code[~starts(at, k)] = most
    code = np.append(code, np.int32(most))
    length = np.diff(np.append(begin, len(counts)))
    where = np.arange(len(counts)) + np.repeat(first - begin, length)
    cell = code.take(where, mode="clip") + np.repeat(own * (most + 1), length)
    n = np.bincount(cell, counts, (most + 1) * n_labels).reshape(n_labels, most + 1)[:, :most]
    label, found = np.nonzero(n)
    text = present[found[:, None] // base ** np.arange(k - 1, -1, -1) % base].astype("u1")
    return label, np.ascontiguousarray(text).view(f"S{k}").ravel().astype(str).tolist(), n[label, found].astype("i8")


def tally(data: np.ndarray, here: np.ndarray, k: int, own: np.ndarray, weight: np.ndarray | None = None, minus: np.ndarray | None = None) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(labels, k-mers, counts) of the k-mers of data that start at here, each with its label and weight (whole, 1 if none is given); where minus, as their reverse complement."""
    if not len(here):
        return np.zeros(0, "i8"), [], np.zeros(0, "i8")
    seen = np.bincount(data, minlength=256) > 0
    if minus is not None:
        seen |= seen[COMPLEMENT]
    present = np.flatnonzero(seen)
    digit = np.zeros(256, "i8")
    digit[present] = np.arange(len(present))
    base, most, n_labels = len(present), 1, int(own.max()) + 1
    d, other = digit[data], digit[COMPLEMENT[data]] if minus is not None else None
    code = np.zeros(len(here), "i8")
    for j in range(k):
        if most * base * n_labels >= 1 << 62:  # the beginnings that occur, by number
            code, most = np.unique(code, return_inverse=True)[1], len(code)
        x = d[here + j]
        if minus is not None:
            x = np.where(minus, other[here + (k - 1 - j)], x)
        code, most = code * base + x, most * base
    code += own * most
    if most * n_labels <= CELLS:
        n = np.bincount(code, weight, most * n_labels)
        found = np.flatnonzero(n)
        digits = found[:, None] % most // base ** np.arange(k - 1, -1, -1) % base
        text = present[digits].astype("u1")
        labels, counts = found // most, n[found]
    else:
        found, first, number = np.unique(code, return_index=True, return_inverse=True)
        counts = np.bincount(number, weight)
        text = data[here[first][:, None] + np.arange(k)]
        if minus is not None:
            text = np.where(minus[first][:, None], COMPLEMENT[text[:, ::-1]], text)
        labels = own[first]
    names = np.ascontiguousarray(text).view(f"S{k}").ravel().astype(str).tolist()
    return labels, names, counts.astype("i8")
