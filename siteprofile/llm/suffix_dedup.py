"""Removal of repeated substrings over all documents: longest previous factors in suffix order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, small
from .jaccard import Powers, mixed

#: A substring of LENGTH bytes that starts earlier too is removed; GRAM bytes make an anchor.
LENGTH, GRAM = 100, 32
#: Distinct snippets of one anchor that are sorted in memory; beyond, Spark sorts their windows.
GROUP = 4_000
#: A snippet that stands in HOT places or more goes at once from all but the first of them. Anchors of a task that are compared before they are dealt.
HOT, TOGETHER = 32, 100_000
#: Bytes of text that are hashed at once; the arrays made of them are some twenty times as large.
RUN = 1 << 18
_BITS = 22
_powers = Powers()


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, content: bool = False) -> tuple[np.ndarray, ...]:
    """(text, hash, place, first, last, and with content a hash of the bytes under these windows) of the anchors of the texts: each window of length bytes belongs to the gram in it with the smallest hash (the leftmost, if several); first..last are the starts of the windows that belong to it.

    Equal windows have equal anchors at equal offsets, wherever they stand.
    """
    size = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    none = tuple(np.empty(0, np.int64) for _ in range(5 + content))
    if len(raw) < length:
        return none
    with np.errstate(over="ignore"):
        up, down = _powers.upto(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), (mixed(raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)]).cumsum(dtype=np.uint64)])
        hashes = mixed((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    mask = np.uint64((1 << _BITS) - 1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    wide, span = length - gram + 1, 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[: -(wide - span)], least[wide - span :])
    ends = np.cumsum(size)
    starts = ends - size
    # Windows inside one text only.
    inside = np.zeros(len(raw) + 1, np.int32)
    fit = size >= length
    np.add.at(inside, starts[fit], 1)
    np.add.at(inside, ends[fit] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[: len(least)])
    if not len(at):
        return none
    place = (least[at] & mask).astype(np.int64)
    text = np.searchsorted(ends, at, side="right")
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(head[1:], len(at)) - 1
    text, place, base = text[head], place[head], starts[text[head]]
    found = text, hashes[place].view(np.int64), place - base, at[head] - base, at[last] - base
    if not content:
        return found
    with np.errstate(over="ignore"):
        a, b = at[head], at[last] + length
        return *found, mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64)


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Rows in runs of at most RUN bytes of text, or one row; (first row, texts)."""
    texts, low, size, some = batch.column(column), 0, 0, []
    for i in range(batch.num_rows):
        t = texts[i]
        b = t.as_buffer().to_pybytes() if t.is_valid else b""
        if some and size + len(b) > RUN:
            yield low, some
            low, size, some = i, 0, []
        some.append(b)
        size += len(b)
    if some:
        yield low, some


def _cut(text: bytes, most: int = 1 << 19) -> list[tuple[int, bytes]]:
    """A text in parts of at most most bytes that overlap by LENGTH - 1, so that each window lies in one part; (start, part)."""
    if len(text) <= most:
        return [(0, text)]
    step = most - LENGTH + 1
    return [(s, text[s : s + most]) for s in range(0, max(1, len(text) - LENGTH + 1), step)]


ANCHORS = "hash long, snippet long, doc long, tag long, spot long, many int"


def anchor_table(docs: DataFrame) -> DataFrame:
    """(hash, snippet, doc, tag, spot, many) of each anchor; snippet is a hash of the bytes under its windows, spot holds place, place - first and place - last.

    Of the anchors that a task sees together, one stands for those with its hash: many is 2 for it, 0 for the others, which
    are known to be repeated and need not meet the rest of their hash, and 1 for a hash seen once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            hashes, snippet, spot = (np.concatenate([r[i] for r in rows]) for i in (0, 1, 4))
            _, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            many = np.where(counts[inverse] > 1, 0, 1).astype("i4")
            many[first[counts > 1]] = 2
            doc, tag = (pa.concat_arrays([r[i] for r in rows]) for i in (2, 3))
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(snippet), doc, tag, pa.array(spot), pa.array(many)], ["hash", "snippet", "doc", "tag", "spot", "many"])

        held, n = [], 0
        for batch in batches:
            doc, tag = batch.column(0), batch.column(1)
            for low, texts in _runs(batch, 2):
                parts = [(low + i, s, p) for i, t in enumerate(texts) for s, p in _cut(t)]
                groups = [parts] if sum(len(p) for _, _, p in parts) < 1 << _BITS else [[p] for p in parts]
                for some in groups:
                    text, hashes, place, first, last, snippet = anchors([p for _, _, p in some], content=True)
                    if len(text):
                        row = pa.array(np.array([i for i, _, _ in some])[text])
                        spot = ((place + np.array([s for _, s, _ in some])[text]) << 14) | ((place - first) << 7) | (place - last)
                        held.append((hashes, snippet, doc.take(row), tag.take(row), spot))
                        n += len(text)
                    if n > TOGETHER:
                        yield out(held)
                        held, n = [], 0
        if held:
            yield out(held)

    return docs.mapInArrow(run, ANCHORS)


def repeated(table: DataFrame) -> DataFrame:
    """The anchors whose hash occurs twice or more. Rows stream by in the order of the hash; one is held back. Those known to be repeated are dealt by place, so a common passage is spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the batch before, and whether it is out
        for batch in batches:
            if not batch.num_rows:
                continue
            key, many = batch.column(0).to_numpy(), batch.column(5).to_numpy()
            same = key[1:] == key[:-1]
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (many != 1)
            if held is not None and held[0].column(0)[0].as_py() == key[0]:
                keep[0] = True
                if not held[1]:
                    yield held[0]
            held = (batch.slice(batch.num_rows - 1, 1), bool(keep[-1]))
            if keep.any():
                yield batch.filter(pa.array(keep))

    dealt = F.when(F.col("many") == 0, F.xxhash64("doc", "tag", "spot")).otherwise(F.col("hash"))
    ordered = table.repartition(dealt).sortWithinPartitions("hash")
    return ordered.mapInArrow(run, ANCHORS).drop("many")


def common_snippets(spots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the spots left to compare, ranges (doc, tag, first, last) of the other copies of snippets that stand in HOT places or more). Counts are made before the shuffle, so a passage of any number of copies costs a task little."""
    here = F.struct("doc", "tag", "spot")
    hot = spots.groupBy("hash", "snippet").agg(F.count(F.lit(1)).alias("_n"), F.min(here).alias("_lead")).where(F.col("_n") >= HOT)
    hot = materialize(hot.select("hash", "snippet", "_lead"), "common")
    marked = spots.join(small(hot), ["hash", "snippet"], "left").withColumn("_later", F.coalesce(here != F.col("_lead"), F.lit(False)))
    place = F.shiftright("spot", 14)
    first, last = place - F.shiftright("spot", 7).bitwiseAND(F.lit(127)), place - F.col("spot").bitwiseAND(F.lit(127))
    later = marked.where("_later").select("doc", "tag", first.alias("first"), last.alias("last"))
    return marked.where(~F.col("_later")).select("hash", "doc", "tag", "spot"), later


def snippets(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """(hash, doc, tag, first, last, bytes): of each repeated anchor the windows that belong to it, as the bytes that they cover."""
    wanted = spots.groupBy("doc", "tag").agg(F.collect_list(F.struct("hash", "spot")).alias("spots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, spots = batch.column(2)[i].as_py(), batch.column(3)[i].values
                spot = spots.field("spot").to_numpy()
                place = spot >> 14
                first, last = place - ((spot >> 7) & 127), place - (spot & 127)
                for low in range(0, len(spot), 10_000):
                    a, b = first[low : low + 10_000], last[low : low + 10_000]
                    cut = [text[x : y + LENGTH] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    one = pa.array(np.full(len(a), i))
                    yield pa.RecordBatch.from_arrays([spots.field("hash").slice(low, len(a)), batch.column(0).take(one), batch.column(1).take(one), pa.array(a), pa.array(b), pa.array(cut, pa.binary())], ["hash", "doc", "tag", "first", "last", "bytes"])

    # The texts stream past a table of the places: sorting them would hold whole texts.
    joined = docs.join(wanted.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "text", "spots")
    return joined.mapInArrow(run, "hash long, doc long, tag long, first long, last long, bytes binary")


def previous_smaller(v: np.ndarray) -> np.ndarray:
    """For each element the place of the nearest smaller one before it, or -1. All elements jump together, each over what the last one it met has jumped over."""
    p = np.arange(-1, len(v) - 1)
    todo = np.arange(len(v))
    while len(todo := todo[(p[todo] >= 0)]) and len(todo := todo[v[p[todo]] > v[todo]]):
        p[todo] = p[p[todo]]
    return p


def common_prefixes(ranked: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the row above, 0 for the first."""
    differ = ranked[1:] != ranked[:-1]
    first = differ.argmax(1)
    return np.concatenate([[0], np.where(differ[np.arange(len(first)), first], first, ranked.shape[1])]) if len(ranked) else np.empty(0, np.int64)


def least_between(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of lcp over low .. high (both included, low <= high)."""
    tables = [lcp]
    while 2 << len(tables) - 1 <= len(lcp):
        half = 1 << len(tables) - 1
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    level = np.frexp(high - low + 1)[1] - 1
    out = np.empty(len(low), lcp.dtype)
    for k, table in enumerate(tables):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
    return out


def previous_factors(windows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For suffixes, each as its first LENGTH bytes, at places order of the corpus, whether the longest previous factor has LENGTH bytes.

    In suffix order the longest earlier match of a suffix is with the nearest suffix above or below it that stands earlier:
    its previous and its next smaller place. The factor's length is the larger of the two least common prefixes up to these.
    """
    n = len(windows)
    padded = np.zeros((n, -(-LENGTH // 8) * 8), np.uint8)
    padded[:, :LENGTH] = windows
    part = padded.view(">u8")
    suffix = np.lexsort([part[:, i].astype(np.uint64) for i in reversed(range(part.shape[1]))])
    lcp, place = common_prefixes(windows[suffix]), order[suffix]
    above, below = previous_smaller(place), n - 1 - previous_smaller(place[::-1])[::-1]
    factor = np.zeros(n, np.int64)
    i = np.flatnonzero(above >= 0)
    factor[i] = least_between(lcp, above[i] + 1, i)
    i = np.flatnonzero(below < n)
    factor[i] = np.maximum(factor[i], least_between(lcp, i + 1, below[i]))
    out = np.zeros(n, bool)
    out[suffix] = factor >= LENGTH
    return out


def repeats(pieces: DataFrame) -> DataFrame:
    """(doc, tag, first, last, bytes): ranges of window starts whose windows start earlier too (bytes null), and snippets whose windows are still to be sorted (bytes given)."""

    def ranges(rows: list[tuple]) -> list[tuple]:
        """rows: (doc, tag, first, last, bytes) of distinct snippets, in the order of the corpus within an anchor."""
        windows, owner, start = [], [], []
        for i, (_, _, first, last, data) in enumerate(rows):
            view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), LENGTH)
            windows.append(view)
            owner.append(np.full(len(view), i))
            start.append(np.arange(first, last + 1))
        owner, start = np.concatenate(owner), np.concatenate(start)
        hit = np.flatnonzero(previous_factors(np.concatenate(windows), np.arange(len(owner))))
        if not len(hit):
            return []
        head = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])]))
        tail = np.append(head[1:], len(hit)) - 1
        return [(*rows[owner[hit[a]]][:2], int(start[hit[a]]), int(start[hit[b]]), None) for a, b in zip(head, tail, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

        def full(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc", "tag", "first", "last", "bytes"])

        key, seen, crowded = None, {}, False
        queue: list[tuple] = []
        queued = 0
        out: list[tuple] = []
        for batch in batches:
            for hash_, doc, tag, first, last, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if hash_ != key:
                    if len(seen) > 1 and not crowded:
                        queue += seen.values()
                        queued += sum(r[3] - r[2] + 1 for r in seen.values())
                        if queued > 30_000:
                            out += ranges(queue)
                            queue, queued = [], 0
                    key, seen, crowded = hash_, {}, False
                if data in seen:
                    out.append((doc, tag, first, last, None))
                elif crowded:
                    out.append((doc, tag, first, last, data))
                else:
                    seen[data] = (doc, tag, first, last, data)
                    if len(seen) > GROUP:
                        out += seen.values()
                        crowded = True
                if len(out) > 20_000:
                    yield full(out)
                    out = []
        if len(seen) > 1 and not crowded:
            queue += seen.values()
        if queue:
            out += ranges(queue)
        if out:
            yield full(out)

    ordered = pieces.repartition("hash").sortWithinPartitions("hash", "doc", "tag", "first")
    return ordered.mapInArrow(run, "doc long, tag long, first long, last long, bytes binary")


def crowded_repeats(rest: DataFrame) -> DataFrame:
    """(doc, tag, first, last) of repeated windows, for snippets of crowded anchors: Spark sorts the windows by their bytes and place, and each is compared with the one before."""
    windows = rest.select("doc", "tag", "bytes", "first", F.posexplode(F.sequence(F.lit(1), (F.col("last") - F.col("first") + 1).cast("int"))).alias("i", "_from"))
    windows = windows.select(F.substring("bytes", F.col("_from"), F.lit(LENGTH)).alias("window"), "doc", "tag", (F.col("first") + F.col("i")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            window = batch.column(0).to_pylist()
            keep = np.array([w == (window[i - 1] if i else last) for i, w in enumerate(window)], bool)
            last = window[-1] if window else last
            if keep.any():
                some = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), some.column(3), some.column(3)], ["doc", "tag", "first", "last"])

    ordered = windows.repartition("window").sortWithinPartitions("window", "doc", "tag", "start")
    return ordered.mapInArrow(run, "doc long, tag long, first long, last long")


def without(data: bytes, cuts: pa.Scalar, copy: bool | None) -> tuple[bytes, int]:
    """The bytes outside the windows that start in the ranges cuts, and the number of runs that go; nothing stays of a copy."""
    if copy:
        return b"", 1
    if not cuts.is_valid:
        return data, 0
    first, last = cuts.values.field("first").to_numpy(), cuts.values.field("last").to_numpy()
    by = np.argsort(first, kind="stable")
    low, high = first[by], np.maximum.accumulate(last[by] + LENGTH)
    head = np.concatenate([[True], low[1:] > high[:-1]])
    starts, ends = low[head], np.append(high[:-1][head[1:]], high[-1])
    edge, parts = 0, []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        parts.append(data[edge:a])
        edge = b
    return b"".join([*parts, data[edge:]]), len(starts)


def deduplicate(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row (the columns in keep, or all), kept (binary), n_bytes, n_removed and n_spans of each document.

    Removed is each UTF-8 byte under a string of LENGTH bytes that also starts earlier: in a smaller doc_id, or earlier in
    the same document. Whole copies of an earlier document go at once. Of the others, each window of LENGTH bytes belongs
    to the anchor in it (anchors()), so equal windows meet under one anchor hash. Anchors that occur once are dropped. Of a
    snippet (the bytes under an anchor's windows) in HOT places or more all but the first go by a count. The others are
    dealt by hash, and previous_factors() finds the windows with an earlier match in the suffix order of an anchor's
    snippets; equal ones are found by comparison, and one of them is sorted. An anchor with more than GROUP distinct
    snippets is sorted by Spark instead.

    Null or empty text, and text under LENGTH bytes: nothing removed. Very long texts are hashed in parts that overlap. Null doc_id: before all others. Rows that repeat a
    doc_id: with the same text, one document that comes back as often; with other texts, in the order of a text hash. Empty
    table: no rows. Columns named like those of the result stay apart, inside row.
    """
    bound_batches(docs.sparkSession)
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    several = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    tag = F.xxhash64(text) if several else F.lit(0).cast("long")
    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), tag.alias("tag"), text.alias("text"))
    hashed = rows.select("doc", "tag", F.md5("text").alias("md5"), F.length("text").alias("n")).distinct().where(F.col("n") >= LENGTH)
    firsts = hashed.groupBy("md5", "n").agg(F.min(F.struct("doc", "tag")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = hashed.join(firsts, ["md5", "n"]).where(F.struct("doc", "tag") != F.col("first")).select("doc", "tag", F.lit(True).alias("copy"))
    copies = materialize(copies, "copies")
    single = rows.select("doc", "tag", "text").where(F.length("text") >= LENGTH).join(small(copies.select("doc", "tag")), ["doc", "tag"], "left_anti")
    if several:
        single = single.dropDuplicates(["doc", "tag"])
    spots, later = common_snippets(materialize(repeated(anchor_table(single)), "anchors"))
    found = materialize(repeats(snippets(single, spots)), "repeats")
    ranges = found.where("bytes is null").select("doc", "tag", "first", "last").unionByName(later)
    crowded = found.where("bytes is not null")
    if crowded.limit(1).count():
        ranges = ranges.unionByName(crowded_repeats(crowded))
    cuts = ranges.groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "last")).alias("cuts"))
    joined = rows.join(cuts.join(copies, ["doc", "tag"], "full").hint("shuffle_hash"), ["doc", "tag"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in _runs(batch, 1):
                some = batch.slice(low, len(texts))
                kept, spans = zip(*(without(t, some.column(2)[i], some.column(3)[i].as_py()) for i, t in enumerate(texts)), strict=True)
                n, left = (np.array([len(x) for x in many], "i8") for many in (texts, kept))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(kept, pa.binary()), pa.array(n), pa.array(n - left), pa.array(spans, pa.int64())], ["row", "kept", "n_bytes", "n_removed", "n_spans"])

    schema = joined.select("row").schema.add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    return joined.select("row", "text", "cuts", "copy").mapInArrow(run, schema)
