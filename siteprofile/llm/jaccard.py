"""Exact Jaccard join on word shingles: T-occurrence search with DivideSkip."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound_batches, components, materialize, small

#: A shingle in at least FREQUENT of the documents that are hashed at once is counted; the most frequent MAX_FREQUENT of these go last in the order of the lists. The order never changes the result.
FREQUENT, MAX_FREQUENT = 2, 500_000
#: Short lists that a document has beyond |x| - T + 1, in percent of its shingles: so many more of them must be shared.
MORE = 10
#: Documents, and shingles of these, that one search compares at once.
BLOCK, BLOCK_SHINGLES = 1_000, 1_000_000
#: Members of lists up to which a heap merges them, and the cost of a probe over that of a member to merge.
HEAP, COST = 2_000, 1.0

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, as many as have been asked for."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << n.bit_length()
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.full(n - 1, base)]).cumprod(dtype=np.uint64) for base in (_P, _INVERSE))
        return self.up[:n], self.down[:n]


_powers = Powers()


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct n-word shingles (the whole sequence, if it has fewer words; none without words).

    All texts are hashed at once: running sums of the bytes times powers of an odd base give each word's hash, and the
    same over the word hashes gives each shingle's.
    """
    raw = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    with np.errstate(over="ignore"):
        up, down = _powers.upto(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), (mixed(raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)]).cumsum(dtype=np.uint64)])
        inside = ~_SPACE[raw]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        word = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        cut = np.searchsorted(start, ends_at)
        out = []
        low = 0
        total = word.copy()
        weight = np.uint64(1)
        for j in range(1, n):
            weight = weight * np.uint64(0xD6E8FEB86659FD93)
            if len(word) > j:
                total[:-j] += word[j:] * weight
        total = mixed(total)
        for high in cut.tolist():
            k = high - low
            if k >= n:
                out.append(np.unique(total[low : high - n + 1]))
            elif k:
                w = word[low:high].copy()
                whole = np.uint64(k)
                for x in w:
                    whole = mixed(np.array([whole * np.uint64(0xA24BAED4963EE407) + x]))[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
            low = high
    return out


def _chunks(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of the batch in runs of about most bytes of text, as UTF-8: (first row, texts)."""
    texts, low, size, some = batch.column(column), 0, 0, []
    for i in range(batch.num_rows):
        t = texts[i]
        b = t.as_buffer().to_pybytes() if t.is_valid else b""
        some.append(b)
        size += len(b)
        if size >= most or len(some) >= 5000:
            yield low, some
            low, size, some = i + 1, 0, []
    if some:
        yield low, some


def needed(n: int, percent: int) -> int:
    """Least overlap that a set of n shingles has with any set at this similarity."""
    return -(-n * percent // 100)


def signatures(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, s1, s2) for each row, s1 and s2 being hashes of the whole set, and (shingle, count) for the frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in _chunks(batch, 1):
                sets = shingle_sets(texts, n)
                with np.errstate(over="ignore"):
                    s1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                    s2 = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                size = np.array([len(s) for s in sets], np.int64)
                _, first = np.unique(np.stack([s1, s2]), axis=1, return_index=True)
                values, counts = np.unique(np.concatenate([sets[i] for i in first]), return_counts=True)
                often = counts >= FREQUENT
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(sets)), pa.array(size), pa.array(s1), pa.array(s2)], ["doc_id", "n_shingles", "s1", "s2"])
                if k := int(often.sum()):
                    none = pa.nulls(k, pa.int64())
                    yield pa.RecordBatch.from_arrays([none, pa.array(-counts[often]), pa.array(values[often].view(np.int64)), none], ["doc_id", "n_shingles", "s1", "s2"])

    found = materialize(docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long"), "signatures")
    frequent = found.where("n_shingles < 0").groupBy(F.col("s1").alias("shingle")).agg((-F.sum("n_shingles")).alias("count"))
    return found.where("n_shingles >= 0"), frequent


def more(n):
    """Short lists that a document of n shingles shares at least with any linked one that is not smaller."""
    return n * MORE // 100 + 1


def short_lists(docs: DataFrame, n: int, percent: int, frequent: DataFrame) -> DataFrame:
    """(shingle, n, doc_id) for the shortest inverted lists of each document of n shingles: n - T + more(n) of them, T being the least overlap with any partner. Two linked documents share more() of these, by the smaller of the two."""
    table = frequent.orderBy(F.desc("count"), "shingle").limit(MAX_FREQUENT).toPandas()  # bounded by MAX_FREQUENT
    keys, often = table["shingle"].to_numpy().astype(np.int64).view(np.uint64), table["count"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], often[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, often = shared.value
        for batch in batches:
            for low, texts in _chunks(batch, 1):
                names = batch.column(0).slice(low, len(texts)).to_numpy(zero_copy_only=False)
                sets = shingle_sets(texts, n)
                size = np.array([len(s) for s in sets])
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                length = np.zeros(len(flat), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                    length = np.where(keys[at] == flat, often[at], 0)
                rank = np.lexsort([flat, length, owner])
                place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                short = place < np.repeat(size - needed(size, percent) + more(size), size)
                lists, owner = flat[rank][short], owner[rank][short]
                yield pa.RecordBatch.from_arrays([pa.array(lists.view(np.int64)), pa.array(size[owner].astype(np.int64)), pa.array(names[owner].astype(np.int64))], ["shingle", "n", "doc_id"])

    return docs.mapInArrow(run, "shingle long, n long, doc_id long")


def lists_to_groups(lists: DataFrame, percent: int) -> DataFrame:
    """(doc_id, leader, n) for the documents that share enough of their short lists to have a link at all.

    A list in the order of size falls into runs in which each size is at least percent of the next; linked documents of a
    list lie in one run, and the first document of the run is their leader. The lists stream by in order; none is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # shingle, size and leader of the run that may go on, and whether it has the leader alone so far
        for batch in batches:
            shingle, size, doc = (batch.column(i).to_numpy() for i in range(3))
            if not len(shingle):
                continue
            head = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (size[:-1] * 100 < percent * size[1:])])
            extra = []
            if last and last[0] == shingle[0] and last[1] * 100 >= percent * size[0]:
                head[0] = False
                if last[4]:
                    extra = [(last[3], last[2], last[3])]
            first = np.maximum.accumulate(np.where(head, np.arange(len(head)), -1))
            leader = np.where(first >= 0, doc[first], last[3] if last else 0)
            member = ~head | np.concatenate([~head[1:], [False]])
            last = (shingle[-1], size[-1], size[first[-1]] if first[-1] >= 0 else last[2], leader[-1], bool(head[-1]))
            rows = np.stack([doc[member], size[member], leader[member]], 1)
            rows = np.concatenate([rows, np.array(extra, np.int64).reshape(-1, 3)])
            if len(rows):
                rows, count = np.unique(rows, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, i].copy()) for i in range(3)), pa.array(count)], ["doc_id", "n", "leader", "lists"])

    ordered = lists.repartition("shingle").sortWithinPartitions("shingle", "n", "doc_id")
    pairs = ordered.mapInArrow(run, "doc_id long, n long, leader long, lists long").groupBy("doc_id", "n", "leader").agg(F.sum("lists").alias("lists"))
    pairs = materialize(pairs, "pairs")
    least = F.floor(F.ceil(F.col("n") * percent / 100) * MORE / 100) + 1
    able = pairs.groupBy("doc_id", "n").agg(F.sum("lists").alias("shared")).where(F.col("shared") >= least).select("doc_id").distinct()
    return pairs.groupBy("doc_id", "leader").agg(F.max("n").alias("n")).join(able, "doc_id", "left_semi")


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The members of sorted inverted lists in order, and how many of the lists each is in: by a heap, or by one sort where the lists have more than HEAP members."""
    if sum(map(len, lists)) > HEAP:
        return np.unique(np.concatenate(lists), return_counts=True)
    runs = [(c, sum(1 for _ in run)) for c, run in groupby(heapq.merge(*(x.tolist() for x in lists)))]
    return np.array([c for c, _ in runs], np.int64), np.array([n for _, n in runs], np.int64)


def long_lists(least: int, longest: int) -> int:
    """How many of its longest lists a query sets aside, of which least have to hold a partner: least / (COST * log2(longest) + 1)."""
    return min(least - 1, int(least / (COST * math.log2(max(longest, 2)) + 1)))


def divide_skip(sets: list[np.ndarray], queries: list[int], percent: int) -> np.ndarray:
    """Link each query to the sets with 100 * |intersection| >= percent * |union|; returns the smallest index that links reach, for each set.

    The sets come in the order of their size, so those of a possible size are a range of places, and of each inverted list
    only that range is read. T being the least overlap of the query, its long_lists() longest lists are set aside and the
    others are merged. A candidate is in at least T - L of these and not linked to the query yet; all candidates are then
    probed in the L long lists, by binary search, until they have the overlap that the two sizes ask for or can no longer
    reach it.
    """
    size = np.array([len(s) for s in sets], np.int64)
    root = np.arange(len(sets))
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.lexsort([owner, value])
    value, owner = value[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.empty(0, np.int64)
    unique, ends = value[head], np.append(head[1:], len(value))
    for q in queries:
        least = needed(int(size[q]), percent)
        at = np.searchsorted(unique, sets[q])
        at = at[ends[at] - head[at] > 1]  # a list of the query alone adds nothing
        if not size[q] or len(at) < least:
            continue
        first, last = np.searchsorted(size * 100, percent * size[q]), np.searchsorted(size * percent, 100 * size[q], side="right")
        open_ = root != root[q]
        open_[:first], open_[last:] = False, False
        if not open_.any():
            continue
        at = at[np.argsort(ends[at] - head[at], kind="stable")]
        n_long = long_lists(least, int(ends[at[-1]] - head[at[-1]]))
        lists = [owner[low:high] for low, high in zip(head[at].tolist(), ends[at].tolist(), strict=True)]
        found_in, found = merged([x[open_[x]] for x in lists[: len(lists) - n_long]])
        able = found >= least - n_long
        candidate, found = found_in[able], found[able]
        want = -(-percent * (size[q] + size[candidate]) // (100 + percent))
        links = candidate[found >= want]
        for i, x in enumerate(lists[len(lists) - n_long :]):
            rest = (found < want) & (found + (n_long - i) >= want)
            candidate, found, want = candidate[rest], found[rest], want[rest]
            if not len(candidate):
                break
            k = np.minimum(np.searchsorted(x, candidate), len(x) - 1)
            found = found + (x[k] == candidate)
            links = np.concatenate([links, candidate[found >= want]])
        if len(links):
            reached = np.unique(np.append(root[links], root[q]))
            root[np.isin(root, reached)] = reached[0]
    return root


def search(members: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b) that span the links inside each block of a group; members has doc_id, group, block and side.

    Documents of side 1 are compared with all of the block, those of side 0 with side 1 alone. The sets are made anew from
    the texts, for the documents of a group only.
    """

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in _chunks(batch, 1):
                names, members = batch.column(0).slice(low, len(texts)), batch.column(2).slice(low, len(texts)).to_pylist()
                sets = shingle_sets(texts, n)
                flat = [(i, m) for i, ms in enumerate(members) for m in ms]
                for at in range(0, len(flat), 1000):
                    some = flat[at : at + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([m["group"] for _, m in some], pa.int64()), pa.array([m["block"] for _, m in some], pa.int64()), pa.array([m["side"] for _, m in some], pa.int32()), names.take(pa.array([i for i, _ in some])), pa.array([sets[i].tobytes() for i, _ in some], pa.binary())], ["group", "block", "side", "doc_id", "shingles"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def solve() -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            rows.sort(key=lambda r: (len(r[2]), r[1]))
            ids, sets = [r[1] for r in rows], [np.frombuffer(r[2], np.uint64) for r in rows]
            root = divide_skip(sets, [i for i, r in enumerate(rows) if r[0]], percent).tolist()
            edges = [(ids[i], ids[r]) for i, r in enumerate(root) if r != i]
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for group, block, side, doc, shingles in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (group, block) != key:
                    yield from solve()
                    key, rows = (group, block), []
                rows.append((side, doc, shingles))
        yield from solve()

    groups = members.groupBy("doc_id").agg(F.collect_set(F.struct("group", "block", "side")).alias("members"))
    few = members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # of members, so the arrays are bounded too
    wanted = docs.join(F.broadcast(groups) if few else groups.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "members")
    sets = wanted.mapInArrow(sets_of, "group long, block long, side int, doc_id long, shingles binary")
    ordered = sets.repartition("group", "block").sortWithinPartitions("group", "block")
    return ordered.mapInArrow(link, "a long, b long")


def by_band(groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """groups (doc_id, group, n) with band and block, and the table of blocks (group, anchor, crowded, band, blocks).

    Sizes of one band are within 100 / percent of each other, so links stay in a band or reach the next. A group of up to
    BLOCK documents and BLOCK_SHINGLES shingles is one block; of a crowded one each band is dealt to blocks of that size. The
    anchor is the smallest document of the group.
    """
    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0
    banded = groups.withColumn("band", F.floor(F.log(F.col("n")) / F.lit(step)).cast("long"))
    many = lambda n, total: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(total / F.lit(BLOCK_SHINGLES)))
    bands = banded.groupBy("group", "band").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"), F.min("doc_id").alias("least"))
    whole = bands.groupBy("group").agg(F.sum("docs").alias("_d"), F.sum("total").alias("_t"), F.min("least").alias("anchor")).where("_d > 1")
    whole = whole.select("group", "anchor", (many(F.col("_d"), F.col("_t")) > 1).alias("crowded"))
    blocks = materialize(bands.join(whole, "group").select("group", "anchor", "crowded", "band", many(F.col("docs"), F.col("total")).alias("blocks")), "blocks")
    return banded.join(blocks, ["group", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))), blocks


def _numbers(name: str, count: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).alias(name)


def block_members(spread: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, group, block, side) of the first search: each block of a group with the group's anchor."""
    key = F.when(F.col("crowded"), F.xxhash64("band", "block")).otherwise(0).alias("block")
    own = spread.select("doc_id", "group", key)
    anchors = blocks.where("crowded").select(F.col("anchor").alias("doc_id"), "group", "band", "crowded", _numbers("block", "blocks")).select("doc_id", "group", key)
    return own.unionByName(anchors).distinct().withColumn("side", F.lit(1))


def away_members(spread: DataFrame, blocks: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, group, block, side) of the second search: the documents of crowded groups that known components do not join to their anchor, in parts, each with the blocks whose sizes can link."""
    known = known.select("node", "component")
    crowded = spread.where("crowded")
    label = crowded.join(known.toDF("doc_id", "c"), "doc_id", "left").join(known.toDF("anchor", "ac"), "anchor", "left")
    away = materialize(label.where("coalesce(c, doc_id) <> coalesce(ac, anchor)").select("doc_id", "group", "band", "n"), "away")
    parts = away.groupBy("group", F.col("band").alias("at")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).alias("parts"))
    near = F.abs(F.col("band") - F.col("at")) <= 1
    key = F.xxhash64("at", "part", "band", "block").alias("block")
    asked = away.withColumnRenamed("band", "at").join(parts, ["group", "at"]).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("parts")))
    asked = asked.join(blocks.select("group", "band", "blocks"), "group").where(near).select("doc_id", "group", "at", "part", "band", _numbers("block", "blocks"))
    answer = crowded.join(parts, "group").where(near).select("doc_id", "group", "at", "band", "block", _numbers("part", "parts"))
    both = asked.select("doc_id", "group", key, F.lit(1).alias("side")).unionByName(answer.select("doc_id", "group", key, F.lit(0).alias("side")))
    return both.groupBy("doc_id", "group", "block").agg(F.max("side").alias("side"))


def classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: the smallest doc_id that links reach.

    Documents with 100 * |intersection| >= percent * |union| of their shingle sets link. Documents with the same set form
    one class; the smallest stands for it. Linked documents share several of their short inverted lists, so a document that
    shares too few has no link, and the first document of each list (in a run of like sizes) gathers the others in a group.
    DivideSkip searches each group in blocks; members of one list have its leader in common, so no pair is missed. A crowded
    group is cut by sizes into blocks that each hold its smallest document, the anchor; of those, the documents not yet in
    the anchor's component are searched again against the blocks of the group whose sizes can link. Pairs are not written
    out, and a pair in one known component is not compared.

    Null or empty text: no shingles, linked with nothing. Very long texts: hashed as they stream by, held as 8 bytes a
    shingle. Rows with null doc_id do not take part and come back with null component. Rows that repeat a doc_id: one row
    each; the links of all rows of a doc_id are joined. Empty table: no rows. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, frequent = signatures(plain, n)
    first = found.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    first = materialize(first, "classes")
    copies = first.where("n > 1")
    named = found.where("n_shingles > 0 and doc_id is not null")
    same = named.join(copies.select("s1", "s2", "rep"), ["s1", "s2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    same = materialize(same, "same")
    # A copy has the lists of its class, so the class is searched alone; not so where rows with other texts bear its doc_id.
    several = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copied = materialize(same.select(F.col("a").alias("doc_id")).distinct().join(several, "doc_id", "left_anti"), "copied")
    single = plain.where("doc_id is not null").join(small(copied), "doc_id", "left_anti")
    groups = materialize(lists_to_groups(short_lists(single, n, percent, frequent), percent).withColumnRenamed("leader", "group"), "groups")
    spread, blocks = by_band(groups, percent)
    edges = materialize(search(block_members(spread, blocks), plain, n, percent), "edges")
    if blocks.where("crowded").limit(1).count():
        known = components(edges.unionByName(same))
        edges = edges.unionByName(materialize(search(away_members(spread, blocks, known), plain, n, percent), "edges-away"))
    linked = components(edges.unionByName(same))
    out = found.join(linked, found["doc_id"] == linked["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that a smaller doc_id of their component stands for. Rows that repeat a doc_id: all but one go. Columns as in the input; rows with null doc_id stay."""
    gone = classes(docs, n, percent).where("doc_id <> component_id").select("doc_id").distinct()
    stay = docs.join(small(materialize(gone, "gone")), "doc_id", "left_anti").select(*docs.columns)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        stay = stay.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(stay.where("doc_id is null"))
    return stay
