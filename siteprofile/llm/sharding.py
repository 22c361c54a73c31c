"""Sharding by histogram sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, number_rows

BINS = 1024


def splitters(keyed: DataFrame, n_shards: int, tolerance: float) -> list[tuple]:
    """Boundaries (k1, k2, k3), ascending, that cut the bytes of keyed into n_shards near equal ranges; a row belongs below the first boundary that exceeds its key.

    Each round counts the exact bytes between probes: the open interval of each unsettled splitter is cut into at most BINS
    equal steps of the current key part, and one aggregation sums the bytes of each step. A splitter is settled when the
    bytes below one of its probes are within the tolerance; else the step that holds its target is the next interval. An
    interval of one key value goes on with the next key part. At most BINS rows per splitter and round reach the driver.
    """
    ends = keyed.agg(F.sum("size"), F.min("k1"), F.max("k1")).first()
    total = ends[0] or 0
    if not total:
        return []
    slack = max(1, int(tolerance * total / n_shards))
    # An open interval: fixed key parts, lowest and highest value of the next part, bytes below the interval.
    todo = {i: ((), ends[1], ends[2], 0) for i in range(1, n_shards)}
    done: dict[int, tuple] = {}
    while todo:
        groups = sorted(set(todo.values()))
        case, value = F.lit(None).cast("int"), F.lit(None).cast("long")
        for g, (fixed, low, high, _) in reversed(list(enumerate(groups))):
            part = F.col(f"k{len(fixed) + 1}")
            step = max(1, -(-(high - low + 1) // BINS))
            inside = part.between(low, high)
            for j, x in enumerate(fixed):
                inside = inside & (F.col(f"k{j + 1}") == x)
            # Steps are taken from the two halves of the difference, so no long overflows.
            at = F.floor((part.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(step).cast("decimal(20,0)")).cast("long")
            case, value = F.when(inside, g).otherwise(case), F.when(inside, at).otherwise(value)
        counted = keyed.select(case.alias("g"), value.alias("at"), "size", *[f"k{j}" for j in (1, 2, 3)]).where("g is not null").groupBy("g", "at").agg(F.sum("size").alias("n"))
        rows: dict[int, list] = {}
        for r in counted.collect():  # at most BINS rows a group
            rows.setdefault(r["g"], []).append((r["at"], r["n"]))
        following = {}
        for i, key in todo.items():
            g = groups.index(key)
            fixed, low, high, below = key
            step = max(1, -(-(high - low + 1) // BINS))
            target = round(total * i / n_shards)
            for at, n in sorted(rows[g]):
                if abs(below - target) <= slack or below + n > target:
                    first = low + at * step
                    last = min(high, first + step - 1)
                    if abs(below - target) <= slack:
                        done[i] = (*fixed, first)
                    elif abs(below + n - target) <= slack:
                        done[i] = (*fixed, last + 1)
                    elif first < last:
                        following[i] = (fixed, first, last, below)
                    elif len(fixed) < 2:
                        inner = keyed
                        for j, x in enumerate((*fixed, first)):
                            inner = inner.where(F.col(f"k{j + 1}") == x)
                        a, b = inner.agg(F.min(f"k{len(fixed) + 2}"), F.max(f"k{len(fixed) + 2}")).first()
                        following[i] = ((*fixed, first), a, b, below)
                    else:  # a single row is larger than the tolerance
                        done[i] = (*fixed, first if target - below <= below + n - target else first + 1)
                    break
                below += n
            else:
                done[i] = (*fixed, high + 1)
        todo = following
    return [done[i] for i in sorted(done)]


def shard(docs: DataFrame, n_shards: int = 8, tolerance: float = 0.001, keep: list[str] | None = None) -> DataFrame:
    """row (the columns in keep, or all), size, text_crc32, shard and slot for each document.

    The order is by doc_id, then by a hash of the row, then (among rows alike in both) by place; null doc_ids come first.
    size is the UTF-8 bytes of the text plus 1; null text has none. The shards are ranges of that order, their bytes equal
    up to the tolerance or one row. Slots are gapless from 0, in that order, at any number of rows. Null or empty text:
    size 1. Very long texts: only their bytes are counted. Repeated rows stay; an empty table gives no rows; one key with a
    third of all rows is split by the later key parts. Columns named like those of the result stay apart, inside row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.struct(*(keep or ["*"])).alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(F.struct("*")).alias("k2"))
    return _cut(keyed, n_shards, tolerance)


def _cut(keyed: DataFrame, n_shards: int, tolerance: float) -> DataFrame:
    table = materialize(keyed.withColumn("k3", F.monotonically_increasing_id()), "shard-keys")
    cuts = splitters(table.select("size", "k1", "k2", "k3"), n_shards, tolerance)
    above = F.lit(0)
    for cut in cuts:
        parts = [F.col(f"k{j + 1}") for j in range(len(cut))]
        reached = F.lit(False)
        for j in reversed(range(len(cut))):
            value = F.lit(min(cut[j], (1 << 63) - 1)).cast("long")
            over = parts[j] > value if cut[j] < 1 << 63 and j < len(cut) - 1 else (parts[j] >= value if cut[j] < 1 << 63 else F.lit(False))
            reached = over | ((parts[j] == value) & reached) if j < len(cut) - 1 else over
        above = above + reached.cast("int")
    return number_rows(table.withColumn("shard", above.cast("int")), ["shard"], ["k1", "k2", "k3"], "slot").drop("k1", "k2", "k3")


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, tolerance: float = 0.001) -> None:
    """Write each shard to its own folder shard=N under path, in slot order within each file. Large shards become several files."""
    done = shard(docs, n_shards, tolerance)
    done.select("row.*", "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
