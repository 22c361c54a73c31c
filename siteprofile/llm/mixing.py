"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import count_words, materialize, number_rows, small

WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = 3.0) -> DataFrame:
    """sizes (source, source_size) with each source's weight and target.

    Weights are dealt by code point order of the source, null last, and repeat. The targets share the sum of all sizes by
    weight; none exceeds most * source_size. Sharing the excess again by weight until no target is too large ends at one
    level L with target = min(most * size, L * weight). With the sources in the order of most * size / weight, the level is
    the first (total - caps before) / (weights from here on) that does not exceed the ratio there: two running sums over one
    row per source.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    array = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(array, (F.row_number().over(by_name) - 1) % len(weights) + 1)).withColumn("_total", total.cast("double"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_ratio", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("_level", (F.col("_total") - before) / rest)
    level = level.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(Window.partitionBy())["_level"])
    return level.select("source", "source_size", "weight", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap"))).alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, most: float = 3.0, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """One row (row, size, source_size, target, copies) per document; row holds the columns in keep (all, if None).

    Within a source the documents stand in the order of their size, then of doc_id, each with target / source_size expected
    copies. The running sum of these, moved by one offset that the seed and the source give, crosses an integer boundary
    once per copy. As neighbours have like sizes, the words taken come near the target. Texts are read once; the numbers
    come from common.number_rows, so a source that holds a third of all rows is ranked in many tasks.

    Null or empty text: size 0. Very long texts: only their words are counted. Null source: a source of its own, the last.
    Repeated rows: documents of their own. A source of size 0 has target 0 and no copies. Empty table: no rows. Clashing
    columns: kept apart, inside row.
    """
    row = F.struct(*(keep or ["*"])).alias("row")
    rows = docs.select(row, F.col("source").alias("source"), F.col("doc_id").alias("_id"), F.xxhash64(F.struct("*")).alias("_tie"), count_words(F.col("text")).alias("size"))
    rows = materialize(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = materialize(targets(sizes, weights, most), "targets")
    numbered = number_rows(rows, ["source"], ["size", "_id", "_tie"], "_k")
    out = numbered.withColumn("_s", F.struct("source")).join(small(goal.select(F.struct("source").alias("_s"), "source_size", "target")), "_s")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    copies = F.floor(each * (F.col("_k") + 1) + offset) - F.floor(each * F.col("_k") + offset)
    return out.select("row", "size", "source_size", "target", F.least(copies, F.lit(int(most))).cast("int").alias("copies"), "_id", "_tie")


def mix(docs: DataFrame, weights=WEIGHTS, most: float = 3.0, seed: int = 42) -> DataFrame:
    """The mixed documents: every row as often as plan() takes it, with the columns of the input. A document with no words rides along with its source's rate.

    The plan has no texts; they are fetched at the end by doc_id and a hash of the row, once for rows that repeat.
    """
    taken = plan(docs, weights, most, seed, keep=["doc_id"]).groupBy("_id", "_tie").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    taken = materialize(taken.where("_copies > 0").select(F.struct("_id", "_tie").alias("_key"), "_copies", "_rows"), "taken")
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").alias("_id"), F.xxhash64(F.struct("*")).alias("_tie")).alias("_key"))
    found = rows.join(taken.hint("shuffle_hash"), "_key")
    alone = found.where("_rows = 1").select("row", "_copies")
    if taken.where("_rows > 1").limit(1).count():
        alone = alone.unionByName(found.where("_rows > 1").groupBy("_key").agg(F.first("row").alias("row"), F.first("_copies").alias("_copies")).drop("_key"))
    return alone.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy")).select("row.*")
