"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space: what separates words.
SPACE = r"[\x20\x09-\x0D]+"

#: A side with at most this many rows (of a few numbers or short strings each) is broadcast; beyond it a shuffle joins.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made only in local mode where the session names none; on a cluster it has to."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="siteprofile-")
        atexit.register(shutil.rmtree, made, True)
        folder = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let no Arrow batch of this session exceed about most bytes, so that a task that sends whole texts to Python holds little of them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, columns can be pruned, retries see the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bind(value: Column, body) -> Column:
    """body(value), with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def small(df: DataFrame) -> DataFrame:
    """The table, of rows of a bounded size, with a broadcast hint if a count shows that it has few rows; else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def number_rows(df: DataFrame, part: list[str], order: list[str], out: str) -> DataFrame:
    """Add a gapless number from 0 to the rows of each part, in the order of the columns order (nulls first).

    One range shuffle puts the whole table in order, so a part of any size is spread over many tasks, and its order does not
    depend on the number of rows. The rows are written as they lie in the tasks; the counts of each part in each task, a
    row or two a task, summed up within the part, give the first number there. Rows alike in part and order stand as they come.
    """
    unique = "_m"  # alike rows may be split between tasks too
    keys = [*part, *order, unique]
    ranged = df.withColumn(unique, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(unique)
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    structs = [F.struct(F.col(c)).alias(f"_k{i}") for i, c in enumerate(part)]  # in a struct null equals null
    names = [f"_k{i}" for i in range(len(part))]
    placed = placed.select("*", *structs, F.shiftright("_at", 33).alias("_task"))
    runs = placed.groupBy(*names, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_least"))
    before = Window.partitionBy(*names).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = runs.select(*names, "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_first"))
    return placed.join(small(firsts), [*names, "_task"]).withColumn(out, F.col("_first") + F.col("_at")).drop(*names, "_task", "_first", "_at")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the edges (a, b): one row (node, component) per node that has an edge to another; component is the smallest node.

    Alternating large-star and small-star rounds: each halves the height of the trees, and each round's edges are
    checkpointed. Only a count and a checksum come to the driver.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    pairs = checkpoint(pairs)
    state = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        pairs = checkpoint(stars)
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
