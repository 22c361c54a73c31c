"""A sorted store of intervals with an index, from which a region reads the files that it touches and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import overlap_join


def write(rows: DataFrame, folder: str, start: str = "start", end: str = "end", files: int | None = None, mode: str = "errorifexists") -> None:
    """Intervals (chrom, start, end and more) below folder: data, range partitioned and sorted by chrom and start, a file a partition, and index.

    The index has a row for each file and chromosome in it: the number of rows, the least start and the largest end. A crowded
    stretch of a chromosome is split between files. Rows without chrom, start or end are kept, and met by no region.
    """
    keys = ["chrom", start, end]
    dealt = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode(mode).parquet(f"{folder}/data")
    stored = rows.sparkSession.read.parquet(f"{folder}/data")
    held = stored.select("chrom", F.col(start).alias("_s"), F.col(end).alias("_e"), F.col("_metadata.file_name").alias("file")).groupBy("file", "chrom")
    index = held.agg(F.count(F.lit(1)).alias("n"), F.min("_s").alias("start"), F.max("_e").alias("end"))
    index.coalesce(1).write.mode(mode).parquet(f"{folder}/index")  # a row for each file and chromosome


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def files_of(spark: SparkSession, folder: str, chrom, start: int, end: int) -> list[str]:
    """The files with rows that a region may touch, by the index alone."""
    near = index(spark, folder).where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))
    return [f"{folder}/data/{r.file}" for r in near.select("file").orderBy("file").collect()]


def region(spark: SparkSession, folder: str, chrom, start: int, end: int, start_col: str = "start", end_col: str = "end") -> DataFrame:
    """The rows that share a base with [start, end) of chrom; other files are not opened, and row groups are pruned by their statistics."""
    found = files_of(spark, folder, chrom, start, end)
    rows = spark.read.schema(spark.read.parquet(f"{folder}/data").schema).parquet(*found) if found else spark.read.parquet(f"{folder}/data").limit(0)
    return rows.where((F.col("chrom") == chrom) & (F.col(start_col) < end) & (F.col(end_col) > start))


def regions(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    """Pairs of stored rows and asked regions (chrom, start, end, and columns named apart) that share a base, as overlap_join() gives them; files that no region touches are not opened."""
    near = overlap_join(index(spark, folder).select("file", "chrom", "start", "end"), asked.select("chrom", "start", "end"))
    found = [f"{folder}/data/{r.file}" for r in near.select("file").distinct().orderBy("file").collect()]  # names of files
    schema = spark.read.parquet(f"{folder}/data").schema
    rows = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    return overlap_join(rows, asked)
