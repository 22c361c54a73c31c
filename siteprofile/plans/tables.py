"""Genomic tables from the driver's: documents make the genome, lineitem the sites, orders the regions, labels a mask, events a signal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import letters

LETTERS, TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAN"
#: The base that each byte of a text becomes; 0 for what is no letter.
BASE = np.zeros(256, "u1")
BASE[[ord(x) for x in LETTERS + LETTERS.lower()]] = [ord(x) for x in TO + TO]
#: Bytes of whole texts that are sent to Python at a time.
BATCH_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The table dealt to all cores where its files are read by fewer tasks than there are; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spread(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chrom"), "lang", "text"))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, lang, seq: the letters of each whole text, as bases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = letters(batch.column(2))
            bases = BASE[data]
            is_letter = bases > 0
            before = np.concatenate([[0], np.cumsum(is_letter)])[at]
            seq = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(before.astype("i8")), pa.py_buffer(bases[is_letter]))
            seq = pc.if_else(batch.column(2).is_valid(), seq, None).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), seq], ["chrom", "lang", "seq"])

    rows = _texts(spark, sf_dir)
    return rows.mapInArrow(run, rows.withColumnRenamed("text", "seq").schema)


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, lang, len of the chromosomes that have a base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = letters(batch.column(2))
            before = np.concatenate([[0], np.cumsum(BASE[data] > 0)])[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(before))], ["chrom", "lang", "len"])

    rows = _texts(spark, sf_dir)
    return rows.mapInArrow(run, rows.select("chrom", "lang", F.lit(0).cast("long").alias("len")).schema).where("len > 0")


def _on_chromosomes(rows: DataFrame, spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    count = load(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("_n"))  # one row
    return rows.crossJoin(F.broadcast(count)).withColumn("chrom", F.col(key) % F.col("_n")).drop("_n").join(sizes(spark, sf_dir).select("chrom", "len"), "chrom")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, pos, strand, pvalue, value, reads, replicate, site_id."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_discount", "l_tax", "l_quantity")
    on = _on_chromosomes(rows, spark, sf_dir, "l_partkey")
    return on.select(
        "chrom",
        (1 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % F.col("len")).alias("pos"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
        ((F.col("l_discount") + F.col("l_tax")) / 2).alias("pvalue"),
        (F.col("l_discount") - F.col("l_tax")).alias("value"),
        F.col("l_quantity").alias("reads"),
        (F.col("l_linenumber") % 2).alias("replicate"),
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("site_id"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, chrom, len, center, class, sign (1 or -1)."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    on = _on_chromosomes(rows, spark, sf_dir, "o_custkey")
    return on.select(F.col("o_orderkey").alias("id"), "chrom", "len", (1 + F.col("o_orderkey") * 13 % F.col("len")).alias("center"), F.col("o_orderpriority").alias("class"), F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("sign"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").select(F.col("doc_id").alias("chrom"), F.col("quality").alias("flag"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, x): events by hour since the first day of 2024; hours without events are missing."""
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1704067200)) / 3600)
    return load(spark, sf_dir, "events").groupBy(hour.alias("i")).agg(F.count(F.lit(1)).cast("double").alias("x"))


#: The same tables for the oracle.
SQL = """
genome AS (SELECT doc_id AS chrom, lang, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAN') AS seq FROM documents),
sizes AS (SELECT chrom, lang, CAST(length(seq) AS BIGINT) AS len FROM genome WHERE length(seq) > 0),
n_docs AS (SELECT count(*) AS n FROM documents),
sites AS (
  SELECT s.chrom, 1 + (l_orderkey * 7 + l_linenumber * 131) % s.len AS pos, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
    (l_discount + l_tax) / 2 AS pvalue, l_discount - l_tax AS value, l_quantity AS reads, l_linenumber % 2 AS replicate, concat(l_orderkey, '_', l_linenumber) AS site_id
  FROM lineitem, n_docs JOIN sizes s ON s.chrom = l_partkey % n),
regions AS (
  SELECT o_orderkey AS id, s.chrom, s.len, 1 + o_orderkey * 13 % s.len AS center, o_orderpriority AS class, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS sign
  FROM orders, n_docs JOIN sizes s ON s.chrom = o_custkey % n),
mask AS (SELECT doc_id AS chrom, quality AS flag FROM labels),
hourly AS (SELECT CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS i, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY 1),
nuc AS (SELECT id, chrom, class, sign, center, center - 73 AS "start", center + 74 AS "end" FROM regions WHERE center - 73 > 0),
pairs AS (SELECT s.*, n.id, n.class, n."start" AS r_start, n."end" AS r_end FROM sites s JOIN nuc n ON s.chrom = n.chrom AND s.pos - 1 < n."end" AND n."start" < s.pos),
contexts AS (
  SELECT s.*, CASE WHEN w3 IS NULL OR length(w3) < 3 THEN '-' WHEN strand = '+' THEN w3 WHEN regexp_matches(w3, '^[ACGT]*$') THEN reverse(translate(w3, 'ACGT', 'TGCA')) ELSE '-' END AS c3,
    CASE WHEN w5 IS NULL OR length(w5) < 5 THEN '-' WHEN strand = '+' THEN w5 WHEN regexp_matches(w5, '^[ACGT]*$') THEN reverse(translate(w5, 'ACGT', 'TGCA')) ELSE '-' END AS c5,
    CASE WHEN strand = '+' THEN w1 WHEN w1 IN ('A', 'C', 'G', 'T') THEN translate(w1, 'ACGT', 'TGCA') END AS base
  FROM (SELECT sites.*, seq[pos:pos] AS w1, CASE WHEN pos > 1 THEN seq[pos - 1:pos + 1] END AS w3, CASE WHEN pos > 2 THEN seq[pos - 2:pos + 2] END AS w5 FROM sites JOIN genome USING (chrom)) s),
k3 AS (SELECT chrom, seq[i:i + 2] AS kmer FROM (SELECT chrom, seq, unnest(range(1, length(seq) - 1)) AS i FROM genome)),
k5 AS (SELECT chrom, seq[i:i + 4] AS kmer FROM (SELECT chrom, seq, unnest(range(1, length(seq) - 3)) AS i FROM genome)),
bg3 AS (SELECT kmer, count(*) AS n FROM k3 GROUP BY 1),
bg5 AS (SELECT kmer, count(*) AS n FROM k5 GROUP BY 1),
sig3 AS (
  SELECT context, coalesce(o / CAST(n AS DOUBLE), 0) AS ref_norm, coalesce(o / CAST(n AS DOUBLE), 0) / sum(o / CAST(n AS DOUBLE)) OVER () AS total_norm
  FROM (SELECT c3 AS context, count(*) AS o FROM contexts WHERE pvalue < 0.05 AND c3 <> '-' GROUP BY 1) LEFT JOIN bg3 ON kmer = context)
"""
