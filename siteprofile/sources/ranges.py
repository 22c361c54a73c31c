"""Files that many tasks read in ranges of bytes: one FASTA record, or one file of a byte per base, is spread over tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a range, letters of a piece, most bytes of a FASTA header line, and most tasks.
RANGE, PIECE, HEADER, TASKS = 32 << 20, 16_384, 65_536, 10_000
_SPACE = b" \t\r\n\x0b\x0c"


def byte_ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, start, stop, length): the files' ranges of at most size bytes, dealt to as many tasks. Only names and lengths are read. Empty files have none."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    each = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    return dealt(each.select("path", "start", F.least(F.col("start") + size, F.col("length")).alias("stop"), "length"))


def dealt(ranged: DataFrame) -> DataFrame:
    """Ranges in as many tasks as there are, TASKS at most."""
    return ranged.repartition(max(1, min(ranged.count(), TASKS)))


def read(path: str, start: int, stop: int) -> bytes:
    """Bytes of a file in any store that pyarrow has a file system for (local, hdfs, s3, gs, abfs)."""
    system, name = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    with system.open_input_file(name) as f:
        return f.read_at(stop - start, start)


def mappability(spark: SparkSession, folder: str, size: int = RANGE) -> DataFrame:
    """(chrom, pos, value) of a folder with one file per chromosome and one byte per base; the name up to its last full stop is the chromosome."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^/.]*)?$", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for chrom, path, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for low in range(start, stop, 1 << 16):
                    value = np.frombuffer(read(path, low, min(low + (1 << 16), stop)), "u1").astype("i4")
                    pos = np.arange(low + 1, low + 1 + len(value))
                    yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(value)), pa.array(pos, pa.int64()), pa.array(value)], ["chrom", "pos", "value"])

    ranged = byte_ranges(spark, folder, size).select(stem.alias("chrom"), "path", "start", "stop")
    return ranged.mapInArrow(run, "chrom string, pos long, value int")


def segments(path: str, start: int, stop: int, length: int) -> Iterator[tuple[str | None, bytes]]:
    """(name, letters) of the parts of FASTA records in a range; the first part, which goes on from the range before, has no name.

    A header belongs to the range in which its line starts. What the range starts in, and where a header at its end ends,
    is seen from HEADER bytes on both sides.
    """
    low = max(0, start - HEADER)
    held = read(path, low, min(length, stop + HEADER))
    begin, end = start - low, stop - low
    line = held.rfind(b"\n", 0, begin) + 1
    if begin and (line or not low) and line < begin and held[line : line + 1] == b">":
        begin = min(end, held.find(b"\n", begin) % (len(held) + 1))  # within a header
    clean = lambda a, b: held[a:b].translate(None, _SPACE).upper()
    name, at = None, begin
    for found in re.finditer(rb"(?m)^>", held):
        head = found.start()
        if not begin <= head < end:
            continue
        yield name, clean(at, head)
        close = held.find(b"\n", head) % (len(held) + 1)
        name = (held[head + 1 : close].split() or [b""])[0].decode("utf-8", "replace")
        at = min(close, end)
    yield name, clean(at, end)


def fasta(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(chrom, at, piece, len): the letters of FASTA records, upper case, in pieces of at most PIECE that start at position at (1-based); len is that of the record.

    Pass one counts the letters of each record in each range; running sums over a row for each range and record give where
    each range starts. Pass two reads the ranges again and cuts them at multiples of PIECE. contexts.chunked() puts pieces
    together to chunks. Text before the first header is left out.
    """
    ranged = byte_ranges(spark, path, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [(name, len(letters)) for name, letters in segments(*own)]
                n = len(parts)
                columns = [[own[0]] * n, [own[1]] * n, list(range(n)), [p[0] for p in parts], [p[1] for p in parts]]
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "start", "part", "name", "n"])

    parts = ranged.mapInArrow(count, "path string, start long, part int, name string, n long")
    file = Window.partitionBy("path").orderBy("start", "part")
    parts = parts.withColumn("record", F.sum(F.col("name").isNotNull().cast("long")).over(file)).withColumn("chrom", F.last("name", True).over(file))
    record = Window.partitionBy("path", "record")
    before = F.coalesce(F.sum("n").over(record.orderBy("start", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("at", before).withColumn("len", F.sum("n").over(record))
    placed = parts.groupBy("path", "start").agg(F.array_sort(F.collect_list(F.struct("part", "chrom", "at", "len"))).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *own, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for (_, letters), place in zip(segments(*own), places, strict=True):
                    if place["chrom"] is None or not letters:
                        continue
                    at, edges = place["at"], [0]
                    while edges[-1] < len(letters):
                        edges.append(min(len(letters), ((at + edges[-1]) // PIECE + 1) * PIECE - at))
                    for low in range(0, len(edges) - 1, 256):
                        some = edges[low : low + 257]
                        n = len(some) - 1
                        texts = [letters[a:b].decode("latin-1") for a, b in zip(some, some[1:], strict=False)]
                        columns = [[place["chrom"]] * n, [at + a + 1 for a in some[:-1]], texts, [place["len"]] * n]
                        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chrom", "at", "piece", "len"])

    both = dealt(ranged.join(placed, ["path", "start"]).select("path", "start", "stop", "length", "parts"))
    return both.mapInArrow(cut, "chrom string, at long, piece string, len long")
