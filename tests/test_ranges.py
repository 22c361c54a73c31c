"""Sources that split one file, and the sorted store."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteprofile.operators import contexts
from siteprofile.sources import ranges, readers, store


def small_fasta(rng):
    records = {f"chr{i}": "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 30, 400, 90_000]))) for i in range(14)}
    text = "; a comment before\n"
    for i, (name, seq) in enumerate(records.items()):
        width = rng.choice([7, 60, 10**6])
        end = rng.choice(["\n", "\r\n"])
        text += f">{name} described at {'length ' * (i * 9)}{end}" + "".join((seq[j : j + width].lower() if i % 2 else seq[j : j + width]) + end for j in range(0, len(seq), width))
    return records, text


@pytest.mark.parametrize("size", [37, 1000, 1 << 20])
def test_fasta_in_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    records, text = small_fasta(rng)
    if size == 37:  # every byte is an edge of a range somewhere
        records = {k: v for k, v in records.items() if len(v) < 1000}
        text = "".join(f">{k} and more\n{v[:50]}\n{v[50:]}\n" for k, v in records.items())
    (tmp_path / "g.fa").write_bytes(text.encode())
    (tmp_path / "empty.fa").write_bytes(b"")
    got = ranges.fasta(spark, f"file://{tmp_path}", size)
    rows = got.collect()
    joined = {}
    for r in sorted(rows, key=lambda r: (r.chrom, r.at)):
        assert r.at == len(joined.setdefault(r.chrom, "")) + 1 and len(r.piece) <= ranges.PIECE
        joined[r.chrom] += r.piece
        assert r.len == len(records[r.chrom])
    assert joined == {k: v for k, v in records.items() if v}
    if size == 1000:
        genome = spark.createDataFrame(list(records.items()), "chrom string, seq string")
        for chunk, halo in ((500, 40), (16_384, 1_100)):
            plain = {tuple(r) for r in contexts.chunked(genome, chunk, halo).collect()}
            assert {tuple(r) for r in contexts.chunked(got, chunk, halo).collect()} == plain
        for k, spans in ((3, False), (5, True)):
            counts = [sorted(map(tuple, contexts.genome_kmer_counts(g, k, spans).collect())) for g in (got, genome)]
            assert counts[0] == counts[1]
        sites = spark.createDataFrame([("chr1", 5, "+"), ("chr1", 5, "-"), ("chr9", 1, "+")], "chrom string, pos long, strand string")
        assert sorted(map(str, contexts.annotate(sites, got).collect())) == sorted(map(str, contexts.annotate(sites, genome).collect()))


def test_one_record_of_100_mb_is_read_by_many_tasks(spark, tmp_path):
    n = 100 << 20
    letters = np.frombuffer(b"ACGT", "u1")[np.random.default_rng(1).integers(0, 4, n, dtype="u1")].tobytes()
    (tmp_path / "one.fa").write_bytes(b">chr1 whole\n" + letters + b"\n")
    got = ranges.fasta(spark, f"file://{tmp_path}/one.fa", 8 << 20)
    assert ranges.byte_ranges(spark, f"file://{tmp_path}/one.fa", 8 << 20).count() == 13
    tasks = got.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.length("piece")).alias("n"), F.max("len").alias("len")).collect()
    assert len(tasks) > 4 and sum(r.n for r in tasks) == n and {r.len for r in tasks} == {n}
    for at, piece in got.where("at % 4194304 = 1").select("at", "piece").collect():
        assert piece == letters[at - 1 : at - 1 + len(piece)].decode()


def test_mappability_in_ranges(spark, tmp_path):
    rng = random.Random(4)
    for name, n in (("chrI.uint8", 150_000), ("chrII.x.uint8", 10), ("chrIII", 0)):
        (tmp_path / name).write_bytes(bytes(rng.randrange(256) for _ in range(n)))
    got = ranges.mappability(spark, f"file://{tmp_path}", 40_000)
    plain = readers.mappability(spark, f"file://{tmp_path}")
    assert got.count() == 150_010 and got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_store_opens_only_files_that_a_region_touches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice("aab"), s := rng.randrange(100_000), s + rng.choice([1, 50, 50, 400])) for i in range(20_000)]
    rows += [(20_000, "a", 10, 99_000), (20_001, None, 1, 2), (20_002, "a", None, 2)]
    table = spark.createDataFrame(rows, "id long, chrom string, start long, end long")
    folder = f"file://{tmp_path}/store"
    store.write(table, folder, files=40)
    n = store.index(spark, folder).select("file").distinct().count()
    assert n > 30 and store.index(spark, folder).agg(F.sum("n")).first()[0] == len(rows)
    for chrom, start, end in (("a", 500, 520), ("b", 0, 1), ("a", 50_000, 60_000), ("b", 99_999, 10**6), ("c", 0, 10)):
        got = store.region(spark, folder, chrom, start, end)
        want = sorted(r[0] for r in rows if r[1] == chrom and r[2] is not None and r[2] < end and r[3] > start)
        assert sorted(r.id for r in got.collect()) == want
        assert len(got.inputFiles()) <= (0 if chrom == "c" else 5 if end - start < 1000 else 9) or chrom == "c"
        assert len(store.files_of(spark, folder, chrom, start, end)) == len(set(got.inputFiles())) or chrom == "c"
    asked = spark.createDataFrame([("a", 100, 200, 1), ("b", 5000, 5100, 2), ("c", 1, 5, 3)], "chrom string, start long, end long, k long")
    pairs = store.regions(spark, folder, asked)
    want = sorted((r[0], k) for r in rows for c, s, e, k in (("a", 100, 200, 1), ("b", 5000, 5100, 2)) if r[1] == c and r[2] is not None and r[2] < e and r[3] > s)
    assert sorted((r.id, r.k) for r in pairs.collect()) == want and len(pairs.inputFiles()) < 10
    assert store.regions(spark, folder, asked.where("k = 3")).collect() == []
