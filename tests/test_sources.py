import gzip

import pytest

from siteprofile.sources import readers, sinks


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    with gzip.open(tmp_path / "caller.tsv.gz", "wt") as f:
        f.write("a\tb\tc\td\te\tf\tg\th\nchrI\t7\tG\t+\tAAA\t20\t0.25\t0.75\n")
    assert [(r.chrom, r.pos, r.value) for r in readers.caller(spark, str(tmp_path / "caller.tsv.gz")).collect()] == [("chrI", 7, 0.5)]
    with pytest.raises(ValueError, match="8, 13, 14"):
        readers.caller(spark, put("bad.tsv", "a\tb\n"))
    assert readers.genome_length(readers.chrom_sizes(spark, put("sizes", "chrI\t100\nchrII\t50\n"))).first().len == 150
    n = readers.nucleosomes(spark, put("nuc.bed", "h\th\th\th\th\nchrI\t1\t2\t0.1\t0.2\nchrI\t3\t4\t0.1\t0.2\n")).orderBy("id").collect()
    assert [(r.id, r.end) for r in n] == [(0, 2), (1, 4)]
    fa = readers.fasta(spark, put("g.fa", ">chrI some words\nacgt\nAC\n>chrII\nNNA\n")).orderBy("chrom").collect()
    assert [tuple(r) for r in fa] == [("chrI", "ACGTAC"), ("chrII", "NNA")]
    both = readers.origins(spark, put("o.csv", "Chromosome\tOrigin\tStart\tEnd\tTiming\nchrI\tx\t1\t9\tEarly\n"), put("n.csv", "Chromosome\tStart\tEnd\nchrII\t3\t5\n"))
    assert sorted((r.chrom, r.start, r.Timing, r.feature_type) for r in both.collect()) == [("chrI", 1, "Early", "origin"), ("chrII", 3, None, "ndr")]
    (tmp_path / "map").mkdir()
    (tmp_path / "map" / "chrI.bin").write_bytes(bytes([0, 200, 1]))
    assert sorted(tuple(r) for r in readers.mappability(spark, str(tmp_path / "map")).collect()) == [("chrI", 1, 0), ("chrI", 2, 200), ("chrI", 3, 1)]
    pair = readers.strand_pair(spark, [put("p.bed", "c\t1\t2\ti\t3\n")], [put("m.bed", "c\t5\t6\tj\t4\n")])
    assert {(r.pos, r.strand) for r in pair.collect()} == {(2, "+"), (6, "-")}
    assert readers.replicates(spark, [put("r1.bed", "c\t1\t2\tA\t+\n"), put("r2.bed", "c\t1\t2\tA\t+\nc\t1\t2\tA\t-\n")]).count() == 2
    assert readers.bedgraph(spark, put("b.bg", "c\t1\t2\t0.5\nc\t2\t3\t\n")).count() == 1
    t = readers.transcripts(spark, put("t.tsv", "Chromosome/scaffold name\tStrand\tTranscription start site (TSS)\tTranscript start (bp)\tTranscript end (bp)\tGene name\nI\t1\t5\t5\t9\tg\nI\t-1\t9\t5\t9\t\n"))
    assert [(r.tss, r.gene) for r in t.collect()] == [(5, "g")]
    d = readers.detector(spark.createDataFrame([("Mito", 5, "+", "x: 2.0"), ("I", 6, "-", "y: 0")], "chrm string, end long, strand string, reg_text string")).collect()
    assert [(r.chrom, r.pos, r.pvalue) for r in d] == [("chrM", 5, pytest.approx(0.01)), ("chrI", 6, 1.0)]


def test_reads(spark):
    rows = [("c", 10, 20, False, True, False, 99), ("c", 0, 20, False, True, False, 99), ("c", 10, 20, True, True, False, 99), ("c", 10, 99, True, True, False, 99), ("c", 5, 9, False, False, False, 99), ("c", 5, 9, False, True, True, 99)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, is_reverse boolean, is_read1 boolean, is_secondary boolean, chrom_len long")
    assert {tuple(r) for r in readers.read_sites(df).collect()} == {("c", 9, "+"), ("c", 21, "-")}


def test_sinks(spark, tmp_path):
    sites = spark.createDataFrame([("c2", 9, "+"), ("c1", 5, "-"), ("c1", 5, "-")], "chrom string, pos long, strand string")
    sinks.write_bed(sites, str(tmp_path / "bed"), spark.createDataFrame([("c2", 0), ("c1", 1)], "chrom string, ordinal int"))
    assert [r.value for r in spark.read.text(str(tmp_path / "bed")).collect()] == ["c2\t8\t9\t+", "c1\t4\t5\t-"]
    long = spark.createDataFrame([("ACG", "a", 0.5), ("ACG", "b", 0.25)], "context string, name string, v double")
    sinks.write_wide(long, str(tmp_path), "signatures", "context", "name", "v")
    assert spark.read.options(sep="\t", header=True).csv(str(tmp_path / "signatures.tsv")).columns == ["context", "a", "b"]
    sinks.write_tsv(long, str(tmp_path / "z"), "gzip")
    sinks.write_peak(spark.createDataFrame([(10.0, 4.0)], "peak double, snr double"), spark.createDataFrame([(0.5,)], "p_value double"), str(tmp_path))
    sinks.write_profile(spark.createDataFrame([(1, 2, 3.0, 0.5)], "position long, observed long, expected double, rel_inc double"), str(tmp_path))
    assert sinks.run_folder("x", 0.05, 10) == "x/pval_0.05_damage_10"


def test_streaming(spark, tmp_path):
    from siteprofile.streaming import profiles

    rows = [("ACG", f"2024-01-01 0{h}:10:00") for h in (1, 1, 2, 5)]
    spark.createDataFrame(rows, "context_3 string, ts string").selectExpr("context_3", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("context_3 string, ts timestamp").parquet(str(tmp_path / "in"))
    q = profiles.context_counts(stream, "context_3", "ts").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 1, 2]


def test_streamed_positions(spark, tmp_path):
    from siteprofile.streaming import profiles

    rows = [("c", p, "2024-01-01 01:10:00") for p in (10, 11, 1_100, 5_000)] + [("d", 10, "2024-01-01 01:10:00")]
    spark.createDataFrame(rows, "chrom string, pos long, ts string").selectExpr("chrom", "pos", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "in"))
    regions = spark.createDataFrame([(1, "c", 5, 1_200), (2, "c", 8, 12)], "id int, chrom string, start long, end long")
    stream = spark.readStream.schema("chrom string, pos long, ts timestamp").parquet(str(tmp_path / "in"))
    q = profiles.position_counts(stream, regions, "ts").writeStream.outputMode("complete").format("memory").queryName("positions").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.position, r.observed) for r in spark.table("positions").collect()} == {(5, 1), (6, 1), (1_095, 1), (2, 1), (3, 1)}
