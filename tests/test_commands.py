"""Commands from files to files, and the readers and filters that only they use."""

import gzip
import json
import math
import random

import pytest

from siteprofile import commands
from siteprofile.functions.special import chi2_sf
from siteprofile.operators import reads, statistics, structures
from siteprofile.plans import pipelines
from siteprofile.sources import readers, store


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    rng = random.Random(3)
    seqs = {c: "".join(rng.choice("ACGT") for _ in range(3_000)) for c in ("chrI", "chrII")}

    def put(name, lines, header=None):
        (folder / name).write_text("\n".join(([header] if header else []) + lines) + "\n")
        return str(folder / name)

    sites = [(c, rng.randint(300, 2_700), rng.choice("+-")) for c in seqs for _ in range(400)]
    comp = str.maketrans("ACGT", "TGCA")

    def mer(c, p, s, half=10):
        w = seqs[c][p - 1 - half : p + half]
        return w if s == "+" else w.translate(comp)[::-1]

    rows = [f"{c}\t{p}\t{mer(c, p, s, 0)}\t{s}\t{mer(c, p, s)}\t20\t0.1\t0.4\t0.3\t{mer(c, p, s, 2)}\t{mer(c, p, s, 1)}" for c, p, s in sites]
    paths = {
        "genome": put("g.fa", [f">{c}\n{q}" for c, q in seqs.items()]),
        "damage": put("d.tsv", rows, "chrom\tpos\tbase\tstrand\tmer\tmin_coverage\tuntreated_freq\ttreated_freq\tvalue\tPENTAMER\tTRIPLET"),
        "nucleosomes": put("n.bed", [f"{c}\t{e - 1}\t{e}\t1\t1" for c in seqs for e in range(600, 2_500, 170)], "c\ts\te\ta\tb"),
        "detector": put("t.tsv", [f"{c[3:]}\t{p}\t{s}\tx: {rng.randint(2, 9)}" for c, p, s in sites], "chrm\tend\tstrand\treg_text"),
        "sizes": put("sizes", ["chrI\t3000", "chrII\t3000"]),
        "origins": put("o.csv", ["chrI\tx\t100\t900\tEarly", "chrII\ty\t100\t900\tLate"], "Chromosome\tOrigin\tStart\tEnd\tTiming"),
        "ndr": put("r.csv", ["chrI\t1000\t1900"], "Chromosome\tStart\tEnd"),
        "access": put("a.bed", [f"chrI\t{i}\t{i + 1}\t{i % 2}" for i in range(300, 2_700)]),
        "occupancy": put("p.bg", ["chrI\t300\t900\t1.5", "chrI\t900\t1500\t-1", "chrII\t300\t900\t"]),
        "transcripts": put("tr.tsv", ["I\t1\t1000\t1000\t1900\tg", "II\t-1\t1900\t1000\t1900\th"], "Chromosome/scaffold name\tStrand\tTranscription start site (TSS)\tTranscript start (bp)\tTranscript end (bp)\tGene name"),
        "reads": put("rd.tsv", ["chrI\t10\t20\tfalse\ttrue\tfalse\t3000", "chrI\t30\t50\ttrue\ttrue\tfalse\t3000"], "chrom\tstart\tend\tis_reverse\tis_read1\tis_secondary\tchrom_len"),
        "mass": put("m.tsv", ["m7G\t0.5", "m7G\t0.7"], "Residue\tDamage Proportion"),
        "old": put("old.tsv", ["chrI\t5\tG\t+\t0.01\t1"], "CHROM\tpos\tSEQ\tstrand\tp-value\tdiff"),
    }
    with gzip.open(folder / "c.tsv.gz", "wt") as f:
        f.write("a\tb\tc\td\te\tf\tg\th\n" + "".join(f"{c}\t{p}\t{mer(c, p, s, 0)}\t{s}\t{mer(c, p, s)}\t20\t0.1\t0.4\n" for c, p, s in sites))
    return paths | {"caller": str(folder / "c.tsv.gz"), "seqs": seqs, "sites": sites}


def table(spark, path):
    return spark.read.options(sep="\t", header=True, inferSchema=True).csv(str(path))


def test_enrichment_and_profiles(spark, data, tmp_path):
    run = lambda *words: commands.main([str(w) for w in words], spark)
    run("enrich-detector", "--input", data["detector"], "--genome", data["genome"], "--output", tmp_path, "--top", 500, "--excluded", "chrII")
    made = tmp_path / "pval_0.05_damage_500"
    sites = table(spark, made / "damage_most_sig_detector.tsv")
    assert {r.chrom for r in sites.select("chrom").distinct().collect()} == {"chrI"}
    for r in sites.limit(20).collect():
        q = data["seqs"][r.chrom][r.pos - 2 : r.pos + 1]
        assert r.context_3 == (q if r.strand == "+" else q.translate(str.maketrans("ACGT", "TGCA"))[::-1])
    run("enrich-detector", "--input", data["detector"], "--genome", data["genome"], "--output", tmp_path / "bh", "--bases", "G", "--alpha", 0.01, "--excluded")
    strict = table(spark, tmp_path / "bh" / "pval_0.05_damage_100000" / "damage_most_sig_detector.tsv")
    assert {r.base for r in strict.select("base").distinct().collect()} == {"G"}
    run("enrich-caller", "--input", data["caller"], "--genome", data["genome"], "--bases", "A", "C", "G", "T", "--output", tmp_path / "c")
    signature = tmp_path / "c" / "triplet_normalized_caller.tsv"
    assert abs(sum(r.TOTAL_NORM for r in table(spark, signature).collect()) - 1) < 1e-9
    run("nucleosome-profile", "--damage", data["damage"], "--nucleosomes", data["nucleosomes"], "--signature", signature, "--genome", data["genome"], "--output", tmp_path / "n")
    profile = table(spark, tmp_path / "n" / "exp_obs_relinc.tsv").collect()
    pairs = table(spark, tmp_path / "n" / "damage_in_nucleosomes.tsv")
    assert sum(r.Observed_damage for r in profile) == pairs.count() > 0 and [r.Position for r in profile] == sorted(r.Position for r in profile)
    run("linker-bases", "--damage", data["damage"], "--nucleosomes", data["nucleosomes"], "--genome", data["genome"], "--study", "GA", "--output", tmp_path / "l")
    assert table(spark, tmp_path / "l" / "coverage.tsv").count() == 400 and table(spark, tmp_path / "l" / "enrichment.tsv").count() > 0
    run("compare", "--left", signature, "--right", signature, "--output", tmp_path / "same")
    assert abs(table(spark, tmp_path / "same" / "cosine.tsv").first().cosine - 1) < 1e-9
    run("cosine-matrix", "--signatures", signature, signature, "--names", "x", "y", "--output", tmp_path / "m")
    assert [(r.x, r.y) for r in table(spark, tmp_path / "m" / "data_cosines.tsv").collect()] == [(1.0, 1.0)] * 2
    run("cosine-null", "--signature", signature, "--observed", 0.1, "--draws", 100, "--output", tmp_path / "null")
    assert table(spark, tmp_path / "null" / "null.tsv").first().share == 1.0
    run("centre-shares", "--signature", signature, "--output", tmp_path / "shares")
    assert sum(r.share for r in table(spark, tmp_path / "shares" / "shares.tsv").collect()) == pytest.approx(1, abs=0.03)


def test_structures_and_the_rest(spark, data, tmp_path):
    run = lambda *words: commands.main([str(w) for w in words], spark)
    run("structure", "--damage", data["damage"], "--genome", data["genome"], "--sizes", data["sizes"], "--origins", data["origins"], "--ndr", data["ndr"], "--accessibility", data["access"], "--occupancy", data["occupancy"], "--span", 500, "--output", tmp_path)
    rows = table(spark, tmp_path / "cosine_structure.tsv").collect()
    assert {r["DNA structure"] for r in rows} == {"Replication Origins", "Origins Early", "Origins Late", "Origins NDR", "Subtelomeric", "Non subtelomeric", "Open chromatin", "Close chromatin"}
    assert {r.Context for r in rows} == {"Triplet", "Pentamer"} and all(0 <= r["Cosine-similarity"] <= 1 + 1e-9 for r in rows)
    seen = {r.region_set: r.observed for r in table(spark, tmp_path / "observed_expected.tsv").collect()}
    assert seen["Origins Early"] == sum(c == "chrI" and 100 < p <= 900 for c, p, _ in data["sites"])
    assert {r.state for r in table(spark, tmp_path / "transcription_signature.tsv").collect()} == {"transcribed", "silent"}
    run("transcript-ends", "--damage", data["damage"], "--transcripts", data["transcripts"], "--genome", data["genome"], "--output", tmp_path / "t")
    assert table(spark, tmp_path / "t" / "tss.tsv").count() > 0
    run("read-sites", "--reads", data["reads"], "--genome", data["genome"], "--output", tmp_path / "r")
    q = data["seqs"]["chrI"]
    assert sorted((r.pos, r.base) for r in table(spark, tmp_path / "r" / "sites.tsv").collect()) == [(9, q[8]), (51, q[50].translate(str.maketrans("ACGT", "TGCA")))]
    run("merge-replicates", "--one", data["caller"], "--two", data["caller"], "--output", tmp_path / "m")
    assert table(spark, tmp_path / "m" / "alone.tsv").count() == 0 and table(spark, tmp_path / "m" / "merged.tsv").count() >= len(data["sites"])
    run("residues", "--table", data["mass"], "--output", tmp_path / "s")
    assert table(spark, tmp_path / "s" / "residues.tsv").first().mean == pytest.approx(0.6)


def test_commands_of_other_inputs(spark, data, tmp_path):
    """Strand pairs, replicates, wide windows, randomisation, bases in nucleosomes, older tables, domains, adapters, levels, stores."""
    run = lambda *words: commands.main([str(w) for w in words], spark)
    seqs, sites = data["seqs"], data["sites"]
    comp = str.maketrans("ACGT", "TGCA")
    (tmp_path / "plus.bed").write_text("".join(f"{c}\t{p - 1}\t{p}\tx\t{i % 11}\n" for i, (c, p, s) in enumerate(sites) if s == "+"))
    (tmp_path / "minus.bed").write_text("".join(f"{c}\t{p - 1}\t{p}\tx\t{i % 11}\n" for i, (c, p, s) in enumerate(sites) if s == "-"))
    run("enrich-strands", "--plus", tmp_path / "plus.bed", "--minus", tmp_path / "minus.bed", "--genome", data["genome"], "--quantile", 0.5, "--output", tmp_path / "s")
    kept = table(spark, tmp_path / "s" / "damage_most_sig_strands.tsv").collect()
    counts = sorted(i % 11 for i in range(len(sites)) if i % 11)
    assert len(kept) == sum(v > counts[len(counts) // 2] for v in counts) and {r.strand for r in kept} == {"+", "-"}
    for r in kept[:20]:
        q = seqs[r.chrom][r.pos - 2 : r.pos + 1]
        assert r.context_3 == (q if r.strand == "+" else q.translate(comp)[::-1])
    for n in (1, 2):
        (tmp_path / f"r{n}.bed").write_text("".join(f"{c}\t{p - 1}\t{p}\tG\t{s}\n" for c, p, s in sites[: 300 * n]))
    run("enrich-replicates", "--replicates", tmp_path / "r1.bed", tmp_path / "r2.bed", "--genome", data["genome"], "--output", tmp_path / "r")
    assert table(spark, tmp_path / "r" / "damage_most_sig_replicates.tsv").count() == len(set(sites[:600]))
    signature = tmp_path / "r" / "triplet_normalized_replicates.tsv"
    common = ("--damage", data["damage"], "--nucleosomes", data["nucleosomes"], "--genome", data["genome"])
    run("zoom-out", *common, "--signature", signature, "--output", tmp_path / "z")
    wide = table(spark, tmp_path / "z" / "exp_obs_relinc.tsv").collect()
    assert min(r.Position for r in wide) >= -500 and max(r.Position for r in wide) <= 500 and sum(r.Observed_damage for r in wide) > 0
    assert table(spark, tmp_path / "z" / "peak_snr.tsv").first().snr > 0
    run("randomise", *common, "--signature", signature, "--n-random", 30, "--output", tmp_path / "n")
    peak = table(spark, tmp_path / "n" / "peak_snr_pval_data.tsv").first()
    assert 5 <= peak.peak <= 50 and 1 / 31 - 1e-9 <= peak["p-value"] <= 1
    run("nucleosome-bases", *common, "--study", "G", "--output", tmp_path / "b")
    bases = table(spark, tmp_path / "b" / "enrichment.tsv").collect()
    assert 0 < len(bases) <= 147 and all(1 <= r.position <= 147 for r in bases)
    (tmp_path / "new.tsv").write_text("chrom\tpos\tbase\tstrand\tmer\tmin_coverage\tuntreated_freq\ttreated_freq\tvalue\n")
    run("convert", "--old", data["old"], "--new", tmp_path / "new.tsv", "--output", tmp_path / "v")
    made = table(spark, tmp_path / "v" / "damage_most_sig.tsv").first()
    assert (made.chrom, made.pos, made.base, made.mer, made.value) == ("chrI", 5, "G", "-", 0.01)
    run("context-domain", "--k", 3, "--centre", "G", "--output", tmp_path / "d")
    domain = [r.context for r in table(spark, tmp_path / "d" / "contexts.tsv").collect()]
    assert len(domain) == 16 and all(c[1] == "G" for c in domain)
    (tmp_path / "pairs.tsv").write_text("id\tseq1\tseq2\n1\tGATTACAGCAAAA\tCCCC\n2\tCCCCC\tTTTGATTACGCTT\n3\tAAAAAA\tCCCCCC\n")
    run("discard-adapters", "--pairs", tmp_path / "pairs.tsv", "--adapter", "GATTACAGC", "--rate", 0.12, "--output", tmp_path / "a")
    assert [r.id for r in table(spark, tmp_path / "a" / "discarded_misligated.tsv").collect()] == [3]
    levels = "".join(f"chrI\t+\t{p}\t{str(i % 2 == 0).lower()}\t{i % 7 + (3 if i % 2 else 0)}\n" for p in (5, 6) for i in range(60))
    (tmp_path / "levels.tsv").write_text("chrom\tstrand\tpos\ttreated\tlevel\n" + levels)
    run("two-sample", "--reads", tmp_path / "levels.tsv", "--output", tmp_path / "t")
    tested = table(spark, tmp_path / "t" / "sites.tsv").collect()
    assert {r.pos for r in tested} == {5, 6} and all(r.p_combined < r.p_ks < 0.05 and r.n_combined == 2 for r in tested)
    run("store-sites", "--damage", data["damage"], "--files", 5, "--output", tmp_path / "store")
    near = store.region(spark, str(tmp_path / "store"), "chrI", 1000, 1200)
    assert near.count() == sum(c == "chrI" and 1000 < p <= 1200 for c, p, _ in sites) and len(near.inputFiles()) < 5


def test_steps_with_switches_and_resume(spark, data, tmp_path):
    listed = [
        {"name": "sig", "command": "enrich-caller", "options": {"input": data["caller"], "genome": data["genome"], "bases": ["A", "C", "G", "T"]}},
        {"name": "off", "command": "residues", "on": False, "options": {"table": "nowhere"}},
        {"name": "same", "command": "compare", "options": {"left": "{output}/sig/triplet_normalized_caller.tsv", "right": "{output}/sig/triplet_normalized_caller.tsv"}},
    ]
    plan, out = tmp_path / "steps.json", tmp_path / "run"

    def run(*more):
        plan.write_text(json.dumps(listed))
        commands.main(["steps", "--file", str(plan), "--output", str(out), *more], spark)

    broken = listed.pop()
    listed.append({"name": "bad", "command": "residues", "options": {"table": "nowhere"}})
    with pytest.raises(Exception, match="nowhere"):
        run()
    assert (out / "sig" / "_done").exists() and not (out / "off").exists() and not (out / "bad" / "_done").exists()
    before = (out / "sig" / "_done").stat().st_mtime_ns
    listed[-1] = broken
    run("--resume", "1")
    assert (out / "sig" / "_done").stat().st_mtime_ns == before
    assert abs(table(spark, out / "same" / "cosine.tsv").first().cosine - 1) < 1e-9
    listed.append({"name": "same", "command": "compare"})
    with pytest.raises(ValueError):
        run("--resume", "1")


def test_known_p_values(spark):
    """Upper tails of the chi-square distribution with one degree of freedom, from tables."""
    known = [(0.0, 1.0), (0.455, 0.5), (2.706, 0.1), (3.841, 0.05), (6.635, 0.01), (10.828, 0.001)]
    rows = spark.createDataFrame([(g,) for g, _ in known], "g double").select("g", chi2_sf("g").alias("p")).collect()
    assert {r.g: r.p for r in rows} == {g: pytest.approx(p, rel=3e-3) for g, p in known}
    one = statistics.g_test(spark.createDataFrame([(60, 40.0), (50, 50.0), (0, 10.0)], "observed long, expected double")).collect()
    assert [r.g for r in one] == pytest.approx([2 * (60 * math.log(1.2) + 40 * math.log(0.8)), 0, 20 * math.log(2)])
    assert one[0].p_value == pytest.approx(0.0448, abs=5e-4) and one[1].p_value == 1.0


def test_small_readers_and_filters(spark, data, tmp_path):
    old = table(spark, data["old"])
    new = pipelines.detector_schema(old, ["chrom", "pos", "base", "strand", "mer", "min_coverage", "untreated_freq", "treated_freq", "value"])
    assert [tuple(r) for r in new.collect()] == [("chrI", 5, "G", "+", "-", 0, 0, 0, 0.01)]
    assert readers.damage(spark, data["damage"]).where("base is not null and context_3 is not null").count() == len(data["sites"])
    assert readers.accessibility(spark, data["access"]).where("counts > 0").count() == 1_200
    (tmp_path / "genes.bed").write_text("chrI\t5\t9\tg\t\t+\n")
    assert tuple(readers.genes(spark, str(tmp_path / "genes.bed")).first())[:4] == ("chrI", 5, 9, "g")
    (tmp_path / "sig.tsv").write_text("CONTEXT\tREF_NORM\tTOTAL_NORM\nACG\t0.5\t1.0\n")
    assert tuple(readers.signature(spark, str(tmp_path / "sig.tsv")).first()) == ("ACG", 0.5, 1.0)
    assert [r.residue for r in readers.mass_spec(spark, data["mass"]).collect()] == ["m7G", "m7G"]
    sweep = statistics.alpha_sweep(spark, [0.25] * 4, [0.5, 50.0], 200).orderBy("alpha").collect()
    assert sweep[0].mean_cosine < sweep[1].mean_cosine and sweep[1].share == 1.0
    rows = spark.createDataFrame([("chr1", 1), ("chrUn", 2)], "chrom string, n int")
    assert [r.n for r in reads.on_chromosomes(rows, ["chr1"]).collect()] == [1]
    strands = spark.createDataFrame([(1, "+"), (2, "-")], "n int, strand string")
    assert [[r.n for r in structures.on_strand(strands, t).collect()] for t in ("plus", "minus", "both")] == [[1], [2], [1, 2]]


def test_null_model_of_arrays_and_positions(spark):
    shares = [0.1, 0.2, 0.3, 0.4]
    groups = [(i, "+", n) for i, n in enumerate((1, 3, 150))]
    arrays = spark.createDataFrame([(*g, shares) for g in groups] + [(9, "-", 2, None)], "id long, strand string, n long, ps array<double>")
    long = spark.createDataFrame([(*g, j + 1, p) for g in groups for j, p in enumerate(shares)], "id long, strand string, n long, position long, p double")
    one, two = ({(r.replicate, r.position): r.n for r in statistics.multinomial_null(x, 200).collect()} for x in (arrays, long))
    assert one == two and sum(one.values()) == 200 * 154
    assert abs(sum(n for (_, p), n in one.items() if p == 4) / (200 * 154) - 0.4) < 0.02
