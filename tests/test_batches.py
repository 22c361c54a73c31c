"""What the tasks count in batches of bytes, against plain loops, and plans that keep single k-mers and positions out of the shuffles."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siteprofile.functions import arrays
from siteprofile.operators import contexts, profiles, statistics
from siteprofile.plans import tables


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def words(n: int, seed: int, letters: str = "ACGTN") -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.choice((0, 1, 2, 5, 60)))) for _ in range(n)]


@pytest.mark.parametrize("k", [1, 3, 5, 14])
def test_kmer_table(k):
    seqs = words(80, k) + ["", "ACGZ" * 9]
    labels = np.array([i % 3 for i in range(len(seqs))])
    column = pa.array(["skipped", *seqs, None])[1:]
    for label in (np.append(labels, 0), None):
        want = Counter((int(labels[r]) if label is not None else i, s[i : i + k]) for r, s in enumerate(seqs) for i in range(len(s) - k + 1))
        got = arrays.kmer_table(column, k, label)
        assert {(int(a), b): int(n) for a, b, n in zip(*got, strict=True)} == want


def test_counts_of_kmers_by_keys_and_offsets(spark, monkeypatch):
    monkeypatch.setattr(contexts, "HELD", 5)
    rows = [(None if i % 4 == 0 else f"c{i % 4}", i % 2, s) for i, s in enumerate(words(60, 9))] + [("c1", 0, None)]
    df = spark.createDataFrame(rows, "a string, b int, seq string").repartition(3)
    got = contexts.kmer_counts(df, 3, ["a", "b"])
    want = Counter((a, b, s[i : i + 3]) for a, b, s in rows if s for i in range(len(s) - 2))
    assert {(r.a, r.b, r.kmer): r.n for r in got.collect()} == want
    even = spark.createDataFrame([(s,) for s in ("ACGT", "AAGT", "NCGT")], "seq string")
    comp = profiles.composition(even, 2)
    assert {(r.offset, r.kmer): r.n for r in comp.collect()} == Counter((i, s[i : i + 2]) for s in ("ACGT", "AAGT", "NCGT") for i in range(3))
    assert "Generate" not in plan(got) and "Generate" not in plan(comp)


def test_genome_of_any_text(spark, tmp_path):
    texts = ["Az zéßıK\n\0xY", "", None, "123 \U0001f600", "Hello, World" * 50]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = {i: None if t is None else re.sub("[^A-Za-z]", "", t).upper().translate(str.maketrans(tables.LETTERS, tables.TO)) for i, t in enumerate(texts)}
    got = tables.genome(spark, str(tmp_path))
    assert {r.chrom: r.seq for r in got.collect()} == plain and "regexp" not in plan(got)
    assert {r.chrom: r.len for r in tables.sizes(spark, str(tmp_path)).collect()} == {i: len(s) for i, s in plain.items() if s}


def test_expected_profile_in_the_tasks(spark):
    rng = random.Random(5)
    genome = {c: "".join(rng.choices("ACGTNR", [6, 6, 6, 6, 1, 1], k=400)) for c in "ab"} | {"c": "R" * 300}
    sig = {x: rng.random() for x in {genome["a"][i : i + 3] for i in range(200)} if set(x) <= set("ACGTN")}
    groups = [(i, s, c, rng.choice((1, 2, 40, 250, 351)), rng.randint(1, 9)) for i in range(60) for s in "+-" for c in "abc"]
    groups = [(10 * i + ord(c), s, c, w, n) for i, s, c, w, n in groups]
    want = [0.0] * 50
    for _, strand, c, start, n in groups:
        s = genome[c][start - 2 : start + 50] if start > 1 else ""
        if len(s) < 52:
            continue
        s = s.translate(str.maketrans("ACGT", "TGCA"))[::-1] if strand == "-" else s
        p = [sig.get(s[i : i + 3], 0.0) for i in range(50)]
        for i, x in enumerate(p if sum(p) else ()):
            want[i] += x / sum(p) * n
    rows = spark.createDataFrame(groups, "id long, strand string, chrom string, win_start long, n long")
    seqs = spark.createDataFrame(list(genome.items()), "chrom string, seq string")
    sig = spark.createDataFrame(list(sig.items()), "context string, total_norm double")
    once = profiles.expected_of(profiles.sequenced(rows, seqs, 50), sig, 50)
    twice = profiles.expected(profiles.window_probabilities(rows, seqs, sig, 50, arrays=True))
    for got in (once, twice):
        assert [r.expected for r in got.orderBy("position").collect()] == pytest.approx(want)
    assert "posexplode" not in plan(once)


def test_few_draws_follow_their_shares():
    rng = np.random.default_rng(3)
    p = rng.random((40, 30)) * (rng.random((40, 30)) < 0.6)
    p[0], p[1], p[2] = 0, 0, 1e-6
    p[0, 29], p[1, 0], p[2, 7] = 1, 1, 1
    n, seeds = rng.integers(1, 7, 40), rng.integers(0, 1 << 62, 40)
    total = np.zeros((999, 30), "i8")
    statistics.few_draws(seeds, n, p, 999, total)
    p /= p.sum(1, keepdims=True)
    assert (total.sum(1) == n.sum()).all() and (total[:, (p > 0).sum(0) == 0] == 0).all()
    mean, spread = n @ p, n @ (p * (1 - p))
    assert (np.abs(total.mean(0) - mean) < 4.5 * np.sqrt(spread / 999)).all()
    assert (np.abs(total.var(0) / spread - 1) < 0.25).all()
    parts = np.zeros_like(total)
    for r in range(40):
        statistics.few_draws(seeds[r : r + 1], n[r : r + 1], p[r : r + 1], 999, parts)
    assert (parts == total).all()
    alone = np.zeros((999, 30), "i8")
    statistics.few_draws(seeds[:2], n[:2], p[:2], 999, alone)
    assert alone[:, [0, 29]].sum(0).tolist() == [999 * n[1], 999 * n[0]]
