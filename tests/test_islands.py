"""Runs of numbers, without a table of them in a task."""

import random

from siteprofile.operators import intervals


def test_islands_hold_no_table_of_runs(spark):
    rng = random.Random(2)
    rows = [(c, rng.randint(-40, 160)) for c in ("a", "b", None) for _ in range(150)] + [("a", None), ("d", 63), ("d", 64), ("d", 65)]
    got = intervals.islands(spark.createDataFrame(rows, "chrom string, pos long").repartition(3), ["chrom"], "pos", 16)
    want = []
    for c in {c for c, _ in rows}:
        v = sorted({p for d, p in rows if d == c and p is not None})
        cut = [0, *(i for i in range(1, len(v)) if v[i] != v[i - 1] + 1), len(v)]
        want += [(c, v[i], v[j - 1], j - i) for i, j in zip(cut, cut[1:])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 1  # of the runs at the ends of blocks
