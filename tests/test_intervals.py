import random

from pyspark.sql import functions as F

from siteprofile.operators import intervals


def test_overlap_join_against_nested_loops(spark):
    rng = random.Random(1)
    left = [(i, rng.choice("ab"), s := rng.randint(0, 500), s + rng.randint(1, 90)) for i in range(120)]
    right = [(i, rng.choice("abc"), s := rng.randint(0, 500), s + rng.randint(1, 300)) for i in range(60)]
    l, r = spark.createDataFrame(left, "i long, chrom string, start long, end long"), spark.createDataFrame(right, "j long, chrom string, start long, end long")
    want = {(a[0], b[0], min(a[3], b[3]) - max(a[2], b[2])) for a in left for b in right if a[1] == b[1] and min(a[3], b[3]) > max(a[2], b[2])}
    for broadcast in (True, False):
        for size in (16, 1024):
            rows = intervals.overlap_join(l, r, bin_size=size, broadcast=broadcast).select("i", "j", "overlap").collect()
            assert len(rows) == len(want) and {tuple(x) for x in rows} == want
            outer = intervals.overlap_join(l, r, "left", size, broadcast).select("i", "j", "overlap").collect()
            alone = {a[0] for a in left} - {w[0] for w in want}
            assert {tuple(x) for x in outer} == want | {(i, None, 0) for i in alone} and len(outer) == len(want) + len(alone)


def test_touching_intervals_do_not_overlap(spark):
    a = spark.createDataFrame([("c", 0, 10)], "chrom string, start long, end long")
    b = spark.createDataFrame([("c", 10, 20)], "chrom string, start long, end long")
    assert intervals.overlap_join(a, b).count() == 0


def test_windows_and_ends(spark):
    sizes = spark.createDataFrame([("c", 1000)], "chrom string, len long")
    assert [tuple(r) for r in intervals.chromosome_ends(sizes, 100).collect()] == [("c", 1, 101, "end"), ("c", 900, 1000, "end"), ("c", 102, 899, "middle")]
    regions = spark.createDataFrame([("c", 73), ("c", 74)], "chrom string, mid long")
    assert [(r.start, r.end) for r in intervals.windows(regions, F.col("mid"), 73, 74).collect()] == [(1, 148)]


def test_clean_overlaps_and_islands(spark):
    rows = spark.createDataFrame([(0, "a", 0, 100), (1, "a", 90, 200), (2, "a", 300, 400), (3, "b", 350, 360)], "row long, chrom string, start long, end long")
    assert sorted((r.row, r.start, r.end) for r in intervals.clean_overlaps(rows).collect()) == [(0, 0, 95), (1, 95, 200), (2, 300, 400), (3, 350, 360)]
    v = spark.createDataFrame([("a", x) for x in (1, 2, 2, 3, 7, 8, 10)], "k string, v long")
    assert sorted((r["first"], r["last"], r.n) for r in intervals.islands(v, ["k"], "v").collect()) == [(1, 3, 3), (7, 8, 2), (10, 10, 1)]


def test_neighbour_signal(spark):
    rows = [(0, "a", 300), (1, "a", 600), (2, "a", 860), (3, "b", 900), (4, "b", 1000), (5, "b", 5000)]
    wide = spark.createDataFrame(rows, "row long, chrom string, center long").withColumn("start", F.col("center") - 200).withColumn("end", F.col("center") + 200)
    want = {}
    for i in range(len(rows) - 1):
        c = rows[i]
        if c[1] == rows[i + 1][1] and c[2] + 74 >= rows[i + 1][2] - 200:
            for o in range(c[2] + 74 - rows[i + 1][2] + 200):
                want[o] = want.get(o, 0) + 1
        if i and c[1] == rows[i - 1][1] and c[2] - 73 <= rows[i - 1][2] + 200:
            for o in range(400 - rows[i - 1][2] - 200 + c[2] - 73, 400):
                want[o] = want.get(o, 0) + 1
    assert {r.offset: r.n for r in intervals.neighbour_signal(wide).collect()} == want
