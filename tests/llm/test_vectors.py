"""Exact clustering and vector codes against plain Lloyd iterations in whole numbers, and the compression classifier."""

import hashlib
import math
import random

import pytest

from siteprofile.llm import classifier, clustering, codes, lloyd

VECTORS = "vec_id long, embedding array<double>, label int, cluster int, slot string, row int"


def vector_rows(dim, n=300, seed=1, wide=True):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, 0.05) for m in rng.choice(middles)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(n + i, rows[5][1], 3) for i in range(40)]  # repeated vectors
    rows += [(7, rows[9][1], 1), (7, rows[9][1], 1), (None, rows[2][1], None)]  # repeated and null ids
    rows += [(n + 100 + i, [float(rng.randint(-2, 2)) / 1024 for _ in range(dim)], 4) for i in range(60)]  # ties
    if wide:
        rows += [(n + 200, [3e30] * dim, 5), (n + 201, [-3e9] + [0.0] * (dim - 1), None), (n + 202, [1e7] * dim, 5)]
    rows += [(n + 300, None, 1), (n + 301, [0.1] * (dim - 1), 1), (n + 302, [0.1] * (dim - 1) + [None], 1), (n + 303, [0.1] * (dim - 1) + [float("nan")], 1)]
    rows += [(n + 304, [math.inf] * dim, 1), (n + 305, [], 1), (n + 306, [1.7e308] * dim, 1)]
    return [(*r, 9, "clash", 9) for r in rows]


def kept(rows, dim, scale=1024.0):
    def ok(v):
        return v is not None and len(v) == dim and all(x is not None and math.isfinite(x * scale) for x in v)

    return [(i, [math.floor(x * scale) for x in v], label) for i, v, label, *_ in rows if ok(v)]


def lloyd_rounds(points, table, rounds):
    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(table)) for x in points]

    for _ in range(rounds):
        own = [j for _, j in assign()]
        for j in range(len(table)):
            if members := [x for x, o in zip(points, own, strict=True) if o == j]:
                table = [*table[:j], [sum(c) // len(members) for c in zip(*members, strict=True)], *table[j + 1 :]]
    return table, assign()


def cap(x):
    return min(x, lloyd.MOST)


@pytest.mark.parametrize(("k", "wide"), [(4, True), (9, False), (1, False), (600, False)])
def test_clustering(spark, k, wide):
    rows = vector_rows(6, n=150 if k == 600 else 300, wide=wide)
    rounds = 2 if k == 600 else 6
    points = kept(rows, 6)
    ranked = sorted(points, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    table, own = lloyd_rounds([x for _, x, _ in points], [x for _, x, _ in ranked[:k]], rounds)
    done = clustering.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), k=k, rounds=rounds, dim=6)
    assert done.centroids == table
    got = clustering.report(done).collect()
    want = [(i, c, cap(d)) for (i, _, _), (d, c) in zip(points, own, strict=True)]
    assert sorted(((r.id, r.cluster, r.distance) for r in got), key=str) == sorted(want, key=str)
    sums = {}
    for d, c in own:
        sums[c] = sums.get(c, 0) + cap(d)
    assert {(r.cluster, r.cluster_inertia, r.inertia) for r in got} == {(c, cap(s), cap(sum(map(cap, sums.values())))) for c, s in sums.items()}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, table[r.cluster])).encode()).hexdigest() for r in got)
    if k == 9:  # bounds spare most distances once centroids settle
        assert done.taken[0] == len(points) * k and done.taken[-1] < done.taken[0] / 4


def test_bounds_narrow_and_follow():
    """The states of vectors that moved centroids follow are those that a scan would give: clusters equal, bounds on the right side."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.integers(-500, 500, (400, 5)).astype(float)
    c = rng.integers(-500, 500, (12, 5)).astype(float)
    own, upper, near, lower = clustering.scan(x, c, 4)
    for b in (4, 3, 3, 2, 1):
        new = c + rng.integers(-40, 40, c.shape)
        near, lower = clustering.narrowed(near, lower, b)
        clustering.follow(x, new, lloyd.moved(c.astype(int).tolist(), new.astype(int).tolist()), own, upper, near, lower)
        c, d = new, np.sqrt(lloyd.squared(x, new))
        assert (own == d.argmin(1)).all() and (upper >= d.min(1)).all()
        assert (lower[:, :b] <= np.take_along_axis(d, near, 1)).all()
        rest = np.ones(d.shape, bool)
        np.put_along_axis(rest, near, False, 1)
        rest[np.arange(len(x)), own] = False
        assert (lower[:, b] <= np.where(rest, d, np.inf).min(1)).all()


@pytest.mark.parametrize(("entries", "wide"), [(16, False), (5, True), (256, False)])
def test_codes(spark, entries, wide):
    rows = vector_rows(8, n=120, seed=2, wide=wide)
    points = kept(rows, 8)
    first = sorted(points, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books, own = zip(*(lloyd_rounds([x[p : p + 2] for _, x, _ in points], [x[p : p + 2] for _, x, _ in first], 3) for p in (0, 2, 4, 6)), strict=True)
    done = codes.encode(spark.createDataFrame(rows, VECTORS).repartition(4), parts=4, entries=entries, rounds=3, dim=8)
    assert done.codebooks == list(books)
    want, sums = [], {}
    for n, (i, _, label) in enumerate(points):
        error = cap(sum(part[n][0] for part in own))
        sums[label] = sums.get(label, 0) + error
        want.append((i, label, "".join(f"{part[n][1]:02x}" for part in own), error))
    want = [(*w, cap(sums[w[1]])) for w in want]
    got = codes.report(done).select("row.vec_id", "row.label", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(v) for t in books for c in t for v in c).encode()).hexdigest()}
    if entries == 16:
        assert done.taken[-1] < done.taken[0] / 2


def test_bounds_of_codes():
    """Bounds stay under the distances through rounds of rounding, and codes are those of a scan, ties included."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (500, 4)).astype(float)
    book = rng.integers(-300, 300, (40, 4)).astype(float)
    book[7] = book[3]
    code, upper, lower = codes.scan(x, book)
    lower = codes.held(lower).astype("f4")
    for _ in range(6):
        new = book + rng.integers(-9, 9, book.shape)
        new[7] = new[3]
        codes.follow(x, new, lloyd.moved(book.astype(int).tolist(), new.astype(int).tolist()), codes.halves(new), code, upper, lower)
        book, d = new, lloyd.squared(x, new)
        assert (code == d.argmin(1)).all() and (upper >= np.sqrt(d.min(1))).all() and (lower <= np.sqrt(d)).all()
        lower = codes.held(lower).astype("f4")
    big = np.array([[0.1, 65504.0, 1e30, 3.3333]])
    assert (codes.held(big).astype("f8") <= big).all()


def test_no_vectors(spark):
    for rows in ([], [(1, None, None, 9, "a", 9), (2, [float("nan")] * 4, None, 9, "a", 9)]):
        table = spark.createDataFrame(rows, VECTORS)
        assert clustering.report(clustering.cluster(table, dim=4)).collect() == []
        assert codes.report(codes.encode(table, dim=4)).collect() == []
    with pytest.raises(ValueError):
        codes.encode(table, dim=5)


def labelled(spark, n=400):
    rng = random.Random(3)
    good = ["river", "stone", "walks", "under", "the", "quiet", "bridge", "and", "sings"]
    rows, labels = [], []
    for i in range(n):
        q = int(rng.random() < 0.7)
        words = [rng.choice(good) for _ in range(rng.randint(5, 200))]
        rows.append((i, " ".join(words) if q else " ".join(w.upper() + "!!" for w in words), "l", "s", 0, 9, "clash", "clash"))
        if i % 4:
            labels.append((i, q, 0))
    more = [(n, None), (n + 1, ""), (None, "the river"), (n + 2, "the quiet bridge " * 60_000)]
    rows += [(i, text, "l", None, 0, 9, "c", "c") for i, text in more]
    rows += [rows[0], rows[0]]
    labels += [(1, 0, 0), (1, 1, 0), (None, 1, 0), (2, None, 0), (3, 7, 0), (n + 9, 1, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, difference string, keep string"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_classifier(spark):
    import zlib

    docs, labels, rows, marks = labelled(spark)
    model = classifier.train(docs, labels)
    assert model == classifier.train(docs.repartition(5), labels.repartition(3))
    taught = {r.id for r in classifier.lessons(labels, "doc_id", "quality").collect()}
    assert taught == {i for i, q, _ in marks if i is not None and q in (0, 1) and i != 1 and zlib.crc32(str(i).encode()) % 3 != 1} - {1}
    got = classifier.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    both = classifier.compressor(model.good), classifier.compressor(model.bad)
    for r in got[:20] + got[-6:]:
        x = model.base + model.slope * classifier.difference(*both, (r.row.text or "").encode())
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-700, min(700, x)))))
    truth = {i: q for i, q, _ in marks if i not in (1, 2, 3)}
    held = [(r.score >= 0.5) == truth[r.row.doc_id] for r in got if r.row.doc_id in truth and zlib.crc32(str(r.row.doc_id).encode()) % 3 == 1]
    assert len(held) > 80 and sum(held) / len(held) > 0.97


def test_classifier_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = classifier.score(docs, classifier.train(docs, labels), keep=["doc_id"]).select("row.doc_id", "score")
    held = scored.join(labels, "doc_id").where(classifier.remainder(labels.doc_id) == 1).select("quality", "score").collect()
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert sum(s >= 0.5 for s in good) / len(good) > 0.97 and sum(s < 0.5 for s in bad) / len(bad) > 0.85
    assert abs(sum(good + bad) / len(held) - len(good) / len(held)) < 0.03  # calibrated


def test_classifier_without_lessons(spark):
    docs, labels, rows, _ = labelled(spark, 30)
    for some, want in ((labels.limit(0), 0.5), (labels.where("quality = 1 AND doc_id > 3"), 1.0), (labels.where("quality = 0 AND doc_id > 3"), 0.0)):
        got = classifier.score(docs, classifier.train(docs, some)).collect()
        assert len(got) == len(rows) and all(r.score == pytest.approx(want, abs=1e-6) for r in got)
    assert classifier.score(docs.limit(0), classifier.train(docs.limit(0), labels)).collect() == []
    one = labels.where("doc_id IN (5, 6, 7, 9)")
    assert all(0 <= r.score <= 1 for r in classifier.score(docs, classifier.train(docs, one)).collect())
