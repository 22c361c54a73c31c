"""Line dedup against brute-force edit similarity, without a cut by SimHash."""

import random

import pytest

from siteprofile.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def near_lines(rng, words):
    lines = []
    for n in (3, 4, 5, 6, 8, 9, 10, 12, 15, 19, 20, 25, 40, 60, 130, 155, 170):
        for kind in range(6):
            base = [rng.choice(words[:2] if kind == 4 else words[:9] if kind == 5 else words) for _ in range(n)]
            copy = list(base)
            for _ in range(n // 5 + (kind == 3)):
                at = rng.randrange(len(copy))
                if kind == 0 or (kind > 1 and rng.random() < 0.6):
                    copy[at] = rng.choice(words)
                elif rng.random() < 0.5 and len(copy) > 1:
                    del copy[at]
                else:
                    copy.insert(at, rng.choice(words))
            lines += [" ".join(base), " ".join(copy)]
    rng.shuffle(lines)
    return list(dict.fromkeys(lines))


@pytest.mark.parametrize("ranked", [True, False])
def test_similar_lines(spark, monkeypatch, ranked):
    if not ranked:  # any ranks find the same pairs
        monkeypatch.setattr(line_dedup, "word_ranks", lambda texts: [i % 7 for i in range(line_dedup.BUCKETS)])
        monkeypatch.setattr(line_dedup, "LONG", 12)
    rng = random.Random(4)
    lines = near_lines(rng, ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)])
    split = [x.split(" ") for x in lines]
    up = list(range(len(lines)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for i, a in enumerate(split):
        for j in range(i):
            b, most = split[j], max(len(a), len(split[j])) // 5
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                up[root(i)] = root(j)
                links += 1
    first = {root(i): i for i in reversed(range(len(lines)))}
    data = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = {r.row.doc_id for r in line_dedup.deduplicate(data, by_simhash=False).collect() if not r.n_removed}
    assert links > 60
    assert kept == set(first.values())
    if ranked:
        assert {r.doc_id for r in line_dedup.rewrite(data, by_simhash=False).collect()} == kept


def test_white_space(spark):
    rows = [(1, "one short line here"), (2, "one  short\tline here\r"), (3, "\x0b One short line here "), (4, "one short line there")]
    out = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), by_simhash=False).collect()
    assert {r.row.doc_id: r.n_removed for r in out} == {1: 0, 2: 1, 3: 1, 4: 0}


def test_reach_of_simhash(spark):
    """Which of the copies of a line with some words replaced link to it: nearly all of long lines with one new word, few near the least similarity."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    reach = {}
    rows, kinds = [], []
    for n in (20, 60, 200):
        for edits in (1, n // 20, n // 10, n // 5):
            for _ in range(20):
                base = [word() for _ in range(n)]
                near = list(base)
                for at in rng.sample(range(n), edits):
                    near[at] = word()
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(near))]
                kinds.append((n, edits))
    out = {r.row.doc_id: r.n_removed for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, kind in enumerate(kinds):
        assert not out[2 * i]
        reach.setdefault(kind, []).append(out[2 * i + 1])
    share = {k: sum(v) / len(v) for k, v in reach.items()}
    print(share)
    assert share[200, 1] > 0.8 and share[20, 4] < 0.2
