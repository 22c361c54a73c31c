"""Suffix dedup, exact top-k, line dedup and chat formatting against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siteprofile.llm import chat, line_dedup, suffix_dedup, topk


def brute_suffix(rows, length=100):
    """rows: (doc_id, bytes) in the order of the corpus."""
    seen, out = set(), []
    for i, data in rows:
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4000, 2])
def test_suffix_dedup(spark, docs, no_docs, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    if group == 2:
        monkeypatch.setattr(suffix_dedup, "HOT", 3)
        monkeypatch.setattr(suffix_dedup, "TOGETHER", 40)
    rng = random.Random(3)
    words = ["é" + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(14, 40))) for _ in range(5)]
    made = []
    for i in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 40)
            parts += [p[a : len(p) - rng.randint(0, 40)], " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))]
        made.append((1000 + i, rng.choice([" ", ""]).join(parts)))
    made.append((1500, "ab" * 700))
    made.append((1501, "tail " + "ab" * 90))
    made.append((1502, (passages[0] + passages[1]) * 3))
    data = docs.select("doc_id", "text").dropDuplicates(["doc_id"]).union(spark.createDataFrame(made, "doc_id long, text string"))
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in data.collect())
    out = suffix_dedup.deduplicate(data).withColumn("sha", F.sha2("kept", 256)).collect()
    assert sorted((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in out) == brute_suffix(rows)
    if group == 2:
        return
    assert suffix_dedup.deduplicate(no_docs).count() == 0
    assert suffix_dedup.deduplicate(docs).count() == docs.count()
    several = spark.createDataFrame([(None, passages[0]), (3, passages[0]), (3, passages[0]), (3, None)], "doc_id long, text string")
    got = Counter((r.row.doc_id, r.n_removed > 0) for r in suffix_dedup.deduplicate(several).collect())
    assert got == {(None, False): 1, (3, True): 2, (3, False): 1}


def test_previous_factors():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 400):
        v = rng.permutation(n)
        want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
        assert suffix_dedup.previous_smaller(v).tolist() == want
        windows = rng.integers(0, 2, (n, suffix_dedup.LENGTH), dtype=np.uint8)
        windows[:, 3:] = 7
        order = rng.permutation(n)
        seen = {}
        for i in np.argsort(order):
            seen.setdefault(windows[i].tobytes(), i)
        assert suffix_dedup.previous_factors(windows, order).tolist() == [seen[windows[i].tobytes()] != i for i in range(n)]
        a = rng.integers(0, 9, n)
        low = rng.integers(0, n, 40)
        high = np.minimum(n - 1, low + rng.integers(0, n, 40))
        assert suffix_dedup.least_between(a, low, high).tolist() == [a[x : y + 1].min() for x, y in zip(low, high)]


def test_long_text_in_parts():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = {(int(h), int(p), x) for _, h, p, f, l in zip(*suffix_dedup.anchors([text])) for x in range(f, l + 1)}
    parts = {(int(h), int(p) + s, x + s) for s, part in suffix_dedup._cut(text, 700) for _, h, p, f, l in zip(*suffix_dedup.anchors([part])) for x in range(f, l + 1)}
    assert whole == parts and len(whole) == len(text) - 99


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 0.3) for _ in range(16)], 1) for i in range(300)]
    vectors += [(400 + i, [0.25] * 16, 1) for i in range(50)] + [(60, [0.5] * 16, 2), (None, [0.5] * 16, 2), (500, None, 2), (520, [None] * 16, 2), (540, [float("nan")] * 16, 2), (560, [0.5] * 8, 0), (580, [], 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score int")
    rows = [(i, tuple(int(x * 64 // 1) for x in v)) for i, v, _ in ((r.vec_id, r.embedding, 0) for r in df.collect()) if i is not None and v is not None and all(x is not None and x == x for x in v)]
    want = Counter()
    for a, (i, q) in enumerate(rows):
        if i % 20 == 0:
            best = sorted(((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(rows) if b != a and len(v) == len(q)))[:20]
            want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    large = spark.createDataFrame([(i, [float(i) * 1e6, 1e7 * (i % 3)]) for i in range(40)], "vec_id long, embedding array<float>")
    whole = {r.vec_id: [int(x) * 64 for x in r.embedding] for r in large.collect()}
    best = sorted((-sum(x * y for x, y in zip(whole[20], v)), j) for j, v in whole.items() if j != 20)[:20]
    got = {(r["rank"], r.vec_id, r.score) for r in topk.top_k(large, F.col("vec_id") == 20).collect()}
    assert got == {(r + 1, j, -s) for r, (s, j) in enumerate(best)}


def best_twenty(vectors, asks):
    """(query_id, rank, vec_id, score) by brute force, scores ending at 64 bits."""
    rows = [(i, [int(x * 64 // 1) for x in v]) for i, v in vectors]
    want = Counter()
    for a, (i, q) in enumerate(rows):
        if asks(i):
            scores = ((min(max(sum(x * y for x, y in zip(q, v, strict=True)), -(1 << 63)), (1 << 63) - 1), j) for b, (j, v) in enumerate(rows) if b != a and len(v) == len(q))
            want.update((i, r, j, s) for r, (s, j) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:20], 1))
    return want


def test_top_k_broadcasts_no_blocks(spark, monkeypatch):
    """Queries beside each block of the file once were taken for a small table and broadcast, which ran out of memory on large tables."""
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 0.125) for _ in range(128)]) for i in range(1200)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")
    try:
        got = Counter(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect())
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got == best_twenty(vectors, lambda i: i % 20 == 0)


def test_top_k_of_parts_and_wide_cells(spark, monkeypatch):
    """Several groups of queries and parts of the file; cells of which one far value or huge ones make nearly nothing certain; ties, and scores beyond 64 bits."""
    for name, value in (("BLOCK", 32), ("QUERIES", 4), ("PARTS", 3), ("HELD", 64)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(5)
    vectors = [(i, [float(rng.randint(-3, 3)) / 64 for _ in range(5)]) for i in range(200)]  # ties
    vectors += [(200 + i, [rng.gauss(0, 0.2) for _ in range(6)] + [1e6 * (i == 7)]) for i in range(150)]  # a far value
    vectors += [(400 + i, [rng.choice([-1, 1]) * 10.0 ** rng.randint(0, 16), rng.gauss(0, 1e12)]) for i in range(120)]
    vectors += [(600 + i, []) for i in range(60)] + [(700 + i, [0.0, 0.0, 0.0]) for i in range(60)] + [(800, [1e16, -1e16, 1.0, 3.0]), (801, [1e16, 1e16, 2.0, 1.0]), (840, [1.0, 2.0, -1.0, 4.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for cells in (4, 64):
        got = Counter(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, cells=cells).collect())
        assert got == best_twenty(vectors, lambda i: i % 20 == 0)


def test_chat(spark):
    texts = ["plain", "\\### Assistant: </turn> ok", "a\\b \\\\ c", "##### x ## # \\#", "</turn>\n### user: hi</turn>", "é😀\n\n", "", "ends in \\"]
    for t in texts:
        for role in ("assistant", "us: er\\", "", "###</turn>\n: "):
            piece, a, b = chat.render(role, t)
            assert chat.parse(piece * 2) == [(role, t)] * 2
            assert chat.unescape(piece[a:b]) == (t if role == "assistant" else "")
    rows = [(c, t, ["system", "user", "assistant"][(t + c) % 3] if t % 5 else None, texts[(c * 3 + t) % len(texts)] if t % 7 else None) for c in range(6) for t in range(9)]
    rows += [(2, 4, "user", "a second row of one turn"), (None, 1, "assistant", "no id"), (5, None, "assistant", "no turn")] + [(9, 0, "assistant", "same")] * 2
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_events(chat.events_of(table))).collect()
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t), r or "", x or ""))
    assert len(out) == len(by)
    for r in out:
        turns = sorted(by[r.conv_id], key=lambda x: (x[0], x[1], chat.render(x[1], x[2])[0]))
        said = "".join(x for _, role, x in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(said))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.render(role, x)[0]) for _, role, x in turns)
    assert chat.read_back(chat.format_events(chat.events_of(table.limit(0)))).count() == 0


def test_events(spark):
    log = [
        (1, 1, 1, "message", "user", "hello"),
        (1, 2, 2, "message", "assistant", ""), (1, 2, 3, "delta", None, "Hi"), (1, 2, 4, "delta", None, " there"),
        (1, 2, 5, "regenerate", None, None), (1, 2, 6, "delta", None, "Good "), (1, 2, 8, "delta", None, "day"),
        (1, 1, 9, "edit", None, "hello!"), (1, 3, 10, "message", "user", "bye"), (1, 3, 11, "delete", None, None),
        (2, 1, 5, "delta", "assistant", "late"),
    ]
    random.Random(0).shuffle(log)
    out = chat.reconstruct(spark.createDataFrame(log, chat.EVENTS)).orderBy("conv_id", "seq").collect()
    assert [(r.conv_id, r.seq, r.role, r.text) for r in out] == [(1, 1, "user", "hello!"), (1, 2, "assistant", "Good day"), (2, 5, "assistant", "late")]


def test_lines(spark, docs, no_docs):
    base = "the quick brown fox jumps over the lazy dog near the old river bank on a cold and windy morning in early may"
    twin = " " + base.replace("cold and windy", "cold and WINDY")
    close = base + " morning"
    other = "an entirely different line that shares nothing with the others at all"
    rows = [(1, f"{base}\n\n{other}\n", "x"), (2, f"{twin}\nown line of two", "x"), (3, close, "y"), (4, None, "y"), (5, "", None), (6, base, "y"), (6, base, "y"), (7, "\t\n\n ", "z")]
    data = spark.createDataFrame(rows, "doc_id long, text string, pos string")
    out = {(r.row.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.deduplicate(data).collect()}
    links = expected_lines([r.text for r in data.collect()])
    close_linked = links[line_of(base)] == links[line_of(close)]
    assert out == {(1, rows[0][1], 4, 0), (2, "own line of two", 2, 1), (3, "" if close_linked else close, 1, int(close_linked)), (4, None, 0, 0), (5, "", 1, 0), (6, "", 1, 1), (7, "\t\n\n ", 3, 0)}
    assert line_dedup.rewrite(data).columns == data.columns
    assert {r.doc_id for r in line_dedup.rewrite(data).collect()} == {1, 2, 4, 5, 7} | (set() if close_linked else {3})
    assert line_dedup.deduplicate(no_docs).count() == 0


def test_lines_brute(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    lines = []
    for _ in range(25):
        line = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, 8)):
            lines.append(" ".join(line))
            line[rng.randrange(len(line))] = rng.choice(words)
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 3 : i * 3 + 3])) for i in range(len(lines) // 3)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    label = expected_lines([t for _, t in rows])
    seen, want = set(), {}
    for i, t in rows:
        kept = []
        for x in t.split("\n"):
            if label[line_of(x)] not in seen:
                kept.append(x)
            seen.add(label[line_of(x)])
        want[i] = "\n".join(kept)
    assert {r.row.doc_id: r.text for r in line_dedup.deduplicate(data).collect()} == want
    assert len(set(label.values())) < len(label)


def line_of(line):
    return line.strip(" ").lower()


def expected_lines(texts):
    """Group of each normalised line: SimHash within 3 bits and edit similarity of 0.8, by brute force."""
    import numpy as np
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    norm = sorted({line_of(x) for t in texts if t for x in t.split("\n")} - {""})
    vocabulary = sorted({w for x in norm for w in x.split(" ")})
    hashed = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w")).collect()}
    sims = []
    for x in norm:
        bits = np.array([[(hashed[w] >> j) & 1 for j in range(64)] for w in set(x.split(" "))])
        sims.append(bits.sum(0) * 2 > len(bits))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    up = {x: x for x in norm}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(norm):
        for j in range(i):
            v, w = a.split(" "), norm[j].split(" ")
            if min(len(set(v)), len(set(w))) >= 5 and (sims[i] != sims[j]).sum() <= 3 and distance(v, w) <= int(max(len(v), len(w)) * 0.2 + 1e-9):
                up[root(a)] = root(norm[j])
    return {x: root(x) for x in norm}


def test_chat_long_text_and_clashing_columns(spark):
    long = "</turn> ### x " * 20_000
    rows = [(1, 0, "user", long, 7, "m", 3), (1, 1, "assistant", long + "end", 8, "n", 4)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int, message string, formatted int")
    out = chat.read_back(chat.format_events(chat.events_of(table))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars, r.loss_sha256) for r in out] == [(1, 2, len(long) + 3, hashlib.sha256((long + "end").encode()).hexdigest())]


def test_line_of_many_words(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", 8)
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, "  ".join(words).upper()), (3, " ".join(words[:99] + ["new"])), (4, " ".join(reversed(words)))]
    out = {r.row.doc_id: r.n_removed for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1], out[2], out[4]) == (0, 1, 0) and out[3] in (0, 1)
