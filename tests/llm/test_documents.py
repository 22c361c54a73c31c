"""Mixing, sharding, quality, packing and the Jaccard join against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from siteprofile.llm import jaccard, mixing, packing, quality, sharding
from siteprofile.llm.queries import tokenizer_path


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def test_mixing(spark, docs, no_docs):
    rows = docs.collect()
    out = mixing.plan(docs).collect()
    assert Counter((r.row.doc_id, r.row.source) for r in out) == Counter((r.doc_id, r.source) for r in rows)
    size = defaultdict(int)
    for r in rows:
        size[r.source] += len(words(r.text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, rest, free = {}, float(sum(size.values())), set(names)
    while True:  # share, cut, share again
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            rest -= target[s]
        free -= over
    taken = defaultdict(int)
    for r in out:
        assert r.size == len(words(r.row.text)) and r.source_size == size[r.row.source] and 0 <= r.copies <= 3
        assert r.target == pytest.approx(target[r.row.source])
        taken[r.row.source] += r.copies * r.size
    largest = max(len(words(r.text)) for r in rows)
    for s in names:
        assert abs(taken[s] - target[s]) <= largest
    again = mixing.plan(docs.repartition(7)).collect()
    assert sorted((r.row.doc_id, r.copies) for r in out) == sorted((r.row.doc_id, r.copies) for r in again)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


@pytest.mark.parametrize(("n", "tolerance"), [(8, 0.001), (3, 0.2), (5, 0.01)])
def test_sharding_against_sorting(spark, n, tolerance):
    """Shards are cuts of the sorted rows, each where the bytes before it are nearest to its share or within the tolerance; slots number a shard's rows."""

    rng = random.Random(n)
    texts = ["", None, "é" * 40_000, *("x" * rng.choice([0, 3, 50, 2_000]) for _ in range(900))]
    ids = rng.sample(range(-(10**12), 10**12), len(texts))
    got = {r.row.doc_id: r for r in sharding.shard(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5), n, tolerance).collect()}
    ordered = sorted(zip(ids, texts, strict=True))
    sizes = [len((t or "").encode()) + 1 for _, t in ordered]
    total, slack = sum(sizes), max(1, int(tolerance * sum(sizes) / n))
    before = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    shards = [got[i].shard for i, _ in ordered]
    assert shards == sorted(shards) and set(shards) <= set(range(n))
    for k in range(1, n):
        cut = next((i for i, s in enumerate(shards) if s >= k), len(shards))
        target = round(total * k / n)
        nearest = min(abs(b - target) for b in before)
        assert abs(before[cut] - target) <= max(slack, nearest)
    seen: dict[int, int] = {}
    for (i, text), size in zip(ordered, sizes, strict=True):
        r = got[i]
        assert (r["size"], r.text_crc32, r.slot) == (size, zlib.crc32((text or "").encode()), seen.get(r.shard, 0))
        seen[r.shard] = r.slot + 1


def test_sharding(spark, docs, no_docs, tmp_path):
    rows = docs.collect()
    for n, data in ((8, docs), (3, docs), (2, docs.union(docs.where("doc_id = 10")))):
        out = sharding.shard(data, n).collect()
        assert len(out) == data.count()
        held, slots, order = defaultdict(int), defaultdict(list), defaultdict(list)
        for r in out:
            raw = (r.row.text or "").encode()
            assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
            held[r.shard] += r["size"]
            slots[r.shard].append(r.slot)
            order[r.shard].append(r.row.doc_id)
        largest = max(len((r.text or "").encode()) + 1 for r in rows)
        assert max(held.values()) - min(held.get(i, 0) for i in range(n)) <= 2 * largest + 10
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(held) <= set(range(n))
        shards = sorted(order)
        assert all(max(order[a]) <= min(order[b]) for a, b in zip(shards, shards[1:]))
    alike = spark.createDataFrame([(None, "same text")] * 400, "doc_id long, text string")
    assert Counter(r.shard for r in sharding.shard(alike, 4).collect()) == {0: 100, 1: 100, 2: 100, 3: 100}
    assert sharding.shard(no_docs).count() == 0
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "s"), 3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)


def expected_quality(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if x.encode().split()]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_quality(spark, docs, no_docs):
    out = quality.judge(docs).collect()
    assert Counter(r.row.doc_id for r in out) == Counter(r.doc_id for r in docs.collect())
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected_quality(r.row.text)
        soft = r.n_symbols > 0.1 * r.word_chars or r.n_dup_lines > 0.3 * r.n_lines
        assert r.kept == (not r.base_failed and not (r.bad_host and soft))
    assert {r.doc_id for r in quality.filter_documents(docs).collect()} == {r.row.doc_id for r in out if r.kept}
    assert quality.filter_documents(docs).columns == docs.columns
    assert quality.judge(no_docs).count() == 0


def test_host_verdict(spark):
    good = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(4))
    soft = good + "\n" + "\n".join(["a line again"] * 4)
    rows = [(i, soft if i % 10 else good, "bad") for i in range(100)] + [(200 + i, soft if i == 0 else good, f"h{i % 5}") for i in range(100)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.row.source for r in out if r.bad_host} == {"bad"}
    assert {r.row.doc_id for r in out if not r.kept} == {i for i in range(100) if i % 10}


def test_packing(spark, docs, no_docs):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    encode = Tokenizer.from_file(path)
    rows = docs.collect()
    for length in (64, 4096):
        out = packing.pack(docs.repartition(3), path, length).collect()
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for r in out:
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
            by_doc[r.doc_id].append(r)
            by_seq[r.sequence_id].append(r)
        for i in {r.doc_id for r in rows}:
            same = [r.text for r in rows if r.doc_id == i]
            want = [*encode.encode(same[0] or "", add_special_tokens=False).ids, 2]
            pieces = sorted(by_doc[i], key=lambda r: (r.sequence_id, r.offset))
            got = b"".join(r.ids for r in pieces)
            assert got == b"".join(x.to_bytes(4, "little") for x in want) * len(same)
            assert all(r.doc_tokens == len(want) for r in pieces)
        last = max(by_seq)
        assert sorted(by_seq) == list(range(last + 1))
        for s, pieces in by_seq.items():
            pieces.sort(key=lambda r: r.offset)
            assert [r.offset for r in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
            assert sum(r.length for r in pieces) == length or s == last
    full = packing.sequences(packing.pack(docs, path, 64), 64).collect()
    assert all(len(r.ids) == 4 * 64 for r in full if r.sequence_id < max(x.sequence_id for x in full))
    assert packing.pack(no_docs, path).count() == 0


def test_divide_skip():
    import random

    import numpy as np

    rng = random.Random(2)
    for trial in range(60):
        base = rng.sample(range(10**6), 60)
        sets = []
        for _ in range(25):
            s = set(base[: rng.randint(20, 60)])
            for _ in range(rng.randint(0, 14)):
                s.discard(rng.choice(base))
                s.add(rng.randrange(10**6))
            sets.append(np.array(sorted(s), np.uint64))
        sets.sort(key=len)
        queries = [i for i in range(25) if trial % 2 or rng.random() < 0.6]
        up = list(range(25))
        for i in queries:
            for j in range(25):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = up[i], up[j]
                    up = [min(a, b) if x in (a, b) else x for x in up]
        jaccard.HEAP, kept = (0 if trial % 3 else 2000), jaccard.HEAP
        assert jaccard.divide_skip(sets, queries, 80).tolist() == up
        jaccard.HEAP = kept


def brute_classes(rows, percent=80):
    sets, up = [], {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append((r.doc_id, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
        up[r.doc_id] = r.doc_id

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if b < a and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return Counter((i, len(s), root(i)) for i, s in sets)


@pytest.mark.parametrize("block", [1000, 4])
def test_jaccard(spark, docs, no_docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    if block == 4:
        monkeypatch.setattr(jaccard, "HEAP", 20)
        monkeypatch.setattr(jaccard, "COST", 0.1)
    rows = docs.collect()
    base = rows[0].text.split()
    more = []
    for i in range(24):  # a chain of edits: neighbours link, the ends do not
        base[(5 * i) % len(base)] = f"edit{i}"
        more.append((300 + i, " ".join(base)))
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(all_docs).collect())
    assert got == brute_classes(all_docs.collect())
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_classes(rows)})
    assert jaccard.classes(no_docs).count() == 0
    nulls = spark.createDataFrame([(None, rows[0].text), (None, None), (4, rows[0].text)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in jaccard.classes(nulls).collect()), key=str) == [(4, 4), (None, None), (None, None)]
