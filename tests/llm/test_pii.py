"""Base spans against Python's re, and planted contexts that the method must find."""

import random
import re

from siteprofile.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def card(rng):
    d = [rng.randint(0, 9) for _ in range(15)]
    return next(s for c in range(10) if passes("card", s := "".join(map(str, [*d, c]))))


def test_base(spark, docs, no_docs):
    rng = random.Random(4)
    bits = ["é😀", "a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.2.3.255", card(rng), "4111-1111 1111 1111", "+1 (017) 555-7713", "+1 2", "++12345678901", "@@", "a@b.c.", "1-2-3", " ", "\n", "word", "+49.30.1234567)", "a@b.co@c.d", "12 34"]
    rows = [(i, rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    rows += [(900, None), (901, "7 " * 30_000), (902, "9" * 50_000), (903, "a" * 100_000 + "@"), (904, "x@" + "b" * 50_000), (None, "mail a@b.cd"), (905, rows[3][1]), (905, rows[3][1])]
    out = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.base_spans]) for r in out), key=str)
    assert got == sorted(((i, base(t)) for i, t in rows), key=str)
    for r in out:
        kinds = [s.kind for s in r.base_spans]
        assert [kinds.count(k) for k in pii.KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert set(r.base_spans) <= set(r.spans)
    assert pii.detect(no_docs).count() == 0
    assert pii.detect(docs).count() == docs.count()


def test_contexts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("klmnop") for _ in range(6))
    rows = [(i, f"{word()} {word()} call me at +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} {word()} {word()} order number {rng.randint(10000, 99999)} {word()}") for i in range(40)]
    rows += [(100 + i, f"{word()} call me at 555-{7000 + i} {word()}") for i in range(3)]
    rows += [(200 + i, f"{word()} order number 555-{8000 + i} {word()}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.detect(df).collect()}
    for i, t in rows:
        extra = [(s.kind, t[s.start : s.end]) for s in out[i].spans if s not in out[i].base_spans]
        assert extra == ([("phone", f"555-{6900 + i}")] if 100 <= i < 200 else [])
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert "[phone]" in clean[0] and "[phone]" in clean[101] and "555" not in clean[101] and clean[200] == dict(rows)[200]


SEEDS = {"email": "write to {} for details", "ip": "traffic from host {} was dropped", "card": "charged to card {} last week", "phone": "dial the desk {} after nine"}


def test_recall(spark):
    """Each kind: 40 seeds in one context, 20 identifiers that no base pattern matches there, and 40 look-alikes in other contexts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfgh") for _ in range(7))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    seed = {"email": lambda: f"{word()}@{word()}.org", "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), "card": lambda: card(rng), "phone": lambda: f"+{d(2)} {d(3)} {d(6)}"}
    unseen = {"email": lambda: f"{word()}(at){word()}.org", "ip": lambda: "-".join(str(rng.randint(100, 255)) for _ in range(4)), "card": lambda: f"{d(4)} {d(4)} {d(3)}", "phone": lambda: f"{d(3)} {d(3)} {d(4)}"}
    rows, planted, decoys = [], set(), set()
    for kind, frame in SEEDS.items():
        for made, times, tell in ((seed, 40, None), (unseen, 20, planted)):
            for _ in range(times):
                x = made[kind]()
                text = f"{word()} {frame.format(x)} {word()}"
                rows.append((len(rows), text))
                if tell is not None:
                    tell.add((len(rows) - 1, kind, text.index(x), text.index(x) + len(x)))
        for _ in range(40):
            x = unseen[kind]()
            rows.append((len(rows), f"{word()} {word()} {x} {word()}"))
            decoys.add(len(rows) - 1)
    # Instances discovered above induce a pattern of their own, which no seed is in.
    numbers = [rows[i][1][a:b] for i, kind, a, b in sorted(planted) if kind == "phone"]
    for i, x in enumerate(numbers[:15] + [f"{d(3)} {d(3)} {d(4)}" for _ in range(3)]):
        text = f"{word()} ring me on {x} {word()}"
        rows.append((len(rows), text))
        planted.add((len(rows) - 1, "phone", text.index(x), text.index(x) + len(x)))
    out = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, s.kind, s.start, s.end) for r in out for s in r.spans if s not in r.base_spans}
    recall, precision = len(found & planted) / len(planted), len(found & planted) / len(found)
    assert recall >= 0.95 and precision >= 0.95, (recall, precision, sorted(planted - found)[:5], sorted(found - planted)[:5])
    assert not {i for i, *_ in found} & decoys
