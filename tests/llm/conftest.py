import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, _salt string"


def edge_rows():
    rng = random.Random(5)
    syllables = ["ka", "lo", "mi", "ru", "te", "so", "Ña", "ü", "x1", "7"]

    def prose(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    base = prose(120)
    near = base.split()
    near[7] = "changed"
    long = prose(3000)
    rows = [
        (1, base, "a"), (2, " ".join(near), "a"), (3, base, "b"), (4, base.upper(), None), (5, None, "a"), (6, "", "b"),
        (7, " \n\t ", "a"), (8, "one two three", "a"), (9, "One  TWO\nthree", "b"), (10, long, "a"), (11, long + " tail", "c"),
        (12, "spam spam spam " * 60, "c"), (13, "# # # $ %\n# # # $ %\n" * 30, "c"), (14, "x" * 3000, "a"), (15, base, "a"), (15, base, "a"),
        (16, None, None), (17, prose(60) + "\n" + prose(60), ""), (18, "<|endoftext|>don't stop<|startoftext|> é é 😀 12", "b"),
    ]
    rows += [(100 + i, base, "a") for i in range(30)]
    rows += [(200 + i, prose(rng.randint(1, 90)), rng.choice("abc")) for i in range(60)]
    return [(i, t, "l", s, 0, 9, "clash", "clash") for i, t, s in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
