"""Small tables with the awkward cases that every operator meets."""

import random

import pytest

TYPES = "doc_id long, text string, lang string, source string, n_chars long, chunk string, key int, row string, kept string"


def make_rows(n: int = 60, seed: int = 1) -> list[tuple]:
    """Texts with copies, near copies, shared passages, ties, repeated rows, nulls, empty and long ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "er", "th", "on", "é", "ing", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        if i % 7 == 3:
            text = f"{text}\n{passage}\t{text[:50]}"
        if i % 9 == 4 and rows:
            text = rows[-1][1]
        if i % 9 == 5 and rows and rows[-1][1]:
            own = rows[-1][1].split(" ")
            own[len(own) // 2] = "changed"
            text = " ".join(own)
        rows.append([i * 3 % 101, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 0, "x", i, "y", "z"])
    rows[5][1], rows[6][1], rows[7][1], rows[8][1] = None, "", "  \n\t ", "one two"
    rows[9][1] = "  leading Space And ÉCOLE's 12345   don't    x y \U0001f600 end "
    rows[10][1] = "long " * 30_000 + passage
    rows[11][1] = "w" * 200_000
    rows.append(list(rows[3]))
    rows.append([None, passage, None, None, None, None, None, None, None])
    rows.append([None, None, None, None, None, None, None, None, None])
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def odd_rows():
    return make_rows()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, TYPES).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], TYPES)
