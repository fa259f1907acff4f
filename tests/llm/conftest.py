import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_removed string, _row int"


def prose(rng: random.Random, n: int) -> str:
    words = ["alpha", "beta", "Gamma", "delta,", "été", "ñu", "Über", "x.", "one", "two", "three", "four", "five", "six"]
    return " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, copies, repeated rows and ids."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (5, 40, 60, 200, 13, 12, 14)]
    long = prose(rng, 4000)
    texts = [None, "", " \n\t ", *base, base[1], base[2], base[2].replace("one", "ONE", 1), "x " + base[3] + " y", long, long[: len(long) // 2] + " tail", "a\nshared line of text here\nb", "c\nSHARED line of text here \nd\n\nd", "one same line again\n" * 30, "word " * 50, "|a| #b $c\n\n<%>"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None, "clash", i) for i, t in enumerate(texts)]
    rows += [rows[4], (4, base[0], "fr", None, 1, None, None), (None, base[1], None, None, None, None, None), (None, None, "en", "s1", 3, "x", 1), (None, base[1], None, None, None, None, None)]
    return rows


@pytest.fixture()
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
