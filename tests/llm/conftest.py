"""Small tables with every awkward case, shared by the tests of the training-data operators."""

import random

import pytest

CLASHES = ("k", "t", "_k", "_t", "h", "_h", "fp", "row", "size", "score", "rank", "shard", "slot", "n_words", "taken", "target", "part", "v", "text_hash", "selected")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def messy_rows():
    """(doc_id, text, lang, source, n_chars): nulls in every column, empty, blank and very long texts, ties, repeats."""
    rng = random.Random(5)
    base = sentence(rng, 60)
    shared = sentence(rng, 30)
    rows = [(1, base, "en", "a", 10), (2, base, "en", "b", 10), (3, base + " end", "de", None, None), (4, None, None, "a", None), (5, "", "en", "b", 0),
            (6, " \t\n\x0b ", "en", "c", 5), (7, "One", "en", "a", 3), (8, "one", "en", "a", 3), (9, sentence(rng, 60_000, 5000), "en", "a", 1),
            (10, shared + " " + sentence(rng, 40), "en", "c", 1), (11, sentence(rng, 40) + " " + shared, "en", "c", 1),
            (12, "a " * 40 + "b c d", "en", "a", 1), (13, "x " + "a " * 35, "en", "a", 1), (14, "é ñ \U0001F600 " + shared + " z", "fr", "", 1)]
    rows += [(15, sentence(rng, 25), "en", "a", 2)] * 3  # repeated rows
    rows += [(None, base, "en", "a", 2), (None, sentence(rng, 20), None, None, None)]
    rows += [(100 + i, sentence(rng, rng.randrange(0, 90)), "en", "hot", 7) for i in range(60)]
    rows += [(200 + i, base, "en", "hot", 7) for i in range(30)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """The documents, with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
