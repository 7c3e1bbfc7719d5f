import random

import pytest

#: Columns whose names operators use inside.
CLASHING = ("id", "size", "words", "key", "score", "kept", "row", "found", "component", "copies", "digest", "nth", "n", "path", "at")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, blank, repeated and very long rows, and clashing extra columns."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["sea", "rain", "stone", "the", "Of", "été", "x1", "light."]) + rng.choice(["", "s", "er"]) for _ in range(n))
    twin = prose(40)
    rows = [(1, twin, "a"), (2, twin, "a"), (2, twin, "a"), (3, None, "a"), (4, "", None), (5, " \t\n", "b"), (None, prose(12), "b"), (None, None, None), (6, prose(30_000), "b"), (7, "one", "c"), (8, "One", "c"), (9, twin + " tail", "c"), (10, "两个 词 here\x0bthere", "d")]
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, *range(len(CLASHING))) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return (text or "").encode().split()


def lower_words(text):
    return (text or "").encode().lower().split()
