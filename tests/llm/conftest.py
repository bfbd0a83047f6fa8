import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, u long, v long, `key` string, token string, host string, `row` long, spans string, drops string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rng.randint(1, 9)))
    para = " ".join(word() for _ in range(60))
    shared = "This line is common to a good many of the documents here"
    texts = [None, "", "   \n\t ", "one", "one two", "é", "中文", "\0", para, para, para.upper(), para + " x", para + "\n" + shared, *[f"{word()} {word()}\n{shared}\n {shared.upper()} " for _ in range(6)], " ".join(word() for _ in range(20_000)), "x" * 50_000, "a b " * 5_000]
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or "")) + (None,) * 9 for i, t in enumerate(texts)]
    rows += [rows[8], (None, para, "en", None, None) + (None,) * 9, (None, None, None, None, None) + (None,) * 9]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("1 = 0")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
