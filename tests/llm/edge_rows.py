"""Fixtures of this folder."""

import pytest

DATA = "/root/testdata/sf0.001"

# Every operator meets these rows: null id, null and empty text, blanks only, repeated rows, one word, a very long text,
# and columns named like those that operators add or use inside.
LONG = " ".join(f"w{k % 977}" for k in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.\nSecond line."),
    (2, None), (3, ""), (4, " \t\n \x0b"), (5, "word"), (6, "word"), (7, LONG), (7, LONG), (7, "another text of the same id"),
    (None, "A row without an id, yet with some text in it."), (None, None), (8, "!!! ... ###"), (9, "Ärger über süße Öfen, naïve café."),
]
SCHEMA = "doc_id long, text string, id string, th string, score string, n_words string, bits string, lines_deleted string, contamination string, cls string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x", "x", "x") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
