import pytest

SCHEMA = "doc_id long, text string, source string, rid long, block long, n string, LINE string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"w{i % 97}x{i // 97}" for i in range(4000))
    line = "one two three four five six seven eight nine ten eleven"
    rows = [
        (1, "Alpha beta gamma delta.\n" + line, "a"), (2, "Alpha beta gamma delta.\n" + line, "a"), (2, "Alpha beta gamma delta.\n" + line, "a"),
        (3, None, None), (4, "", "b"), (5, " \n\t ", "b"), (None, "alpha  beta\ngamma delta.", "c"), (None, None, None),
        (6, long, "a"), (7, long + " tail", "c"), (8, line + " twelve\n" + line, "b"), (9, "x", ""), (10, "!!! ### <|endoftext|> é ü", "b"),
        (11, "the same words again " * 40, "a"), (6, "other text under an id that occurs twice", "a"),
    ]
    return spark.createDataFrame([(*r, i, -i, None, "z") for i, r in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]
