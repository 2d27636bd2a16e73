import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id long, grp int, bucket int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) or (id, text, lang), with extra columns whose names clash with those used inside."""

    def build(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None, 7, 1, 2) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


#: Null ids and texts, empty and blank texts, ties, repeated rows, odd characters, a very long text.
LONG = " ".join(f"w{i % 9973}" for i in range(60_000))
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "the quick brown fox jumps over the lazy dog and runs far away from here today"),
    (5, "the quick brown fox jumps over the lazy dog and runs far away from here today"),
    (None, "the quick brown fox jumps over the lazy dog and runs far away from here today"), (None, None),
    (6, "The QUICK brown fox jumps over the lazy dog and runs far away from here today!"),
    (7, "été 中文 \U0001f600 a b ΑΣ <|endoftext|> x"), (8, LONG), (9, LONG + " end"), (0, "!!! 123 ..."), (-3, "one"),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


