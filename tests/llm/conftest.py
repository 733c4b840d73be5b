import pytest

SF = "/root/testdata/sf0.001"
#: Nulls, empty and very long texts, ties, repeated rows and ids, an extra column that clashes with names used inside.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s", 9, "x"),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s", 9, "x"),
    (2, "The quick brown fox jumps over the lazy dog again and again", "en", "s", 9, None),
    (3, None, None, None, None, "y"),
    (4, "", "en", "s", 0, "y"),
    (5, " \n\t ", "en", "s", 4, "y"),
    (6, "word " * 60_000, "en", "s", 9, "z"),
    (7, "один два три четыре пять шесть", "ru", "s", 9, "z"),
    (8, "42 !!! ...", "en", "s", 9, "z"),
    (9, "ab", None, "s", 2, "z"),
    (None, "no id here at all in this row of words", "en", "s", 9, "z"),
]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, None, 1), (None, 1, 1), (7, 1, 0), (77, 0, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
