import pytest

#: Nulls, empty and repeated rows, ties, a repeated id with another text and extra columns with clashing names.
ODD = [
    (1, "The of and or to. The of and or to.\nThe of and or to.", "en", "a", 9, 0.1), (2, None, "en", "a", 0, 0.2), (3, "", None, None, 0, 0.3), (None, "no id here at all", "en", "b", 5, None),
    (4, "copy " * 60, "en", "a", 5, 0.1), (5, "copy " * 60, "en", "a", 5, 0.1), (5, "copy " * 60, "en", "a", 5, 0.1), (6, "!!! ### 123", None, "b", 5, 0.1), (7, "word " * 30000, "en", "a", 5, 0.1),
    (8, "Ünïcode straße 中文 😀 <|endoftext|> don't İ", "de", "b", 5, 0.1), (None, None, None, None, None, None), (9, "x" * 120, "fr", "b", 1, 0.1), (10, "y" + "x" * 80, "fr", "b", 1, 0.1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 11)] + [(None, 1, 1), (4, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.01"
