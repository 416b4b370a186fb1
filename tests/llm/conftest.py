import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, key int"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
WORDS = [f"word{i}" for i in range(40)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    near = WORDS[:38] + ["other", "end"]
    texts = [
        (1, " ".join(WORDS)), (2, " ".join(WORDS)), (3, " ".join(near)), (4, "  ".join(WORDS).upper()), (5, None), (6, ""), (7, " \t\n\v\f\r "), (8, LONG),
        (9, LONG + " tail"), (10, "one two"), (11, "One TWO"), (None, " ".join(WORDS[5:])), (12, "a" * 5000), (13, "x y 　 z"), (14, "same"), (14, "same"), (15, "é" * 3),
    ]
    return [(i, t, None if i == 3 else "en", None if i in (5, 10) else f"s{(i or 0) % 3}", None, 7, "clash", 1) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
