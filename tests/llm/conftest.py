import pytest


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing column names."""
    long = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
    rows = [(1, "alpha beta gamma", "en", "row"), (1, "alpha beta gamma", "en", "row"), (2, None, None, None), (3, "", "en", "x"), (None, "no id here", "en", "x"), (4, long, "en", "x"), (5, " \n\t ", "fr", "y"), (6, "ß Ünï 日本 \U0001f600 x\x00y", "de", "z"), (1, "same id, other text", "en", "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, row string")


@pytest.fixture(scope="session")
def no_rows(odd_rows):
    return odd_rows.limit(0)
