import pytest
from odd_rows import ODD


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(d, t, "clash", "clash", 1) for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, h string, words string, part int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
