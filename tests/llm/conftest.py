import pytest

from textmill.llm.common import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a table that also has a column named as one of the operators' own."""

    def make(rows, more="n bigint, digest string"):
        return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], f"doc_id bigint, text string, {more}")

    return make
