import pytest


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, clashing column names."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(1, "a b c d e f g h i j", "s"), (1, "a b c d e f g h i j", "s"), (2, None, None), (3, "", "s"), (4, " \n\t ", "t"), (5, long, "t"), (None, "x y z", "s"), (6, "A b c  d e f g h i j", None), (7, "x y z", "s")]
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, n long, key string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n long, key string")
