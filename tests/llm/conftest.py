import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    """A new folder for the Parquet files of a test."""
    return lambda: str(tmp_path_factory.mktemp("tables"))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents with columns that clash with names the operators could use."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})

    return make
