import pytest
from pyspark.sql import Row

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\r\x0b\x0c ", "en", "", 6), (None, "no id here", "en", "a", 10), (5, long, "en", "a", len(long)),
            (6, "same row", "en", "b", 8), (6, "same row", "en", "b", 8), (7, "é ü ß 漢字 \U0001f600", None, "b", 12), (8, "!!! 123 ###", "de", None, 11)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def as_dir(tmp_path):
    """Writes frames as a data folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def same_rows(df, want):
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == sorted((tuple(w) for w in want), key=str)


__all__ = ["Row", "same_rows"]
