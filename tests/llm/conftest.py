import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977} {'x' * (i % 13)}" for i in range(30_000))
    texts = [None, "", " \n\t", "a", "one two three", "one two three", "One TWO three", "a b c d e", "a b c d e f", long, long + " tail", "é" * 50_000, "1" * 50_000, "+" * 30_000, "a@" * 20_000, "1.2.3." * 9_000, "x" * 80_000]
    rows = [(i, t, None if i % 3 == 0 else "en", [None, "s1", "s2", "S1"][i % 4], None) for i, t in enumerate(texts)]
    rows += [(3, "a", "en", "s1", 1), (3, "a", "en", "s1", 1), (None, "a b c d e", "en", "s1", 1), (None, "unique words here for null id", None, None, None), (-5, "a b c d e", "de", "s2", 9)]
    rows = [(*r, "clash", b"clash", 1, 2) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string, __text binary, n long, id long")
