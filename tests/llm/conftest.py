import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        # Names that the operators use themselves.
        *[T.StructField(n, T.StringType()) for n in ("doc", "body", "mark", "score", "block", "digest", "value", "item", "w", "h1", "__doc")],
    ]
)


def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = "lorem ipsum dolor sit amet " * 20000
    plain = [
        (1, "the quick brown fox jumps over the lazy dog again and again until night", "en"),
        (1, "the quick brown fox jumps over the lazy dog again and again until night", "en"),
        (2, "", "en"),
        (3, None, "en"),
        (None, "a row without an id but with words enough to be looked at", "en"),
        (None, None, None),
        (4, "   \n\t ", None),
        (5, long, "la"),
        (6, "x" * 100000, "xx"),
        (7, "12345 !!! ###", "en"),
        (8, "the quick brown fox jumps over the lazy dog again and again until night", "en"),
    ]
    return [(*r, *["?"] * (len(SCHEMA) - 3)) for r in plain]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def keyed(df, *keys):
    return sorted((tuple(r) for r in df.select(*keys, *[c for c in df.columns if c not in keys]).collect()), key=repr)


def count_by_id(df):
    return {r[0]: r[1] for r in df.groupBy("doc_id").agg(F.count("*")).collect()}
