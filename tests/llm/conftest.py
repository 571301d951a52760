import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        *[T.StructField(n, T.StringType()) for n in ("fp", "shard", "part", "marks", "did", "component", "size", "line", "host")],
    ]
)


def words(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty, blank and very long texts, copies, near copies, repeated rows, a null id."""
    base, passage = words("w", 120), " ".join(words("p", 60))
    long = " ".join(words("long", 30_000))
    texts = [
        (1, " ".join(base)),
        (2, " ".join(base)),
        (3, " ".join(base[:60] + ["other"] + base[61:])),
        (4, None),
        (5, ""),
        (6, " \t\n \u000b "),
        (7, "one"),
        (8, "One"),
        (9, f"head {passage} tail"),
        (10, f"start\n{passage}\nend of it"),
        (11, long),
        (12, f"{long} more"),
        (13, " ".join(["same"] * 100)),
        (14, "häß üb er 中文 \U0001f600 12 'll don't  two  blanks "),
        (15, "!?! 123 ..."),
        (15, "!?! 123 ..."),
        (16, f"{passage} {passage}"),
        (None, "a text without an id but with words"),
        (None, None),
    ]
    langs, sources = ["en", "de", None], ["a", "a", "b", None]
    return [
        (i, t, langs[n % 3], sources[n % 4], None if n % 2 else n, *["x" if n % 3 else None] * 9)
        for n, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
