import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 97} term{i}." for i in range(9000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (3, ""),
    (4, None),
    (None, "write to foo.bar@example.com or +1 (017) 555-7713 from 10.0.0.1 and 300.1.1.1"),
    (5, LONG),
    (6, "Released under the MIT License.\nReleased under the MIT License.\nGNU General Public License ÉTÉ <|endoftext|> x"),
    (7, "aaaa aaaa aaaa aaaa ### *** 4845168114407329"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, an empty and a very long text, repeated rows, ties, and columns whose names operators use themselves."""
    df = spark.createDataFrame([(i, t, None if i == 1 else "en", None if i == 2 else "s") for i, t in TEXTS], "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "shard": F.lit("own"), "fp": F.lit(1), "key": F.lit(2), "row": F.lit(3)})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
