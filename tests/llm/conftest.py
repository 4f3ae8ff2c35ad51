import pytest
from pyspark.sql import types as T

LONG = "alpha beta gamma " * 30_000


def edge_texts():
    """Null, empty, blank, one word, repeats, very long, odd characters."""
    return [None, "", "   \n\t ", "word", "two words", "a b c d e f g h i j", "a b c d e f g h i j", LONG, "naïve Ünïcode 漢字 😀 ﬁ", "x" * 100_000, "\u0000\u001c end", "...!!!"]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents of all edge cases: a null id, repeated ids and rows, extra columns with clashing names."""
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, "src", 0, "clash", 1.5) for i, t in enumerate(edge_texts())]
    rows.append(rows[5])
    names = ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "score"]
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.LongType(), T.StringType(), T.DoubleType()]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(12)] + [(None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
