import os

import pytest

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
LONG = "lorem ipsum dolor sit amet consectetur " * 8000
#: Null ids and texts, empty, blank and very long texts, repeated rows, equal texts, odd white space.
ROWS = [
    (None, "a text without an id and some more words", "s1"), (1, None, None), (2, "", "s1"), (3, " \n\t ", "s2"), (4, LONG, "s2"),
    (5, "one two three four five six seven", "s1"), (5, "one two three four five six seven", "s1"), (6, "one  two three\nfour five six seven", None),
    (7, "Ünïcode wörds, ça va? 日本語 テスト", "ß"), (8, "\x00\x1c odd   spaces\r\n", "s1"), (None, None, None), (9, "short", "s2"), (9, "other text same id", "s2"),
]
#: Names that the operators use themselves.
EXTRA = ["digest", "size", "rep", "row", "class", "cut", "values", "kinds", "position", "bucket", "content", "file", "features", "score", "spans", "items", "copies", "tilt", "block"]


def frame(spark, rows, extra: bool = True):
    df = spark.createDataFrame([(i, t, s, None) for i, t, s in rows], "doc_id long, text string, source string, lang string")
    if not extra:
        return df
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit(c) for c in EXTRA})


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with clashing extra columns, over several partitions."""
    return frame(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r[0]: r[1] for r in documents.select("doc_id", "text").collect()}
