import pytest

DOCS = "doc_id bigint, text string"
#: NULL ids and texts, empty and blank texts, repeated rows and ids, a very long text.
EDGE = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, "the quick  brown\tfox jumps over the lazy dog"),
    (2, "another text under the same id, quite long enough"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "one two"),
    (6, "one two"),
    (None, "one  two"),
    (None, None),
    (7, "word " * 30000 + "end"),
    (8, "Ä ß  é ▁ x\u0000y <|endoftext|> </s> 日本語"),
]


@pytest.fixture()
def edge(spark):
    """The edge cases, with further columns named like some that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, DOCS)
    for name in ("digest", "key", "n", "kept", "h", "component", "score", "rank", "share", "step", "c0", "unit"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], DOCS)
