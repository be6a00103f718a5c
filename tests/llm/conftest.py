import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and blank texts, a very long text, ties, repeated rows, extra columns with clashing names."""
    long_text = " ".join(f"word{i % 977} the of and" for i in range(60_000))
    rows = [
        (1, "the cat sat on the mat and looked at the dog near the door", "en", "a"), (1, "the cat sat on the mat and looked at the dog near the door", "en", "a"),
        (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "en", "b"), (5, "...!!! 123", None, "b"), (None, "un texte sans numéro pour la forme", "fr", "c"),
        (None, None, None, None), (6, long_text, "en", "a"), (7, long_text, "en", "a"), (8, "a\\b <turn> 'quoted' \"x\" </turn>\n\n\n", "en", "d"), (9, "\U0001f600 emoji and ünïcode ß İ", "de", "d"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("key", "score", "shard", "w", "_s", "size", "part", "language", "at", "n"):  # names that operators use inside
        df = df.withColumn(name, F.lit(f"extra {name}"))
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
