import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that the operators use inside must not clash
                     T.StructField("start", T.StringType()), T.StructField("fp", T.LongType()),
                     T.StructField("size", T.LongType()), T.StructField("score", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """make_docs([(doc_id, text), ...]) or rows with lang and source; extra columns have clashing names."""

    def make(rows):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, None, None)[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text), "x", 1, 2, "y"))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    """Nulls, empty, blank and long texts, repeated rows and ids, ties."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    return make_docs([
        (1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (1, "another text with the same id", "en", "a"),
        (2, None, None, None), (None, "a text without an id at all here", "de", "b"), (None, None, None, None),
        (3, "", "fr", "b"), (4, " \t\r\n\x0b\x0c ", "fr", "c"), (5, long, "es", "c"), (6, long, "es", "c"),
        (-7, "Ünïcode ſtraße İ Σς 가각 😀 a b", "de", "d"), (2**62, "<|endoftext|> 's don't! 12 ½", "en", "d")])
