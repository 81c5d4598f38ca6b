import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["size", "h", "fp", "component_id", "part", "length", "n_lines", "target", "line", "tie", "copies", "edge", "__bucket", "score", "fingerprint", "sketch", "kept"]

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards box with jars of liquid opium under the old bridge near town".split()


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text, lang, source); clash adds columns with names that operators use."""

    def made(rows, clash=False, partitions=2):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA).repartition(partitions)
        return df.withColumns({c: F.lit("x") for c in EXTRA}) if clash else df

    return made


@pytest.fixture(scope="session")
def odd():
    """Nulls in any column, empty and blank texts, repeated rows, ties, and a very long text."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
    return [
        (1, "the quick brown fox\njumps over the lazy dog", "en", "a"), (1, "the quick brown fox\njumps over the lazy dog", "en", "a"),
        (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n ", "en", None), (None, "a null id", "en", "a"), (None, None, None, None),
        (5, long, "de", "b"), (6, long, "de", None), (7, "été à la plage 😀 token = abcdef0123", "fr", "c"), (8, "one", "fr", "c"), (9, "one two", "fr", "c"),
    ]
