import pytest

#: Names of the operators' own columns, in other cases too, and one with a dot.
CLASHES = ("weight", "SIZE", "KEPT", "__text", "__key", "__k", "__base", "a.b", "SPANS", "Score", "shard", "Slot", "verdict", "HOST", "text_", "key", "n", "node", "comp", "row", "cls", "place", "N_WORDS", "target", "component_id", "keep_id", "in_0", "ids", "start", "base", "more", "found", "all", "ends", "rank", "at", "text0", "gaps", "words", "url", "token", "site", "hash", "prefix", "from", "bytes", "again", "cell", "before", "upto", "range", "tie", "ident")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and a column that clashes."""
    prose = "The quick brown fox jumps over the lazy dog near the quiet river bank today. "
    rows = [
        (1, prose * 3, "en", "a", 10),
        (2, prose * 3, "en", "a", 10),
        (2, prose * 3, "en", "a", 10),
        (None, prose * 3, None, None, None),
        (3, "", "en", "b", 0),
        (4, None, "en", "b", None),
        (5, " \n\t ", "en", None, 4),
        (6, "one", "en", "c", 3),
        (7, "word " * 60_000, "en", "c", 300_000),
        (8, "é" * 5000 + " ü\u00a0x", "fr", "é", 9),
    ]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("mine")).withColumn("size", F.lit("mine"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
