"""Rows that are hard for text operators."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int, kept string, size string, block int, z string, ranges string"


def row(doc_id, text, source="s"):
    return (doc_id, text, "en", source, None if text is None else len(text), "x", 1, "y", "w", 2, "v", "u")


@pytest.fixture(scope="session")
def hard(spark):
    """Null ids, texts and sources, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"word{i * i % 9973}" for i in range(30000))
    rows = [row(1, "a b c d e f g h i j k l"), row(1, "a b c d e f g h i j k l"), row(2, "a b c d e f g h i j k l"), row(None, None), row(None, ""), row(None, "x y z"), row(3, ""), row(4, None, None), row(5, "one"), row(6, "One\tTWO\n"), row(7, long), row(8, long + " tail", None), row(9, "été " * 300, "t"), row(10, " \t\n\x0b\x0c\r "), row(11, "é" * 500)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
