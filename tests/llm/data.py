"""Rows that operators must stand: nulls, empty and long texts, ties, repeats, other columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the quick brown fox jumps over the lazy dog while seven wizards brew strong coffee in an old house by the sea"


def rows():
    long = " ".join(f"word{i}" for i in range(5000))
    return [
        (1, EN, "en", "a", 1),
        (2, EN, "en", "a", 1),
        (3, None, "en", "b", None),
        (4, "", None, "b", 0),
        (5, long, "en", None, 1),
        (6, " \t\n\r", "en", "b", 4),
        (7, "x", "en", "a", 1),
        (7, "x", "en", "a", 1),
        (8, EN.upper() + "\n" + EN, "en", None, 1),
        (9, "ñandú çedilla Ünïcode — 日本語 \U0001f600 " * 3, "es", "c", 1),
        (None, EN + " and more", "en", "c", 1),
    ]


def docs(spark, extra=()):
    return spark.createDataFrame([*rows(), *extra], DOCS)


def odd(spark):
    """More columns, named as operators might name their own."""
    from pyspark.sql import functions as F

    names = ["size", "target", "rank", "part", "tie", "kept", "node", "component", "a", "b", "copies", "place", "length", "n", "key", "sequence_id", "ahead", "n_words", "dropped", "taken_id", "taken_copy", "row", "told", "times", "of", "item"]
    return docs(spark).select("*", *[F.lit("clash").alias(n) for n in names])


def empty(spark):
    return spark.createDataFrame([], DOCS)
