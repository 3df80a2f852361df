"""Rows that every operator over documents must bear."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, bucket int, row_key string, a long, weight double, score double, component string"
LONG = "Lorem ipsum dolor sit amet. " * 20_000


def documents(spark, rows=None):
    rows = rows if rows is not None else [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s1"), (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"),
        (None, "no id but some words here to read", "en", "s2"), (4, LONG, None, "s2"), (5, "12345 !!! 678", "de", None), (6, "Der Weg ist das Ziel und der Anfang", "de", "s2"), (7, "   \n\t ", "de", "s3"),
        (8, 'token = "0123456789abcdef0123456789abcdef"', "en", "s1"),
    ]
    full = [(i, t, lang, s, None if t is None else len(t), 1, "k", 2, "r", 3, float("nan"), None, "c") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
