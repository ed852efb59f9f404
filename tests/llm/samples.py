"""Small tables for the operators: special rows, a writer for whole tables, plain word splitting."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, stem=""):
    rng = random.Random(seed)
    return [stem + "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def special_rows():
    """Nulls in every column, empty and blank texts, repeated rows, equal texts under other ids, a very long text."""
    body, tail = " ".join(words(60, 1)), " ".join(words(40, 2))
    long_text = " ".join(words(40_000, 3)) + " " + body
    rows = [(1, body, "en", "a", 1), (2, body, "en", "b", 1), (3, "x " + body + " y", None, "a", None), (4, None, "en", "b", 0), (5, "", "de", None, 0),
            (6, " \t\n\x0b ", "de", "a", 0), (None, body, "en", "a", 1), (None, None, None, None, None), (7, tail, "fr", "c", 2), (7, tail, "fr", "c", 2),
            (8, "same " * 80, "fr", "c", 3), (9, "12 34 !!", "de", "c", 8), (10, long_text, "en", "a", 9), (11, "Ünïcode wörds 😀 ok", "de", "b", 4),
            (12, tail + " tail", "fr", None, 2)]
    return rows


def frame(spark, rows, schema=DOCS, **extra):
    """A frame of the rows; extra adds constant columns, to clash with working names."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else df


def split(text):
    return (text or "").encode().split()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
