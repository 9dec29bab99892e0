"""Small tables and plain reference implementations for the tests of the operators."""

import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# NULLs in every column, empty texts, repeated rows, ids that repeat with other texts, and columns named like internal ones
ODD_ROWS = [
    (1, "A b c d e f g", "en", None, 13, "x"), (1, "A b c d e f g", "en", None, 13, "x"), (2, None, None, "a", None, None),
    (3, "", "en", "b", 0, "y"), (None, "a b c d e f g", None, "b", 13, None), (None, "zz  q", "de", "c", 5, "z"),
    (5, "ZZ  q", None, None, 5, "z"), (6, "n", "de", "a", 1, "z"), (1, "other text", "en", "a", 10, "q"),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)
