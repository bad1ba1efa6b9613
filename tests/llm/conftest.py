from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, stem string, extra int"
#: Names that operators use inside.
INSIDE = "_doc _gone _kept _doc_id _sid _size _copies _rows _place _share _copy __doc _SIZE sid site size copies rows n_lines n_removed labelled quality counted labels score lang_pred ids fp node root component_id bucket h size0 patterns shown".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns that operators use inside."""
    long = "alpha beta gamma delta " * 20_000
    rows = [
        (0, "The quick brown fox jumps over the lazy dog.\nAnd again it ran.", "en", "a", 60, "k", "s", 1),
        (1, "The quick brown fox jumps over the lazy dog.\nAnd again it ran.", "en", "a", 60, "k", "s", 1),
        (1, "The quick brown fox jumps over the lazy dog.\nAnd again it ran.", "en", "a", 60, "k", "s", 1),
        (2, None, "en", "b", None, None, None, None),
        (3, "", None, None, 0, "", "", 0),
        (None, "words without an id", "en", "b", 19, "x", "y", 2),
        (4, long, "en", "b", len(long), "x", "y", 2),
        (5, "x" * 50_000, "de", "c", 50_000, "x", "y", 2),
        (6, " \t\r\n\x0b\x0c ", "fr", "", 7, "x", "y", 2),
        (7, "Ärger über größere Öfen, naïve Ünïcödé 漢字 😀 　 end", "de", "c", 50, "x", "y", 2),
        (8, "#*$%&|<> !!! ???", "es", "c", 16, "x", "y", 2),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns of names that operators use inside."""
    from pyspark.sql import functions as F

    lower = {c.lower() for c in odd.columns}
    names = [n for k, n in enumerate(INSIDE) if n.lower() not in lower | {x.lower() for x in INSIDE[:k]}]
    return odd.select("*", *[F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names])
