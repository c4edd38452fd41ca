from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor sit amet " * 20000


@pytest.fixture
def odd(spark):
    """Null ids and texts, empty and very long texts, repeated rows, columns with clashing names."""
    rows = [(1, None, "s", "x"), (2, "", "s", "x"), (None, "a b c d e f g", "s", None), (3, LONG, None, "x"), (4, LONG, "s", "x"), (4, LONG, "s", "x"),
            (5, " \n\t\n ", "s", "x"), (6, "a" * 50000, "s", "x")]
    return spark.createDataFrame([(i, t, s, "en", x, x) for i, t, s, x in rows], "doc_id long, text string, source string, lang string, id string, fp string")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")
