"""Small tables for the operator tests: every awkward row once."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with nulls in every column, empty and long texts, copies, repeated ids."""
    base = " ".join(f"word{k % 37}x{k}" for k in range(120))
    rows = [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (3, None, None, None, None),
        (4, "", "", "", 0),
        (5, " \n\t ", "en", "b", 4),
        (6, "Zürich  größer\n\nça va?  'tis   ok ", "de", "b", 30),
        (7, base + " tail of its own " + base, "en", None, 1),
        (8, "one two three", "en", "c", 13),
        (8, "one two three", "en", "c", 13),
        (8, "four five", "en", "c", 9),
        (None, "no id here at all", "en", "c", 17),
        (9, "long " * 40_000, "en", "c", 200_000),
        (-5, "ONE Two\x00three \x1c x", "en", "c", 5),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    """An empty documents table."""
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def pairs(awkward) -> list[tuple]:
    """(doc_id, text) of the awkward rows."""
    return [(r.doc_id, r.text) for r in awkward.collect()]
