"""Documents with every awkward case at once."""

from __future__ import annotations

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size string, target int, `row` string, uid int, id string, v int, label int, part int, fp string, w string, key string"
)


def odd_rows() -> list[tuple]:
    words = " ".join(f"word{i % 97}" for i in range(400))
    long = "\n".join(f"line {i} of a very long text that goes on and on" for i in range(4000))
    base = [
        (1, words, "en", "a"),
        (1, words, "en", "a"),  # a repeated row
        (2, words, "en", "a"),  # a copy
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (5, " \n\t ", "fr", None),
        (None, "no id but some words here", "en", "b"),
        (None, None, None, None),
        (6, long, "en", "b"),
        (7, "x" * 200_000, "de", "b"),
        (8, "one", "de", "c"),
        (9, "日本語 \U0001f600 é ü ß", "xx", "c"),
        (-10, "minus " * 60, "en", "c"),
    ]
    return [(*r, None, "s", 1, "r", 2, "i", 3, 4, 5, "f", "w", "k") for r in base]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
