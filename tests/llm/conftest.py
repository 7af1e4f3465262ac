import pytest

#: Texts that every operator must take: none, empty, white space, repeated words, one very long word, symbols.
ODD = [None, "", " \t\n\x0b ", "a", "one two three", "x " * 300, "y" * 50_000, "é ß 日本 👍 ' \" \\ %", "\n\n\n", "tail\n"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, null and repeated keys, repeated rows, and extra columns of names that operators use inside."""
    rows = [(i if i % 4 else None, t, "s" if i % 3 else None, "x", i, None) for i, t in enumerate(ODD)]
    rows += rows[:4] + [(7, "one two three", "s", "x", 0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row string, h int, word string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
