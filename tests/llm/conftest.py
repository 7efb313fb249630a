from __future__ import annotations

import pytest


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names the operators use inside.
CLASHES = ("fp", "h", "pos", "n", "root", "cell", "a", "b", "did", "th", "counts", "removed", "first", "site", "found", "token")


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text[, source]) rows as documents, with extra columns of clashing names."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES])

    return build


PROSE = (
    "the river of the valley was wide and it ran to the sea by a town that is old and in the north of the land "
    "there were fields for the people who came with their carts at dawn"
)


@pytest.fixture(scope="session")
def hostile_rows():
    """Nulls, empties, blanks, a very long text, ties and repeated rows."""
    long_text = " ".join(f"word{i % 977} the of and to" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (5, "one two"), (6, PROSE), (7, PROSE), (8, PROSE + " late"),
        (8, PROSE + " late"), (None, PROSE), (None, "other text of nobody"), (9, long_text), (10, "▁ <|im_end|> \x00 é你😀"),
        (11, PROSE.upper()), (12, "x" * 70_000),
    ]


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


