import pytest


@pytest.fixture(scope="session")
def shared(spark):
    """The session; without a named folder a local one stores its steps in its own."""
    return spark


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, part int, node long, r string"


@pytest.fixture
def docs(shared):
    """Makes a documents table from (doc_id, text) pairs, with extra columns whose names the operators use themselves."""

    def make(rows, sources=None):
        data = [(i, t, "en", (sources or {}).get(i, "s"), len(t) if t is not None else None, "x", 1, 2, "r") for i, t in rows]
        return shared.createDataFrame(data, DOCS)

    return make


LONG = " ".join(f"w{i % 997}é" for i in range(30_000))
#: NULL and empty texts, blanks only, a long text, repeated rows, equal texts, odd blanks and signs, a NULL id.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "one two three four five six"), (5, "one two three four five six"), (6, "one two three four five six"),
    (7, "  a  b\n\nc  d e 12³ don't!! \U0001f600 "), (8, "x"), (None, "lost words without an id"), (None, None), (9, "a\x00b\x1cc"), (10, "<|endoftext|> end"),
]
