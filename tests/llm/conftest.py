import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def connected(nodes, links):
    """Smallest node reachable from each node."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.fixture(scope="session")
def documents(spark):
    """``documents([(id, text), ..])`` with the other columns, and some of clashing names."""
    def make(rows):
        shape = ("doc_id long, text string, lang string, source string, n_chars long, node string, bucket int, "
                 "label string, spans string, near_key int, line_gone int, line_id int, h int")
        return spark.createDataFrame(
            [(i, t, ("en" if (i or 0) % 2 else "de"), "s", len(t or ""), "n", 1, "l", "x", 2, 3, 4, 5) for i, t in rows],
            shape)

    return make


#: Nulls in either column, empty and blank texts, repeated rows, ties, odd characters, a long text.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (None, "a text without an id, with some words in it"), (None, None),
    (4, "one two three four five six"), (4, "one two three four five six"), (4, "another text of the same id"),
    (5, "one two three four five six"), (6, "é▁日本 \x00 \x01 x y 😀😀"), (7, "word " * 30_000), (8, "x" * 150_000),
    (9, "\n".join(["line a", "line b", "line c"] * 40)), (10, "!!! ### 123 $$$"),
]


@pytest.fixture
def odd(documents):
    return documents(ODD)
