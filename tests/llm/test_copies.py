"""Exact copies against grouping by the whole text, with strong and with colliding fingerprints."""

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyweave.llm import copies

from .conftest import ODD


def _plain(rows):
    texts = [t or "" for _, t in rows]
    size, top = Counter(texts), {}
    for (i, _), t in zip(rows, texts):
        if i is not None:
            top[t] = max(i, top.get(t, i))
    return sorted(
        ((i, top.get(t), size[t], i == top.get(t), hashlib.sha256(t.encode()).hexdigest())
         for (i, _), t in zip(rows, texts)), key=str)


def _rows(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


LONG = "".join(f"{i} é " for i in range(60_000))
ROWS = [*ODD, (20, LONG), (21, LONG), (22, LONG + "x"), (23, "x" + LONG), (23, LONG), (None, LONG),
        *((100 + i, "copy of a page") for i in range(50)), (30, "ab"), (31, "ba"), (32, "ab"), (33, "\x00"), (34, "\x00\x00")]


@pytest.mark.parametrize("chunk", [7, 4096, copies.CHUNK])
def test_against_whole_texts(documents, chunk):
    rows = ROWS if chunk > 1000 else [r for r in ROWS if len(r[1] or "") < 400]
    assert _rows(copies.exact_copies(documents(rows), chunk=chunk)) == _plain(rows)


@pytest.mark.parametrize("bits", [64, copies.FILTER_BITS])
def test_texts_that_share_a_fingerprint_are_told_apart(documents, bits):
    """By base 1 a fingerprint is the sum of the bytes, so letters in any order collide."""
    rows = [(i, t) for i, t in enumerate(["abc", "bca", "abc", "cab", "bbb", "", None, "abc", "xyz"] + ["listen", "silent"] * 9)]
    out = copies.exact_copies(documents(rows), bases=(1, 1), chunk=4, bits=bits)
    assert _rows(out) == _plain(rows)
    assert out.select("f0").distinct().count() < len({t or "" for _, t in rows})


def test_equal_marks_do_not_hide_a_collision(documents, monkeypatch):
    """With a mark that every text shares, only the chunks tell texts of one fingerprint apart."""
    monkeypatch.setattr(copies.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    rows = [(1, "abcdef"), (2, "abcfed"), (3, "abcdef"), (4, "other")]
    assert _rows(copies.exact_copies(documents(rows), bases=(1, 1), chunk=3)) == _plain(rows)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 40))
def test_chunks_compose_to_the_whole(data, chunk):
    plain = [sum(b * pow(base, len(data) - 1 - i, copies.MODULUS) for i, b in enumerate(data)) % copies.MODULUS
             for base in copies.BASES]
    assert copies.fingerprint(data, chunk=chunk) == plain


def test_normalized_texts(documents):
    rows = [(1, "A b"), (2, "a B"), (3, "c")]
    got = {r.doc_id: r.keep_id for r in copies.exact_copies(documents(rows), normalize=F.lower).collect()}
    assert got == {1: 2, 2: 2, 3: 3}


def test_deduplicate_keeps_the_columns(odd):
    out = copies.deduplicate(odd)
    assert out.columns == odd.columns
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert kept == {(i, t) for i, t in ODD if (i, t) not in [
        (1, None), (None, None), (4, "one two three four five six")]}
