"""Ranked search against scoring every document in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyweave.llm import ranked

from .conftest import ODD, lower_ascii

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _plain(docs, items, k=10):
    held = [(i, Counter(TERM.findall(lower_ascii(t or "")))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(TERM.findall(lower_ascii(t or "")))
    out = []
    for item, own in terms.items():
        scored = []
        for doc, counts in held:
            m = 100 - 90 + 90 * counts.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * counts[t] // (1000 * counts[t] + 8 * m)) for t in own if counts[t])
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def _rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def _corpus(n, seed=3):
    """Words of very different frequency, texts of very different length, many equal ones."""
    pick = random.Random(seed)
    words = ["the"] * 60 + ["of"] * 30 + [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(pick.choices(words, k=pick.choice([1, 3, 8, 8, 8, 40, 200])))) for i in range(n)]
    return docs + [(n + i, "the same page of w7 and w8") for i in range(n // 3)]


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


ITEMS = [(1, "The w7 of W8, w9"), (2, "the"), (3, None), (4, "unknown words"), (5, "w1 w1 w1 w2"), (1, "w50"), (None, "w3 w4"),
         *((10 + i, " ".join(f"w{j}" for j in range(i, i + 25))) for i in range(20))]


@pytest.mark.parametrize("segment,block,cells", [(ranked.SEGMENT_CHARS, ranked.BLOCK_TERMS, ranked.CELLS), (300, 40, 2000), (1, 1, 1)])
def test_against_every_document(documents, items, monkeypatch, segment, block, cells):
    docs = _corpus(120 if segment == 1 else 400)
    asked = ITEMS[:9] if segment == 1 else ITEMS
    monkeypatch.setattr(ranked, "CELLS", cells)
    index = ranked.build_index(documents(docs).repartition(5), segment_chars=segment)
    assert _rows(ranked.search(index, items(asked), block_terms=block)) == _plain(docs, asked)


def test_odd_documents(documents, items):
    asked = [(1, "one two word"), (2, "é▁日本 x"), (3, "x" * 150_000), (4, "123 text an id"), (5, "")]
    index = ranked.build_index(documents(ODD))
    assert _rows(ranked.search(index, items(asked), k=20)) == _plain(ODD, asked, 20)
    sizes = [len(TERM.findall(t or "")) for _, t in ODD]
    assert (index.n_docs, index.n_terms) == (sum(map(bool, sizes)), sum(sizes))


def test_empty_tables(documents, items):
    index = ranked.build_index(documents(ODD).filter("1 = 0"))
    assert ranked.search(index, items([(1, "a")])).collect() == []
    assert ranked.search(ranked.build_index(documents([(1, None)])), items([(1, "a")])).collect() == []
    assert ranked.search(ranked.build_index(documents(ODD)), items([])).collect() == []


def test_strata_hold_one_length_and_postings_by_frequency(documents):
    docs = _corpus(100)
    index = ranked.build_index(documents(docs), segment_chars=2000)
    held, texts = Counter(), dict(docs)
    for row in index.strata.collect():
        found = [ranked.count_terms(texts[d]) for d in row.docs]
        assert {10 + 90 * c.total() * index.n_docs // index.n_terms for c in found} == {row.m}
        groups, tfs, sizes, places = (np.frombuffer(row[c], np.int32).tolist() for c in ("groups", "tfs", "sizes", "places"))
        group = place = 0
        for term, n in zip(row.terms.split(" "), groups, strict=True):
            assert tfs[group : group + n] == sorted(set(tfs[group : group + n]))
            for tf, size in zip(tfs[group : group + n], sizes[group : group + n]):
                for p in places[place : place + size]:
                    assert found[p][term.encode()] == tf
                    held[term] += 1
                place += size
            group += n
        assert place == len(places) == sum(map(len, found))
    assert held == {r.term: r.df for r in index.lexicon().collect()}
    terms = sorted(held) + ["absent"]
    assert ranked.document_counts(index, terms).tolist() == [held[t] for t in terms]


def test_weak_strata_are_passed_over():
    """Long documents cannot beat short ones that hold every term, so their strata are not scored."""
    import pyarrow as pa

    docs = [(i, "w1 w2 w3") for i in range(600)] + [(1000 + i, "w1 " + "x " * 4000) for i in range(600)]
    found = [ranked.count_terms(t) for _, t in docs]
    total, segment = sum(c.total() for c in found), ranked.Segment()
    for (i, text), c in zip(docs, found):
        segment.add(i, c, 10 + 90 * c.total() * len(docs) // total, len(text))
    whole = pa.Table.from_batches(segment.strata()).filter(pa.compute.field("m") >= 0).combine_chunks().to_batches()[0]
    seen = ranked.Search(ranked.Items(["1"], ["w1", "w2", "w3"], np.full(3, 5), [np.arange(3)]), 10)
    seen.add(whole)
    assert [d for _, d, _ in seen.found()] == list(range(10))
    assert (seen.visited, seen.passed) == (2, 1)


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(ranked, "PIECE", 5)
    text = "Ab cd-ef, ünïcode 12ab\x00z" * 20
    assert ranked.count_terms(text) == Counter(t.encode() for t in TERM.findall(lower_ascii(text)))
