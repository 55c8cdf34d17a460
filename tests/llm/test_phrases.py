"""Phrase counts and collocations against counting every phrase in plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import phrases

from .conftest import ODD, lower_ascii


def _counts(rows, order):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_ascii(text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, order + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    return f, n


def _plain(rows, order, least, top, inside):
    f, n = _counts(rows, order)
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    held = Counter()
    for (lang, words), a in found.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                inner = lang, words[i : i + size]
                held[inner] = max(held[inner], a)
    out = {}
    for (lang, words), a in found.items():
        if held[lang, words] and 100 * held[lang, words] >= inside * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                  for lang, each in out.items() for i, (s, a, p, left, right) in enumerate(sorted(each)[:top]))


def _rows(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def texts(spark):
    return lambda rows: spark.createDataFrame(rows, "text string, lang string").withColumns(
        {"doc_id": F.lit(1), "phrase": F.lit("x"), "w1": F.lit(0), "size": F.lit(""), "f": F.lit(1)})


def _corpus(n, seed=5):
    pick = random.Random(seed)
    words = ["the", "The", "of"] * 6 + ["new", "york", "city", "hong", "kong", "é", "日本", "a-b", "x"] * 2 + [f"w{i}" for i in range(40)]
    glue = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "! "]
    fixed = ["new york city", "hong kong", "New York", "machine learning model"]
    out = []
    for i in range(n):
        parts = [pick.choice(words) if pick.random() < 0.8 else pick.choice(fixed) for _ in range(pick.randint(0, 40))]
        out.append(("".join(w + pick.choice(glue) for w in parts), pick.choice(["en", "en", "en", "fr", None, ""])))
    return out


@pytest.mark.parametrize("order,least,top,inside", [(3, 10, 2000, 50), (3, 3, 7, 50), (4, 4, 2000, 80), (2, 1, 2000, 50), (5, 2, 50, 100)])
def test_against_plain_python(texts, order, least, top, inside):
    rows = _corpus(150) + [("new york city hall " * 12, "en"), ("x x x x x x x x x x x x", "fr")]
    got = _rows(phrases.collocations(texts(rows).repartition(5), order, least, top, inside))
    assert got == _plain(rows, order, least, top, inside)
    assert got


def test_every_count_follows_from_the_longest_windows(texts):
    rows = _corpus(60)
    f, n = _counts(rows, 3)
    got = {(r.lang, r.phrase): r.f for r in phrases.phrase_counts(texts(rows), 3, 1).collect() if r.size}
    assert got == {(lang, " ".join(w)): c for (lang, w), c in f.items()}
    totals = {r.lang: r.f for r in phrases.phrase_counts(texts(rows), 3, 10**6).collect()}
    assert totals == {lang: c for lang, c in n.items() if c}
    for at_once in (phrases.AT_ONCE, 1, 70):
        counted = phrases.unpacked(phrases.packed_windows(texts(rows), 3, at_once))
        assert counted.agg(F.sum("c")).first()[0] == sum(n.values())
        longest = counted.filter("tail <> ''").groupBy("lang", F.concat_ws(" ", "lead", "tail")).agg(F.sum("c"))
        assert {tuple(r)[:2]: r[2] for r in longest.collect()} == {k: c for k, c in got.items() if k[1].count(" ") == 2}


def test_one_shuffle_counts_windows_and_pairs(texts):
    plan = phrases._long_counts(texts(_corpus(5)), 3, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_odd_input_and_empty_tables(documents, odd):
    rows = [(t, "en" if (i or 0) % 2 else "de") for i, t in ODD]
    assert _rows(phrases.collocations(odd, least=2)) == _plain(rows, 3, 2, 2000, 50)
    assert phrases.collocations(odd.filter("1 = 0")).collect() == []
    assert phrases.collocations(documents([(1, None), (2, " . , ")])).collect() == []


def test_products_beyond_64_bits(spark):
    a, left, right = 4_000_000_000, 3_999_999_999_999, 5_000_000_007
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(
        phrases._exact_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 10**6 * a * a // (left * right)
    big = 3 * 10**15
    row = spark.createDataFrame([(big, big, big + 1)], "a long, l long, r long").select(
        phrases._exact_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 10**6 * big * big // (big * (big + 1)) == 999_999
