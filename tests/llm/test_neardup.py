import math
import random

import numpy as np
import pytest

from tallyweave.llm import neardup
from tallyweave.llm.common import lowered_words, shingle_hashes

from .conftest import ODD, WORDS, connected, lower_ascii


def _sets(rows):
    out = {}
    for i, text in rows:
        w = WORDS.findall(lower_ascii(text or ""))
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        out.setdefault(i, []).append(own)
    return out


def _plain(rows, threshold):
    sets = _sets(rows)
    links = [(a, b) for a in sets for b in sets if a < b and any(
        u and v and 100 * len(u & v) >= threshold * len(u | v) for u in sets[a] for v in sets[b])]
    return connected(sets, links)


def _family(rnd, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("threshold", [80, 85])
def test_groups_against_all_pairs(documents, threshold):
    rnd = random.Random(threshold)
    texts = []
    for size, edits in ((25, 3), (12, 6), (6, 1), (40, 4)):
        texts += _family(rnd, [f"w{rnd.randrange(500)}" for _ in range(90)], size, edits)
    chain = [f"c{k}" for k in range(120)]
    texts += [" ".join(chain[k : k + 60]) for k in range(0, 40, 2)]  # neighbours are alike, ends are not
    texts += ["Same Words Here", "same words here", "same words", ""] * 2
    rnd.shuffle(texts)
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    want = _plain(rows, threshold)
    got = neardup.near_duplicates(documents(rows), threshold).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    sets = _sets(rows)
    assert all(r.n_shingles == len(sets[r.doc_id][0]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_rounds_resolve_a_bucket_without_common_centre(spark, documents, monkeypatch):
    # all texts in one bucket, though most are unlike: every pair must still be decided
    monkeypatch.setattr(neardup, "BAND_ROWS", 1)
    monkeypatch.setattr(neardup, "MARGIN", 50.0)
    rnd = random.Random(5)
    shared = [f"s{k}" for k in range(50)]
    texts = []
    for _ in range(9):
        own = shared + [f"o{rnd.randrange(10**6)}" for _ in range(50)]
        texts += _family(rnd, own, 2, 1)
    rows = list(enumerate(texts))
    got = neardup.near_duplicates(documents(rows), 80).collect()
    assert {r.doc_id: r.component_id for r in got} == _plain(rows, 80)


def test_odd_rows(documents):
    got = {}
    for r in neardup.near_duplicates(documents(ODD)).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == got[2] == got[3][:1] and got[1] == [(0, 1, True)] or got[1] == [(0, 1, True)]
    assert got[2] == [(0, 2, True)]
    assert {x[1] for x in got[5]} == {4} and got[5][0][2] is False
    assert all(x[1] is None and x[2] for x in got[None])


def test_one_of_each_group_stays(documents):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z"), (3, "x y z"), (4, ""), (None, "x y z")]
    out = neardup.deduplicate(documents(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(
        [(1, "a b c d e f g"), (3, "x y z"), (4, ""), (None, "x y z")], key=str)


def test_components_of_a_long_path(spark):
    n = 200
    order = random.Random(2).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


def test_corrected_estimate(spark):
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(400)]
    other = base[:330] + [f"x{k}" for k in range(70)]
    rows = [(0, " ".join(base)), (1, " ".join(other)), (2, " ".join(rnd.sample(base, 400)))]
    bands = 31
    signed = neardup.signatures(spark.createDataFrame(rows, "doc_id long, text string"), bands)
    a, b, c = (signed.filter(f"doc_id = {i}") for i in range(3))
    from pyspark.sql import functions as F
    def est(x, y):
        both = x.select(F.col("bits").alias("p")).crossJoin(y.select(F.col("bits").alias("q")))
        return both.select(neardup.estimate(F.col("p"), F.col("q"), bands * neardup.BAND_ROWS)).first()[0]
    sets = [set(shingle_hashes(lowered_words(t), 5).tolist()) for _, t in rows]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert est(a, a) == 1.0 and abs(est(a, b) - true) < 0.15 and abs(est(a, c)) < 0.15
    assert neardup.least_estimate(80, 124) < 0.6 and neardup.bands_for(80) == bands


def test_minima_do_not_depend_on_the_block():
    h = np.random.default_rng(1).integers(0, 2**63, 999).astype(np.uint64)
    assert (neardup.minima(h, 60, at_once=7) == neardup.minima(h, 60)).all()


@pytest.mark.parametrize("threshold, common, union", [(85, 6, 7), (85, 20, 23), (80, 4, 5)])
def test_pairs_at_the_threshold_are_not_lost(threshold, common, union):
    bands = neardup.bands_for(threshold)
    n = bands * neardup.BAND_ROWS
    chance = 2.0 ** -neardup.BITS
    rng = np.random.default_rng(union)
    agree, lost = [], 0
    for _ in range(12000):
        h = rng.integers(0, 2**64, union, dtype=np.uint64)
        u, v = neardup.minima(h, n), neardup.minima(h[:common], n)
        estimate = (((u ^ v) % 2**neardup.BITS == 0).mean() - chance) / (1 - chance)
        in_band = (u == v).reshape(bands, neardup.BAND_ROWS).all(axis=1).any()
        lost += estimate < neardup.least_estimate(threshold, n) or not in_band
        agree.append((u == v).sum())
    j = common / union
    # a binomial count; minima that agree together spread further
    assert lost == 0 and 0.92 < np.var(agree) / (n * j * (1 - j)) < 1.08


@pytest.mark.parametrize("threshold", [80, 85])
def test_estimate_misses_no_more_than_bands(threshold):
    n = neardup.bands_for(threshold) * neardup.BAND_ROWS
    chance = 2.0 ** -neardup.BITS
    agree = chance + (1 - chance) * threshold / 100
    dropped = [k for k in range(n + 1) if (k / n - chance) / (1 - chance) < neardup.least_estimate(threshold, n)]
    assert sum(math.comb(n, k) * agree**k * (1 - agree) ** (n - k) for k in dropped) <= neardup.MISSED
