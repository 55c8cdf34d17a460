import hashlib
import random

import numpy as np
import pytest

from tallyweave.llm import suffixes


def _plain(rows, match):
    first = {}
    data = [(suffixes.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - match + 1):
            first[b[s : s + match]] = min(first.get(b[s : s + match], (suffixes.LAST, 1 << 40)), (i, s))
    out = []
    for (i, b), (name, _) in zip(data, rows):
        gone = [False] * len(b)
        for s in range(len(b) - match + 1):
            if first[b[s : s + match]] < (i, s):
                gone[s : s + match] = [True] * match
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(name), len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_bytes_against_plain_python(documents, seed):
    rnd = random.Random(seed)
    letters = ["ab", "abc ", "aéb", "abcdefghijklmnopqrstuvwxyz\x00"][seed]
    pool = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(12)]
    rows = []
    for k in range(50):
        text = "".join(rnd.choice(pool)[rnd.randint(0, 5):] for _ in range(rnd.randint(0, 4)))
        rows.append((rnd.choice([None, k, k, k, rnd.randint(0, 60)]), None if rnd.random() < 0.1 else text))
    rows += rows[:5]
    match, gram = [(12, 4), (16, 5), (9, 3), (30, 24)][seed]
    got = suffixes.repeated_substrings(documents(rows).repartition(3), match, gram, rnd.choice([100, 700])).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == _plain(rows, match)


def test_production_sizes_and_digest(documents):
    rnd = random.Random(7)
    text = "".join(rnd.choice("abcdefgh \n") for _ in range(700))
    rows = [(1, text), (2, "start " + text[100:350] + "é end"), (3, text[:99]), (4, text)]
    got = suffixes.digests(suffixes.repeated_substrings(documents(rows))).collect()
    for r, plain in zip(sorted(got, key=lambda r: r.doc_id), _plain(rows, 100)):
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (*plain[1:4], hashlib.sha256(plain[4]).hexdigest())


def test_multikey_order():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (500, 21)).astype(np.uint8)
    assert [bytes(x[i]) for i in suffixes.multikey_order(x)] == sorted(map(bytes, x))
    assert len(suffixes.multikey_order(x[:0])) == 0


def test_every_string_holds_an_anchor():
    rng = np.random.default_rng(4)
    sizes = suffixes.Sizes(30, 8)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    block = suffixes.Block(data, np.array([1, 2]), np.array([0, 150, 400]))
    at, _ = block.anchors(sizes)
    for a, b in ((0, 150), (150, 400)):
        for s in range(a, b - 30 + 1):
            assert ((at >= s) & (at + 8 <= s + 30)).any()


@pytest.mark.parametrize("chunk", [1, 7, 50, 137])
def test_anchors_do_not_depend_on_the_chunk(chunk):
    rng = np.random.default_rng(5)
    sizes = suffixes.Sizes(30, 8)
    lengths = [0, 150, 29, 30, 0, 300, 5, 1]
    block = suffixes.Block(rng.integers(97, 100, sum(lengths)).astype(np.uint8), np.arange(len(lengths)),
                           np.r_[0, np.cumsum(lengths)])
    for whole, part in zip(block.anchors(sizes), block.anchors(sizes, chunk)):
        assert (whole == part).all()
