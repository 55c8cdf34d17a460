import random
import re

import pytest

from tallyweave.llm import decontaminate
from tallyweave.llm.decontaminate import TestSet as Tests

from .conftest import lower_ascii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _plain(texts, items, window):
    windows = {}
    for name, text in items:
        w = WORD.findall(lower_ascii(text or ""))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(name)
    out = []
    for text in texts:
        w, hit, found = WORD.findall(lower_ascii(text or "")), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((len(w), sorted(hit), sorted(found)))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_shards_against_plain_python(seed):
    rnd = random.Random(seed)
    letters = ["a", "B", "c", "é", "x9", "0"][: rnd.randint(1, 6)]
    items = [(str(i), " ".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14)))) for i in range(rnd.randint(0, 6))]
    texts = ["; ".join(rnd.choice([*letters, "zz"]) for _ in range(rnd.randint(0, 50))) for _ in range(rnd.randint(1, 9))]
    window = rnd.choice([1, 2, 3, 10])
    sizes, hits, found = decontaminate.find(texts, Tests.of(items, window))
    assert [(n, h.tolist(), f) for n, h, f in zip(sizes.tolist(), hits, found)] == _plain(texts, items, window)


@pytest.mark.parametrize("block", [10**6, 40, 1])
def test_blocks_of_the_benchmark_agree(spark, documents, block):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(30)]
    items = [(f"i{k}", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 15)))) for k in range(12)]
    texts = [" ".join([*(rnd.choice(words) for _ in range(20)), *(rnd.choice(items)[1].upper().split()[:10]), "tail"]) for _ in range(25)]
    texts += [None, "", "w1"]
    bench = spark.createDataFrame([*items, ("none", None)], "item_id string, text string")
    docs = documents(list(enumerate(texts)))
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, 5, block).collect()}
    plain = _plain(texts, items, 5)
    for i, (n, hit, found) in enumerate(plain):
        r = got[i]
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (n, len(hit), found)
        assert [k for s in r.spans for k in range(s.a, s.b)] == hit
        assert r.longest == max((s.b - s.a for s in r.spans), default=0)
    left = decontaminate.remove_contaminated(docs, bench, 5, block)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, p in enumerate(plain) if not p[1]}


def test_empty_benchmark(spark, documents):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.contamination(documents([(1, "a b")]), bench).first().n_hit == 0


def test_suffixes_are_sorted():
    tests = Tests.of([("i", "b a b a a b b a b a a b")], 10)
    shard = decontaminate.Shard(["b a b a a b b a b a", "a a b b x a b"], tests)
    own = [tuple(shard.words[s : s + 10]) for s in shard.suffixes]
    assert own == sorted(own) and len(own) > 5
