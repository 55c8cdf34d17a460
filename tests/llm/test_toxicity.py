import random
import zlib

import numpy as np
import pytest

from tallyweave.llm import toxicity

CLEAN = [a + b for a in ("han", "ter", "lis", "mor", "ven", "dal", "sun", "pel") for b in ("ting", "der", "ous", "al", "en", "ity")]
BAD = ["stupid", "moron", "worthless"]


def _texts(n, seed):
    rnd = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        words = [rnd.choice(CLEAN) for _ in range(rnd.randint(30, 80))]
        if k % 3 == 0:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        labels.append(int(k % 3 == 0))
        texts.append(" ".join(w + rnd.choice(["", "", "", ".", "\n"]) for w in words))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*_texts(240, 1))


def test_held_out_documents(model):
    texts, labels = _texts(150, 2)
    got = [s >= 0.5 for s in toxicity.Scorer(model).score(texts)]
    assert sum(g == bool(y) for g, y in zip(got, labels)) >= 0.97 * len(labels)


def test_gapped_and_inserted_characters(model):
    scorer = toxicity.Scorer(model)
    plain = " ".join(CLEAN[:30])
    assert scorer.score([plain])[0] < 0.5
    for word in ("stuupid", "st.upid", "s.t.u.p.i.d", "stxupid", "worth-less", "w o r t h l e s s", "m*o*r*o*n"):
        twice = f"{plain} {word} {plain} {word}. {word}"
        assert scorer.score([twice])[0] >= 0.5, word
    assert toxicity.sentences("you s t u p i d one.\nnext") == [["you", "stupid", "one."], ["next"]]
    assert {"you", "stupid", "one.", "next"} <= toxicity.tokens("you s t u p i d one.\nnext")


def test_kernel_is_the_gapped_subsequence_kernel():
    def plain(s, t):
        def features(w):
            w, out = "^" + w, {}
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, len(w)):
                        if k - i < toxicity.SPAN:
                            key = w[i] + w[j] + w[k]
                            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
            return out
        a, b = features(s), features(t)
        dot = lambda u, v: sum(x * v.get(k, 0) for k, x in u.items())
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    marks = ["stupid", "moron", "abab"]
    words = ["stupid", "stuxpid", "moroon", "ababab", "x"]
    got = toxicity.Landmarks(marks).kernel(words)
    assert np.allclose(got, [[plain(w, m) if len(w) > 1 else 0 for m in marks] for w in words])


def test_folded_weights_equal_the_nystroem_map(model):
    marks = toxicity.Landmarks(["stupid", "moron", "hander"])
    w = np.array([0.5, -1.0, 2.0])[: marks.root.shape[1]]
    folded = toxicity.Model(marks.keys, marks.table @ (marks.root @ w), 0.0, np.zeros(3), 0.0)
    words = ["stupids", "handing", "q"]
    assert np.allclose(folded.word_values(words), marks.features(words) @ w)


def test_learns_only_from_rows_not_held_out(spark, monkeypatch):
    texts, labels = _texts(60, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda t, y: seen.update(zip(t, y)))
    toxicity.train(docs, rows)
    assert seen == {t: y for i, (t, y) in enumerate(zip(texts, labels)) if zlib.crc32(str(i).encode()) % 5}


def test_one_class_only():
    assert toxicity.Scorer(toxicity.fit(["a b"], [0])).score(["a", ""]) == pytest.approx([0.05, 0.05])
    assert toxicity.Scorer(toxicity.fit([], [])).score(["a"])[0] < 0.5
