"""Toxicity by a subsequence string-kernel machine with Nyström landmarks.

Two words are alike when they share subsequences of three characters, gaps
allowed: an occurrence that spans ``s`` characters weighs ``decay ** s``, spans
reach six characters, and the kernel is normalised.  An insult with another
ending, a dropped or an inserted character therefore stays close to those seen.

Landmark words give the Nyström map; a squared-hinge support vector machine is
fitted in its space on sentences of labelled documents.  Labels are per
document, so the sentence that speaks for a toxic one is chosen anew after each
fit (the first time by the words' log odds).  A sentence is as toxic as its
worst word, and a document's probability is calibrated on its worst words.

Since the machine is linear in the kernel, it folds into one weight per
subsequence: scoring a word is a sum over its own subsequences, at any length.
"""

from __future__ import annotations

import functools
import math
import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import id_and_text, keep_rows, map_rows, mix64

DECAY = 0.7
SPAN = 6
#: Sentences end at these, at line ends, and after so many words.
ENDS = (".", "!", "?")
SENTENCE_WORDS = 16

#: Bounds of the training sample: rows of either label, and characters of each.
SAMPLE_ROWS = 900
SAMPLE_CHARS = 20_000
LANDMARKS = 256
#: Words of a toxic document that speak for it; weight and number of clean words; penalty of the weights.
SPEAKERS = 3
#: Weight of all altered copies, as a share of the toxic documents.  Copies are made of
#: the words that speak most: a third as clearly as the clearest one.
ALTERED_COST = 0.25
CLEAN_COST = 3.0
CLEAN_WORDS = 10_000
#: Log odds times the root of the count from which a word counts fully.
SURE = 8.0
RIDGE = 0.05
#: Word values of a text that its probability depends on, and the range told apart: the
#: margin is at 1, and what lies further out is no surer.
TOP = 3
MOST = 1.0
#: Words whose subsequences are held at once.
AT_ONCE = 5000
LEAST = -2.0


_INNER = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<!\S)\S(?:[^\S\n]\S){2,}(?!\S)")


def _bare(token: str) -> str:
    """A token without punctuation at its ends."""
    if token[:1].isalnum() and token[-1].isalnum():
        return token
    return token.strip("".join({c for c in token if unicodedata.category(c)[0] in "PSZC"}))


def sentences(text: str) -> list[list[str]]:
    """Raw tokens by sentence; spelled-out words (s t u p i d) are joined."""
    out: list[list[str]] = []
    for line in text.lower().split("\n"):
        current: list[str] = []
        spelled: list[str] = []
        for token in [*line.split(), ""]:
            if len(token) == 1:
                spelled.append(token)
                continue
            current += ["".join(spelled)] if len(spelled) > 2 else spelled
            spelled = []
            if token:
                current.append(token)
            if len(current) >= SENTENCE_WORDS or token.endswith(ENDS):
                out.append(current)
                current = []
        if current:
            out.append(current)
    return out


def tokens(text: str) -> set[str]:
    """The distinct tokens of all sentences; single characters stay beside the words they spell."""
    lowered = text.lower()
    out = set(lowered.split())
    out.update("".join(m.split()) for m in _SPELLED.findall(lowered))
    return out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, key, weight) of every subsequence of three characters, a row per word and key.

    Words carry a mark in front, so that their beginnings count.
    """
    marked = ["^" + w for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(w) for w in marked])
    owners, keys, weights = [], [], []
    for last in range(2, SPAN):
        n = len(code) - last
        if n <= 0:
            break
        inside = np.flatnonzero(word[:n] == word[last:])
        for mid in range(1, last):
            owners.append(word[inside])
            keys.append((code[inside] << np.uint64(42)) | (code[inside + mid] << np.uint64(21)) | code[inside + last])
            weights.append(np.full(len(inside), DECAY ** (last + 1)))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    owner, key, weight = map(np.concatenate, (owners, keys, weights))
    order = np.argsort(mix64(key) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    owner, key, weight = owner[order], key[order], weight[order]
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])]
    at = np.flatnonzero(fresh)
    return owner[at], key[at], np.add.reduceat(weight, at)


def _norms(owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.sqrt(np.maximum(np.bincount(owner, weight * weight, n), 1e-12))


class Landmarks:
    """Kernel values of words against a fixed list of words."""

    def __init__(self, words: list[str]):
        owner, key, weight = subsequences(words)
        weight = weight / _norms(owner, weight, len(words))[owner]
        self.keys, at = np.unique(key, return_inverse=True)
        self.table = np.zeros((len(self.keys), len(words)))
        self.table[at, owner] = weight
        values, vectors = np.linalg.eigh(self.kernel(words))
        use = values > 1e-6 * values.max()
        #: maps kernel values to the Nyström space
        self.root = vectors[:, use] / np.sqrt(values[use])

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.table.shape[1]))
        owner, key, weight = subsequences(words)
        weight = weight / _norms(owner, weight, len(words))[owner]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == key)
        hit = hit[np.argsort(owner[hit], kind="stable")]
        for start in range(0, len(hit), 20_000):
            own = hit[start : start + 20_000]
            fresh = np.flatnonzero(np.r_[True, owner[own[1:]] != owner[own[:-1]]])
            out[owner[own[fresh]]] += np.add.reduceat(weight[own, None] * self.table[at[own]], fresh)
        return out

    def features(self, words: list[str]) -> np.ndarray:
        return self.kernel(words) @ self.root


@dataclass
class Model:
    """Weight of each subsequence, offset, and calibration of the worst words."""

    keys: np.ndarray
    weights: np.ndarray
    offset: float
    slopes: np.ndarray
    shift: float

    def word_values(self, words: list[str]) -> np.ndarray:
        if not len(self.keys) or not words:
            return np.zeros(len(words))
        out = []
        for start in range(0, len(words), AT_ONCE):  # a few megabytes at a time
            part = words[start : start + AT_ONCE]
            owner, key, weight = subsequences(part)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            total = np.bincount(owner[hit], weight[hit] * self.weights[at[hit]], len(part))
            out.append(total / _norms(owner, weight, len(part)))
        return np.concatenate(out)


class Scorer:
    """Scores texts; remembers the values of tokens up to ``remembered``."""

    def __init__(self, model: Model, remembered: int = 400_000):
        self.model, self.remembered, self.known = model, remembered, {}

    def worst(self, texts: list[str]) -> np.ndarray:
        """Per text the values of its worst sentences' words: the ``TOP`` largest, distinct."""
        if len(self.known) > self.remembered:
            self.known.clear()
        cut = list(map(tokens, texts))
        new = list(set().union(*cut).difference(self.known))
        bare = list(map(_bare, new))
        values = self.model.word_values(bare)
        # what punctuation holds apart (s.t.u.p.i.d) counts as the word it spells, too
        apart = [i for i, w in enumerate(bare) if not w.isalnum() and w]
        if apart:
            joined = self.model.word_values([_INNER.sub("", bare[i]) for i in apart])
            values[apart] = np.maximum(values[apart], joined)
        values += self.model.offset
        self.known.update(zip(new, np.clip(values, LEAST, MOST).tolist(), strict=True))
        out = np.full((len(texts), TOP), LEAST)
        for row, own in zip(out, cut, strict=True):
            if own:
                top = np.fromiter(map(self.known.__getitem__, own), float, len(own))
                top = np.sort(np.partition(top, -TOP)[-TOP:] if len(top) > TOP else top)[::-1]
                row[: len(top)] = top
        return out

    def score(self, texts: list[str]) -> list[float]:
        z = self.worst(texts) @ self.model.slopes + self.model.shift
        return (1 / (1 + np.exp(-np.clip(z, -60, 60)))).tolist()


def altered(word: str) -> list[str]:
    """A word with a letter doubled, dropped, and put in, at places that depend on its length."""
    if len(word) < 4:
        return []
    i, j = 1 + len(word) % (len(word) - 2), len(word) // 2
    return [word[: i + 1] + word[i:], word[:j] + word[j + 1 :], word[:j] + "x" + word[j:],
            word[: i + 1] + "0" + word[i + 1 :], word[: len(word) - 2] + "-" + word[len(word) - 2 :]]


def _fit_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float) -> np.ndarray:
    """Weights (last: offset) that minimise ridge/2 |w|² + sum cost max(0, 1 - y f)², by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(w):
        slack = np.maximum(0, 1 - y * (x @ w))
        return 0.5 * (penalty * w * w).sum() + (cost * slack * slack).sum()

    now = loss(w)
    for _ in range(30):
        f = x @ w
        on = y * f < 1
        xs, cs = x[on], 2 * cost[on]
        grad = penalty * w + xs.T @ (cs * (f[on] - y[on]))
        step = np.linalg.solve(np.diag(penalty) + (xs.T * cs) @ xs, grad)
        size = 1.0
        while (after := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        if now - after < 1e-6 * now:
            break
        w, now = w - size * step, after
    return w


def _calibrate(values: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic fit of the label on a text's largest word values, with a small ridge."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.c_[values, np.ones(len(values))]
    w = np.zeros(x.shape[1])
    ridge = np.diag(np.r_[np.full(x.shape[1] - 1, 0.02), 1e-6])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (p - target) + ridge @ w)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS) -> Model:
    """Train on labelled texts held in memory; with one class only, nothing is learned."""
    y = np.array(toxic, int)
    if not len(y) or y.min() == y.max():
        share = 0.05 if not len(y) or y.max() == 0 else 0.95
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, np.zeros(TOP), math.log(share / (1 - share)))
    # distinct words of all sentences of a text, each word held once
    cut = [{sys.intern(b) for s in sentences(t) for b in map(_bare, s) if b} for t in texts]
    # one in four documents only calibrates
    order = np.random.default_rng(7).permutation(len(y))
    hold = np.zeros(len(y), bool)
    hold[order[: len(y) // 4]] = True
    seen = [Counter(), Counter()]
    for own, label in zip(cut, y, strict=True):
        seen[label].update(own)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    odds = {w: math.log((seen[1][w] + 0.3) / (n1 + 1)) - math.log((seen[0][w] + 0.3) / (n0 + 1))
            for w in seen[1].keys() | seen[0].keys()}
    by_odds = sorted(odds, key=lambda w: (-odds[w] * math.sqrt(seen[1][w] + 0.1), w))
    common = sorted(odds, key=lambda w: (-seen[0][w], w))
    marks = Landmarks(list(dict.fromkeys(by_odds[: landmarks // 2] + common[: landmarks // 2])))
    vocabulary = {w: i for i, w in enumerate(sorted(odds))}
    vectors = np.empty((len(vocabulary), marks.root.shape[1]), np.float32)
    words = list(vocabulary)
    for start in range(0, len(words), AT_ONCE):
        part = words[start : start + AT_ONCE]
        vectors[start : start + len(part)] = marks.features(part)

    # a sentence is as toxic as its worst word, so its words are what the machine sees:
    # every word of a clean sentence is clean, and of a toxic document the words speak
    # that stand out most, chosen anew after each fit
    clean = sorted({w for i in range(len(y)) if y[i] == 0 and not hold[i] for w in cut[i]},
                   key=lambda w: (-seen[0][w], w))
    clean_at = np.array([vocabulary[w] for w in clean], int)
    often = np.sqrt([seen[0][w] for w in clean])
    bags = [np.array(sorted(vocabulary[w] for w in cut[i]))
            for i in range(len(y)) if y[i] == 1 and not hold[i] and cut[i]]
    stands_out = np.array([odds[w] * math.sqrt(seen[1][w]) for w in words])
    w = np.zeros(vectors.shape[1] + 1)
    sure = [words[k] for k in np.flatnonzero(stands_out >= max(SURE, stands_out.max() / 3))]
    copies = [c for word in sure for c in altered(word)]
    copy_x = marks.features(copies) if copies else np.zeros((0, vectors.shape[1]))
    copy_cost = np.full(len(copies), ALTERED_COST * len(bags) / max(1, len(copies)))
    for turn in range(5):
        reach = vectors @ w[:-1].astype(np.float32)  # in single precision: no copy of the vectors
        value = stands_out if not turn else reach + 0.05 * stands_out
        chosen = [sorted(b[np.argsort(-value[b], kind="stable")[:SPEAKERS]]) for b in bags]
        toxic_at = np.array([k for own in chosen for k in own if stands_out[k] > 0], int)
        # the clean words that come closest; the others lie beyond the margin
        hard = np.argsort(-reach[clean_at], kind="stable")[:CLEAN_WORDS]
        at = np.r_[toxic_at, clean_at[hard]]
        t = np.r_[np.ones(len(toxic_at)), -np.ones(len(hard))]
        cost = np.r_[np.minimum(1.0, stands_out[toxic_at] / SURE), often[hard] * len(toxic_at) * CLEAN_COST / often.sum()]
        w = _fit_machine(np.concatenate([vectors[at], copy_x]), np.r_[t, np.ones(len(copies))],
                         np.r_[cost, copy_cost], ridge=RIDGE)
    alpha = marks.root @ w[:-1]
    model = Model(marks.keys, marks.table @ alpha, float(w[-1]), np.zeros(TOP), 0.0)
    kept = [i for i in range(len(y)) if hold[i]]
    model.slopes, model.shift = _calibrate(Scorer(model).worst([texts[i] for i in kept]), y[kept])
    return model


def held_out(id_col: Column) -> Column:
    """Documents kept from training: a fifth, by the CRC-32 of the id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
          sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample of labelled rows that are not held out.

    The sample is the ``sample_rows`` rows of either label whose ids hash
    lowest, of texts up to ``sample_chars`` characters: at most 2 * 900 * 20,000
    characters reach the driver.  Null labels and ids are passed over.
    """
    marked = labels.filter(
        labels["doc_id"].isNotNull() & labels["toxic"].isin(0, 1) & ~held_out(labels["doc_id"])
    ).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.max(labels["toxic"]).alias("toxic"))
    sized = docs.filter(F.length(docs["text"]) <= sample_chars).select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    # twice as many ids as needed are drawn, as some rows may be too long or missing
    drawn = functools.reduce(DataFrame.union, (
        marked.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_rows)
        for label in (0, 1)))
    rows = (sized.join(F.broadcast(drawn), "doc_id")
            .select("toxic", "text", F.xxhash64("doc_id").alias("h"), "doc_id"))
    sample = functools.reduce(DataFrame.union, (
        rows.filter(F.col("toxic") == label).orderBy("h", "doc_id", "text").limit(sample_rows)
        for label in (0, 1))).collect()
    return fit([r["text"] for r in sample], [r["toxic"] for r in sample])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` per row; null and empty texts get the score of no sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded model

    def run(parts):
        scorer = Scorer(shared.value)
        for part in parts:
            yield [part["doc_id"], scorer.score(part["text"])]

    return map_rows(id_and_text(docs), run, "doc_id long, score double", 500)


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, without those that score 0.5 or more.

    Rows are judged where they lie, so nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def clean(texts):
        return [s < 0.5 for s in Scorer(shared.value).score(texts)]

    return keep_rows(docs, clean)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row; ``predicted`` is 1 from 0.5 on.

    Repeated rows get equal scores.  An id with several labels counts as toxic if any
    of them says so; rows without an id are scored and never trained on.
    """
    return score_documents(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
