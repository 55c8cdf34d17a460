"""Language identification by words, backing off to shorter and shorter n-grams.

A known word is scored by its log frequency in each language.  An unseen word
is scored by its character n-grams of the greatest length of which any is
known, five down to one.  The frequencies count every labelled training text.

The model has a proven size: a word (or n-gram) is known when it makes up at
least one in ``one_in`` of a language's words (or n-grams of that length), so a
language has at most ``one_in`` of either.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import id_and_text, map_rows
from tallyweave.session import cut_lineage

LONGEST = 5
UNDETERMINED = "und"


def _is_number(c: str) -> bool:
    """A number character that ``\\w`` takes and ``\\d`` does not, as a fraction or a Roman numeral."""
    return c.isalnum() and not c.isalpha() and not c.isdecimal()


def _is_mark(c: str) -> bool:
    return unicodedata.category(c)[0] == "M"


def _ranges(codes: list[int]) -> str:
    """Characters as ranges of a character class."""
    starts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2]) if c + 1 != after]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


_PLAIN = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _full() -> tuple[np.ndarray, re.Pattern]:
    """Which characters the plain pattern gets wrong, and the pattern that gets them right."""
    every = range(sys.maxunicode + 1)
    numbers, marks = ([i for i in every if test(chr(i))] for test in (_is_number, _is_mark))
    odd = np.zeros(sys.maxunicode + 1, bool)
    odd[numbers + marks] = True
    letter = r"[^\W\d_" + _ranges(numbers) + "]"
    return odd, re.compile(f"{letter}+(?:[{_ranges(marks)}]+{letter}*)*")


def letters(text: str) -> list[str]:
    """The runs of letters of a text, in lower case, each with the marks that combine with it.

    Numbers of any kind are no letters.
    """
    text = text.lower()
    if not text.isascii():
        odd, full = _full()
        if odd[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
            return full.findall(text)
    return _PLAIN.findall(text)


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counts(df: DataFrame, shape: str, count, held: int = 400_000) -> DataFrame:
    """Sum what ``count(part, counters)`` adds up, combined in the task before the shuffle.

    ``counters`` has a counter for each combination of the columns before the last.
    """
    names = [c.split()[0] for c in shape.split(",")]

    def run(parts):
        counters: defaultdict = defaultdict(Counter)

        def flush():
            for key, counter in counters.items():
                yield [*([k] * len(counter) for k in key), list(counter), list(counter.values())]
            counters.clear()

        for part in parts:
            count(part, counters)
            if sum(map(len, counters.values())) > held:
                yield from flush()
        yield from flush()

    return map_rows(df, run, f"{shape}, n long").groupBy(*names).agg(F.sum("n").alias("n"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang, word, n`` of a table with ``lang`` and ``text``."""
    def count(part, counters):
        by: dict[str, list[str]] = {}
        for lang, text in zip(part["lang"], part["text"], strict=True):
            by.setdefault(lang, []).append(text)
        for lang, own in by.items():
            counters[lang,].update(letters("\n".join(own)))

    return _counts(texts.select("lang", "text"), "lang string, word string", count)


def gram_counts(words: DataFrame) -> DataFrame:
    """``lang, size, word, n``: n-grams of all lengths, weighted by the words' counts."""
    def count(part, counters):
        for lang, word, n in zip(part["lang"], part["word"], part["n"], strict=True):
            for size in range(1, LONGEST + 1):
                counter = counters[lang, size]
                for g in grams(word, size):
                    counter[g] += n

    return _counts(words, "lang string, size int, word string", count)


def _frequent(counts: DataFrame, by: list[str], one_in: int) -> DataFrame:
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return (counts.join(F.broadcast(totals), by)  # a row per language and length
            .filter(F.col("n") * one_in >= F.col("total")))


@dataclass
class Model:
    """Log frequencies: a row per word or n-gram, a column per language."""

    langs: list[str]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray


def _matrix(rows, langs: list[str]) -> tuple[dict, np.ndarray]:
    at = {lang: i for i, lang in enumerate(langs)}
    index: dict = {}
    for r in rows:
        index.setdefault(r["word"], len(index))
    out = np.full((len(index), len(langs)), -np.inf, np.float32)
    floor = {}
    for r in rows:
        out[index[r["word"]], at[r["lang"]]] = np.log(r["n"] / r["total"])
        floor[r["lang"]] = min(floor.get(r["lang"], 0.0), float(np.log(0.5 * r["n"] / r["total"])))
    low = np.array([floor.get(lang, 0.0) for lang in langs], np.float32)
    # what a language lacks counts as half of the rarest that it knows
    return index, np.where(np.isinf(out), np.minimum(low, low.min(initial=0.0)), out)


def train(labelled: DataFrame, one_in: int = 50_000) -> Model:
    """Fit on all rows of a table with ``lang`` (not null) and ``text``."""
    counts = cut_lineage(word_counts(labelled))
    words = _frequent(counts, ["lang"], one_in).orderBy("word", "lang").collect()
    pieces = (_frequent(gram_counts(counts), ["lang", "size"], one_in)
              .orderBy("word", "lang").collect())
    langs = sorted({r["lang"] for r in words})
    return Model(langs, *_matrix(words, langs), *_matrix([r for r in pieces if r["lang"] in langs], langs))


class Scorer:
    """Scores texts; remembers the vectors of unseen words up to ``remembered``."""

    def __init__(self, model: Model, remembered: int = 300_000):
        self.model, self.remembered = model, remembered
        self._forget()

    def _forget(self):
        self.index = dict(self.model.words)
        self.rows = np.concatenate(
            [self.model.word_rows, np.zeros((1024, len(self.model.langs)), np.float32)])

    def _learn(self, words: list[str]) -> None:
        """Rows for unseen words: the mean over their longest n-grams of which any is known."""
        known, flat, sizes = self.model.grams, [], []
        for word in words:
            for n in range(LONGEST, 0, -1):
                found = [known[g] for g in grams(word, n) if g in known]
                if found:
                    flat += found
                    sizes.append(len(found))
                    break
            else:
                sizes.append(0)
        rows = np.zeros((len(words), len(self.model.langs)))
        size = np.array(sizes)
        some = np.flatnonzero(size)
        if len(some):
            starts = np.r_[0, np.cumsum(size[some])[:-1]]
            rows[some] = np.add.reduceat(self.model.gram_rows[flat].astype(float), starts) / size[some, None]
        first = len(self.index)
        while first + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[first : first + len(words)] = rows
        self.index.update(zip(words, range(first, first + len(words)), strict=True))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        if len(self.index) > self.remembered + len(self.model.words):
            self._forget()
        cut = list(map(letters, texts))
        self._learn(list(set().union(*cut).difference(self.index)))
        for words in cut:
            if not words or not self.model.langs:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = self.rows[list(map(self.index.__getitem__, words))].sum(axis=0, dtype=np.float64)
            share = np.exp(total - total.max())
            best = int(np.argmax(share))
            langs.append(self.model.langs[best])
            scores.append(float(share[best] / share.sum()))
        return langs, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` per row: the likeliest language and its probability.

    A null text, one without letters, or a model that learned nothing gives
    ``und`` and 0.  Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see above

    def run(parts):
        scorer = Scorer(shared.value)
        for part in parts:
            yield [part["doc_id"], *scorer.predict(part["text"])]

    return map_rows(id_and_text(docs), run, "doc_id long, lang_pred string, score double", 500)


def held_out(id_col: Column) -> Column:
    """Documents kept from training: a quarter, by the CRC-32 of the id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, one_in: int = 50_000) -> DataFrame:
    """Train on the labelled rows that are not held out, then predict every row.

    Rows with a null id are never trained on.
    """
    labelled = docs.filter(
        docs["doc_id"].isNotNull() & docs["lang"].isNotNull() & ~held_out(docs["doc_id"])
    ).select(docs["lang"].cast("string").alias("lang"),
             F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return (predict(docs, train(labelled, one_in))
            .withColumn("held_out", held_out(F.col("doc_id")))
            .select("doc_id", "held_out", "lang_pred", "score"))
