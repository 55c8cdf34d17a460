import random
import unicodedata
from pathlib import Path

import pytest

from tallyweave.llm import language

TEXTS = {"en": "the house and the garden are with the river", "de": "das haus und der garten sind mit dem fluss"}


def _model(spark):
    rows = [(lang, " ".join([text] * 3)) for lang, text in TEXTS.items()]
    return language.train(spark.createDataFrame(rows, "lang string, text string"))


def test_known_words_then_shorter_grams(spark):
    model = _model(spark)
    scorer = language.Scorer(model)
    assert model.langs == ["de", "en"]
    # rivers is unseen: its longest known n-grams decide; Ω is beyond all n-grams
    assert scorer.predict(["the garden", "und das", "rivers", "gartens flusse"])[0] == ["en", "de", "en", "de"]
    assert scorer.predict(["ΩΩΩ"]) == (["de"], [0.5])
    assert scorer.predict(["", "12 _ !", "\x00"]) == ([language.UNDETERMINED] * 3, [0.0] * 3)


def test_letters_are_letters(spark):
    """Fractions, powers and Roman or circled numbers are no letters; marks stay with theirs."""
    assert [language.letters(t) for t in ("½ ²", "Ⅷ", "①", "५", "_", "\u0301")] == [[]] * 6
    assert language.letters("हिन्दी में x²y") == ["हिन्दी", "में", "x", "y"]
    assert language.letters("CAFE\u0301 一二 don't") == ["cafe\u0301", "一二", "don", "t"]
    assert language.Scorer(_model(spark)).predict(["½ ²", "Ⅷ", "①"]) == ([language.UNDETERMINED] * 3, [0.0] * 3)


@pytest.mark.parametrize("seed", range(3))
def test_letters_against_each_character(seed):
    pick = random.Random(seed)
    for _ in range(300):
        text = "".join(chr(pick.choice([pick.randrange(32, 0x3000), pick.randrange(0xD7FF), 0x301, 0x93F, 0x2167, 97, 32])) for _ in range(12))
        plain, run = [], ""
        for c in text.lower() + " ":
            if c.isalpha() or (run and unicodedata.category(c)[0] == "M"):
                run += c
            else:
                plain += [run] if run else []
                run = ""
        assert language.letters(text) == plain, text


def test_forgetting_changes_nothing(spark):
    model = _model(spark)
    texts = ["rivers gardens houses", "haeuser gaerten", "mixed und and"] * 3
    small = language.Scorer(model, remembered=0)
    assert [small.predict([t]) for t in texts] == [language.Scorer(model).predict([t]) for t in texts]


def test_frequencies_count_every_text(spark):
    df = spark.createDataFrame([("x", "Ab ab, c1c")] * 7 + [("y", "ab")], "lang string, text string")
    assert {(r.lang, r.word, r.n) for r in language.word_counts(df).collect()} == {("x", "ab", 14), ("x", "c", 14), ("y", "ab", 1)}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) > 0
    assert all(0 <= r.score <= 1 for r in got)
