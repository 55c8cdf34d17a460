import hashlib
import random

import pytest
import sentencepiece

from tallyweave.llm import pieces
from tallyweave.llm.queries import sentencepiece_model

MODEL = sentencepiece_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(MODEL)


def _texts():
    rnd = random.Random(3)
    yield from ["", " ", "  ", "\n", "▁", "▁▁ a▁", "<s></s><unk><0x0A>", "\x00\x01", "日本語 😀 é", "a" * 500, "abab" * 99,
                " " * 70, "x" + " " * 37 + "y", "Hello  world. 1234567 x.y", "‍﻿ é"]
    for alphabet in ("abcdefgh  \n\t.,▁éßñ日😀AZ01", "  ab", "aab", "the quick▁ "):
        for _ in range(400):
            yield "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 90)))


def test_ids_and_text_equal_the_library(library, own):
    texts = list(_texts())
    encoder = pieces.Encoder(own, as_text=False)
    for text, ids, (n, got, data) in zip(texts, library.encode(texts, add_eos=True), encoder.encode(texts)):
        assert got == ids and n == len(ids), text
        assert data.decode("utf-8", "replace") == library.decode(ids) == own.decode(ids), text


@pytest.mark.parametrize("text", [" " * 3000 + "the end", "x" * 20_000, "ab" * 5000, "é▁" * 800 + " " * 1500, "=-" * 2000])
def test_very_long_words(library, own, text):
    n, ids, data = next(pieces.Encoder(own, as_text=False).encode([text]))
    assert ids == library.encode(text, add_eos=True) and data.decode() == library.decode(ids)


def test_the_queue_equals_the_rounds(own):
    for text in _texts():
        for word in pieces.words_of(text)[:20]:
            assert own.merge_long(word) == own.merge([word])[0], word


def test_forgetting_changes_nothing(own):
    texts = list(_texts())[:300]
    small = pieces.Encoder(own, remembered=0)
    assert [next(small.encode([t])) for t in texts] == list(pieces.Encoder(own).encode(texts))


def test_digests(documents, library):
    texts = ["Hello world", None, "é▁", "Hello world"]
    for r in pieces.encode_documents(documents(list(enumerate(texts))), MODEL, digests=True).collect():
        ids = library.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_values(documents, library):
    r = pieces.encode_documents(documents([(1, "Round  trip, ñ")]), MODEL).first()
    assert r.ids == library.encode("Round  trip, ñ", add_eos=True) and r.decoded == "Round  trip, ñ"


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Pieces(b"")
