"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is normalised (a leading mark, spaces as marks) and cut in front of each
run of marks: no piece of the vocabulary has a mark behind another character,
so no merge crosses a cut.  The distinct unknown words of a block of texts are
laid out in flat numpy arrays of symbols; each round takes the best pair of
every word, merges its leftmost occurrences at once, compacts the arrays, and
ends when no word has a pair left.  Characters without a piece become bytes.

Words recur, so each task remembers the words it has encoded; the memory is
emptied when it reaches ``remembered`` words, which changes no result.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from tallyweave.llm.common import id_and_text, map_rows, sha256_hex

MARK = "▁"
#: Characters from which a word is merged by itself.
LONG = 1000
_WORD = re.compile(f"{MARK}+[^{MARK}]*")

# Kinds of a vocabulary entry and the fields read from a model file, as the
# public format numbers them (fixed values).
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_TEXT, _SCORE, _KIND = 1, 2, 3
_MODEL_TYPE, _BPE = 3, 2
_CHARSMAP, _DUMMY_PREFIX, _SQUEEZE, _ESCAPE = 2, 3, 4, 5


def _fields(data: bytes):
    """(number, value) of a serialised message: integers, or the bytes of the rest."""
    def varint(at):
        shift = value = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Pieces:
    """A vocabulary: ids, merge table, and the bytes that each id stands for."""

    def __init__(self, model: bytes):
        entries, normalizer, trainer = [], {}, {}
        for number, value in _fields(model):
            if number == _PIECES:
                entries.append(dict(_fields(value)))
            elif number == _TRAINER:
                trainer = dict(_fields(value))
            elif number == _NORMALIZER:
                normalizer = dict(_fields(value))
        kinds = [e.get(_KIND, _NORMAL) for e in entries]
        names = [e[_TEXT].decode() for e in entries]
        if trainer.get(_MODEL_TYPE) != _BPE or normalizer.get(_CHARSMAP) or _USER in kinds \
                or normalizer.get(_SQUEEZE, 1) or not normalizer.get(_DUMMY_PREFIX, 1) \
                or not normalizer.get(_ESCAPE, 1):
            raise ValueError("only plain BPE models with an identity normaliser are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(names, kinds, strict=True)) if k == _NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the vocabulary has pieces across words")
        self.unknown = kinds.index(_UNKNOWN)
        self.end = names.index("</s>")
        self.bytes = [-1] * 256
        self.surface = []
        for i, (p, k) in enumerate(zip(names, kinds, strict=True)):
            if k == _BYTE:
                self.bytes[int(p[3:5], 16)] = i
            self.surface.append(
                bytes([int(p[3:5], 16)]) if k == _BYTE
                else p.replace(MARK, " ").encode() if k == _NORMAL
                else " ⁇ ".encode() if k == _UNKNOWN else b"")
        scores = np.array([np.frombuffer(e.get(_SCORE, b"\0\0\0\0"), "<f4")[0] for e in entries])
        # rank 0 is best; equal scores share a rank and go leftmost first
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self._merges(rank)

    def _merges(self, rank: np.ndarray) -> None:
        """Every pair of pieces that forms a piece, as one sorted table.

        ``alone[p]`` marks pieces that take part in a merge at least as good as
        the one that makes them: such a merge may come before the next equal
        pair further right, so those are merged one at a time per word.
        """
        n = len(rank)
        keys, made = [], []
        self.alone = np.zeros(n, bool)
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                # a single character need not be a piece to be merged: it always
                # is one here, as a pair with any other could not be looked up
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    made.append(i)
                    for part in (a, b):
                        if rank[i] <= rank[part]:
                            self.alone[part] = True
        self.rank = rank
        self.size = n
        self._tables(np.array(keys, np.int64), np.array(made, np.int32))

    def _tables(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Two hash tables without probing: what collides in the first goes to the second."""
        self.tables = []
        bits = max(8, int(len(keys)).bit_length() + 4)
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
            table = (np.uint64(seed), np.uint64(64 - bits), np.full(1 << bits, -1, np.int64),
                     np.full(1 << bits, -1, np.int32))
            slot = self._slot(table, keys)
            table[2][slot], table[3][slot] = keys, made
            self.tables.append(table)
            left = table[2][slot] != keys
            keys, made = keys[left], made[left]
            if not len(keys):
                return
        raise ValueError("the merge table does not fit")

    @staticmethod
    def _slot(table, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * table[0]) >> table[1]).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair forms, or -1."""
        made = np.full(len(left), -1, np.int64)
        some = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[some] * self.size + right[some]
        for table in self.tables:
            slot = self._slot(table, key)
            found = table[2][slot] == key
            made[some[found]] = table[3][slot[found]]
        return made

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, all words merged together round by round."""
        flat = "".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        get = self.ids.get
        # characters that are no piece keep their place as -1 - code point
        symbol = np.fromiter((get(c, -1 - ord(c)) for c in flat), np.int64, len(flat))
        word = np.repeat(np.arange(len(words)), sizes)
        made = np.full(len(flat), -1, np.int64)
        if len(flat) > 1:
            same = word[:-1] == word[1:]
            made[:-1][same] = self._pairs(symbol[:-1][same], symbol[1:][same])
        place = np.arange(len(flat))
        none = np.iinfo(np.int64).max
        ready = []
        while len(symbol):
            rank = np.where(made >= 0, self.rank[made], none)
            fresh = np.r_[True, word[1:] != word[:-1]]
            best = np.minimum.reduceat(rank, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
            ended = best == none
            if ended.any():  # words without a pair leave the arrays
                ready.append((symbol[ended], word[ended], place[ended]))
                symbol, word, place, made, rank, best = (
                    x[~ended] for x in (symbol, word, place, made, rank, best))
                if not len(symbol):
                    break
            # of a word's best pairs the leftmost, and further ones of the same safe piece
            at = np.flatnonzero(rank == best)
            first = np.r_[True, word[at[1:]] != word[at[:-1]]]
            lead = made[at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]]
            at = at[first | ((made[at] == lead) & ~self.alone[made[at]])]
            # overlapping pairs (a a a) are taken alternately from the left
            chain = np.r_[False, np.diff(at) == 1]
            begin = np.maximum.accumulate(np.where(~chain, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))  # places of the merged symbols after compaction
            symbol, word, place, made = symbol[keep], word[keep], place[keep], made[keep]
            # only pairs beside a merged symbol have changed
            left = np.unique(np.concatenate([now, now[now > 0] - 1]))
            right = np.minimum(left + 1, len(symbol) - 1)
            made[left] = np.where(
                (left + 1 < len(symbol)) & (word[left] == word[right]),
                self._pairs(symbol[left], symbol[right]), -1)
        out: list[list[int]] = [[] for _ in words]
        if ready:
            symbol, word, place = map(np.concatenate, zip(*ready, strict=True))
            order = np.argsort(place, kind="stable")
            for s, w in zip(symbol[order].tolist(), word[order].tolist(), strict=True):
                out[w] += (s,) if s >= 0 else self._spelled(s)
        return out

    def _spelled(self, symbol: int) -> list[int]:
        """The byte ids of a character that is no piece."""
        ids = [self.bytes[b] for b in chr(-1 - symbol).encode()]
        return ids if min(ids) >= 0 else [self.unknown]

    def merge_long(self, word: str) -> list[int]:
        """Ids of one very long word, a merge at a time from a queue: best rank, then leftmost.

        Rounds could need one pass over the word for each of its merges.
        """
        get, rank = self.ids.get, self.rank
        symbol = [get(c, -1 - ord(c)) for c in word]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        lookup = self._one_pair

        def offer(left: int, right: int) -> None:
            made = lookup(symbol[left], symbol[right])
            if made >= 0:
                heapq.heappush(queue, (int(rank[made]), left, right, symbol[left], symbol[right], made))

        queue: list = []
        for i in range(n - 1):
            offer(i, i + 1)
        gone = [False] * n
        while queue:
            _, left, right, a, b, made = heapq.heappop(queue)
            # an offer is stale if either symbol has changed or is no longer next to the other
            if gone[left] or gone[right] or after[left] != right or symbol[left] != a or symbol[right] != b:
                continue
            symbol[left], gone[right] = made, True
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        out: list[int] = []
        for s, dead in zip(symbol, gone, strict=True):
            if not dead:
                out += (s,) if s >= 0 else self._spelled(s)
        return out

    def _one_pair(self, left: int, right: int) -> int:
        if left < 0 or right < 0:
            return -1
        key = left * self.size + right
        for seed, shift, keys, made in self.tables:
            slot = ((key * int(seed)) & 0xFFFFFFFFFFFFFFFF) >> int(shift)
            if keys[slot] == key:
                return int(made[slot])
        return -1

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids: pieces joined, marks as spaces, the leading mark dropped."""
        data = b"".join(map(self.surface.__getitem__, ids))
        return data.removeprefix(b" ").decode("utf-8", "replace")


@functools.cache
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def words_of(text: str) -> list[str]:
    """The normalised text cut into words that merge on their own; none if it is empty."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


class Encoder:
    """Remembers, per word, its ids (``as_text``: in decimal), their number and their bytes."""

    def __init__(self, pieces: Pieces, as_text: bool = True, remembered: int = 400_000):
        self.pieces, self.as_text, self.remembered, self.known = pieces, as_text, remembered, {}

    def encode(self, texts: list[str]):
        """Per text: number of ids, the ids, and the decoded text's bytes."""
        if len(self.known) > self.remembered:
            self.known.clear()
        cut = [words_of(t) for t in texts]
        new = list(set().union(*cut).difference(self.known))
        surface = self.pieces.surface
        long = [w for w in new if len(w) > LONG]
        new = [w for w in new if len(w) <= LONG]
        merged = [*self.pieces.merge(new), *map(self.pieces.merge_long, long)]
        for word, ids in zip([*new, *long], merged, strict=True):
            self.known[word] = (
                len(ids), " ".join(map(str, ids)) if self.as_text else ids,
                b"".join(map(surface.__getitem__, ids)))
        end = self.pieces.end
        for ws in cut:
            found = list(map(self.known.__getitem__, ws))
            listed = [f[1] for f in found]
            yield (
                sum([f[0] for f in found]) + 1,
                " ".join([*listed, str(end)]) if self.as_text else [*chain.from_iterable(listed), end],
                b"".join([f[2] for f in found]).removeprefix(b" "),
            )


def encode_documents(docs: DataFrame, model: bytes, digests: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` per document, ending with the end id.

    ``digests`` gives the SHA-256 of the ids (decimal, joined by a space) and of
    the decoded text instead of the values.  A null text is encoded as an empty
    one, which has the end id only; repeated rows give repeated results.
    ``model`` is the content of a model file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary, not corpus data

    def run(parts):
        encoder = Encoder(_pieces(shared.value), as_text=digests)
        for part in parts:
            n, ids, decoded = [], [], []
            for count, listed, data in encoder.encode(part["text"]):
                n.append(count)
                if digests:
                    ids.append(sha256_hex(listed.encode()))
                    decoded.append(sha256_hex(data.decode("utf-8", "replace").encode()))
                else:
                    ids.append(listed)
                    decoded.append(data.decode("utf-8", "replace"))
            yield [part["doc_id"], n, ids, decoded]

    shape = ("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests
             else "doc_id long, n_tokens long, ids array<int>, decoded string")
    return map_rows(id_and_text(docs), run, shape, at_once=500)
