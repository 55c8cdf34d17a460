"""Benchmark decontamination with suffix arrays of the training texts.

Each shard (a few megabytes of documents) gets an array of its word suffixes in
sorted order.  Every suffix of every benchmark item is located in it by binary
search, word by word, which gives its longest verbatim match and the places
where that occurs.  A match of ``window`` words, or of a whole shorter item,
contaminates the words it covers.

Only suffixes that begin with a benchmark word (and, where every item has two
words, with a benchmark word pair) enter the array: no other can match.

The benchmark is a query set.  It is read in blocks of bounded size, each held
by the tasks in turn; with several blocks the marks made so far are stored
between them, so that memory does not grow with the benchmark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import id_and_text, keep_rows, map_rows
from tallyweave.session import cut_lineage

WINDOW = 10
#: Characters of benchmark text that are held at once.
BLOCK_CHARS = 16_000_000
#: Bytes of documents in a shard.
SHARD_BYTES = 8_000_000

# words are digits, lower-case ASCII letters and all bytes from 0x80; A-Z are lowered
_FOLD = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20
    for b in (ord(chr(i).lower()) if i < 0x80 else i for i in range(256)))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


@dataclass
class TestSet:
    """A block of benchmark items as words, numbered from 1 (0 is any other word)."""

    __test__ = False  # no test, whatever its name

    window: int
    items: list[str] = field(default_factory=list)
    ids: dict[bytes, int] = field(default_factory=dict)
    words: np.ndarray | None = None
    starts: np.ndarray | None = None

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int) -> TestSet:
        out = cls(window)
        flat, starts = [], [0]
        for name, text in items:
            words = words_of(text)
            if words:
                out.items.append(name)
                flat += [out.ids.setdefault(w, len(out.ids) + 1) for w in words]
                starts.append(len(flat))
        out.words, out.starts = np.array(flat, np.int64), np.array(starts, np.int64)
        out._prepare()
        return out

    def _prepare(self) -> None:
        size = np.diff(self.starts)
        item = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(self.words))
        self.item, self.left = item, self.starts[1:][item] - at if len(item) else at
        #: suffixes that begin a window, and the words each window has
        need = np.minimum(self.window, size)[item] if len(item) else at
        begins = self.left >= need
        self.begin, self.need = at[begins], need[begins]
        paired = len(size) and (size >= 2).all() and self.window >= 2
        self.pairs = (np.unique((self.words[:-1] << 32 | self.words[1:])[item[:-1] == item[1:]])
                      if paired else None)


class Shard:
    """Sorted word suffixes of some documents, to a depth of ``window`` words."""

    def __init__(self, texts: list[str], tests: TestSet):
        get = tests.ids.get
        cut = [words_of(t) for t in texts]
        self.sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        # a word of no item, -1, stands behind each document
        flat = [get(w, 0) for ws in cut for w in (*ws, b"")]
        self.words = np.r_[np.array(flat, np.int64), np.zeros(tests.window, np.int64)]
        self.starts = np.r_[0, np.cumsum(self.sizes + 1)]
        n = len(self.words) - tests.window
        if tests.pairs is not None and len(tests.pairs):
            pair = self.words[:n] << 32 | self.words[1 : n + 1]
            maybe = np.flatnonzero((self.words[:n] > 0) & (self.words[1 : n + 1] > 0))
            at = np.minimum(np.searchsorted(tests.pairs, pair[maybe]), len(tests.pairs) - 1)
            suffix = maybe[tests.pairs[at] == pair[maybe]]
        else:
            suffix = np.flatnonzero(self.words[:n] > 0)
        self.suffixes = self._sort(suffix, tests)

    def _sort(self, suffix: np.ndarray, tests: TestSet) -> np.ndarray:
        """By leading words, several packed into a key; ties are refined by the next words."""
        bits = max(1, int(len(tests.ids)).bit_length())
        each = max(1, 62 // bits)
        group = np.zeros(len(suffix), np.int64)
        tied = np.arange(len(suffix))
        for depth in range(0, tests.window, each):
            own = suffix[tied]
            key = np.zeros(len(tied), np.int64)
            for k in range(depth, min(depth + each, tests.window)):
                key = key << bits | self.words[np.minimum(own + k, len(self.words) - 1)]
            order = np.lexsort((key, group[tied]))
            suffix[tied], key, of = own[order], key[order], group[tied]
            fresh = np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])] if len(of) else np.zeros(0, bool)
            # a group is named by the place of its first suffix
            group[tied] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
            same = np.zeros(len(suffix), bool)
            same[1:] = group[1:] == group[:-1]
            same[:-1] |= same[1:]
            tied = np.flatnonzero(same)
            if not len(tied):
                break
        return suffix

    def search(self, tests: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(longest match, from, to) in the array for each suffix that begins a window.

        All suffixes are searched together: a word at a time narrows each range
        by two binary searches until a range is empty or the window is whole.
        """
        n = len(tests.begin)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.suffixes), np.int64)
        longest = np.zeros(n, np.int64)
        live = np.arange(n)
        for depth in range(tests.window):
            live = live[(tests.need[live] > depth)]
            word = tests.words[tests.begin[live] + depth]
            first = self._bound(low[live], high[live], depth, word)
            last = self._bound(first, high[live], depth, word + 1)
            found = last > first
            live = live[found]
            low[live], high[live] = first[found], last[found]
            longest[live] = depth + 1
            if not len(live):
                break
        return longest, low, high

    def _bound(self, low, high, depth, word):
        """First place in each range whose suffix has at least ``word`` at ``depth``."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at = self.suffixes[np.minimum(mid, len(self.suffixes) - 1)] + depth
            less = open_ & (self.words[np.minimum(at, len(self.words) - 1)] < word)
            low = np.where(less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        return low


def find(texts: list[str], tests: TestSet) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """Per text: number of words, the places of its hit words, and the items found in it."""
    shard = Shard(texts, tests)
    longest, low, high = shard.search(tests)
    whole = np.flatnonzero(longest >= tests.need) if len(longest) else longest
    count = (high - low)[whole]
    test = np.repeat(whole, count)
    place = np.repeat(low[whole] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    at = shard.suffixes[place.astype(np.int64)] if len(place) else np.zeros(0, np.int64)
    size = tests.need[test]
    edges = np.zeros(len(shard.words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    hit = np.flatnonzero(np.cumsum(edges)[: shard.starts[-1]] > 0)
    of = np.searchsorted(shard.starts, hit, "right") - 1
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    hits = [(hit[a:b] - shard.starts[i]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    found: list[set[str]] = [set() for _ in texts]
    document = np.searchsorted(shard.starts, at, "right") - 1
    item = tests.item[tests.begin[test]] if len(test) else test
    for d, i in set(zip(document.tolist(), item.tolist(), strict=True)):
        found[d].add(tests.items[i])
    return shard.sizes, hits, [sorted(f) for f in found]


def _spans(places: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive places, ends exclusive."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.r_[0, cut + 1]].tolist(), (places[np.r_[cut, len(places) - 1]] + 1).tolist(), strict=True))


def _blocks(benchmark: DataFrame, block_chars: int):
    """(rows, whether more follow) of at most ``block_chars`` characters, or one item."""
    rows, size = [], 0
    table = benchmark.filter(benchmark["text"].isNotNull()).select(
        F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"),
        benchmark["text"].cast("string").alias("text"))
    for row in table.toLocalIterator():
        if rows and size + len(row["text"]) > block_chars:
            yield rows, True
            rows, size = [], 0
        rows.append((row["item"], row["text"]))
        size += len(row["text"])
    yield rows, False


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items, longest`` per document row.

    ``spans`` are the runs of hit words (from, to), ``items`` the benchmark
    items with an occurring window, sorted, and ``longest`` the longest run.
    Null and empty texts have no words; null items and items without words are
    passed over; several items with one id are one item.
    """
    marked = id_and_text(docs).withColumns({
        "spans": F.lit(None).cast("array<struct<a:int,b:int>>"),
        "items": F.lit(None).cast("array<string>"), "n_words": F.lit(0).cast("long")})
    for rows, more in _blocks(benchmark, block_chars):
        marked = _mark(marked, TestSet.of(rows, window), more)
        if more:
            marked = cut_lineage(marked)
    return marked.select(
        "doc_id", "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]), F.lit(0).cast("long")).alias("n_hit"),
        "spans", "items",
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["b"] - s["a"])), F.lit(0)).alias("longest"),
    )


def _mark(docs: DataFrame, tests: TestSet, more: bool) -> DataFrame:
    """Add the marks of one block of the benchmark; the text goes on if more blocks follow."""
    shared = docs.sparkSession.sparkContext.broadcast(tests)  # at most a block

    def run(parts):
        for part in parts:
            texts = part["text"]
            n_words, spans, items = [], [], []
            first = 0
            while first < len(texts):
                last = _shard_end(texts, first)
                sizes, hits, found = find(texts[first:last], shared.value)
                n_words += sizes.tolist()
                for i in range(last - first):
                    old = [np.arange(s["a"], s["b"]) for s in part["spans"][first + i] or []]
                    every = np.unique(np.concatenate([hits[i], *old])) if old else hits[i]
                    spans.append([{"a": a, "b": b} for a, b in _spans(every)])
                    items.append(sorted({*found[i], *(part["items"][first + i] or [])}))
                first = last
            yield [part["doc_id"], *([texts] if more else []), spans, items, n_words]

    return map_rows(
        docs, run, "doc_id long, " + "text string, " * more
        + "spans array<struct<a:int,b:int>>, items array<string>, n_words long", 2000)


def items_digest(items):
    """SHA-256 of the sorted, comma-joined items."""
    return F.sha2(F.array_join(items, ","), 256)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                        block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark window.

    Rows are judged where they lie, so nothing is shuffled.
    """
    for rows, _ in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(TestSet.of(rows, window))  # at most a block

        def clean(texts, shared=shared):
            out, first = [], 0
            while first < len(texts):
                last = _shard_end(texts, first)
                out += [not len(h) for h in find(texts[first:last], shared.value)[1]]
                first = last
            return out

        docs = keep_rows(docs, clean)
    return docs


def _shard_end(texts: list[str], first: int) -> int:
    """End of the shard that begins at ``first``: ``SHARD_BYTES`` of text, or one text."""
    size, last = 0, first
    while last < len(texts) and (last == first or size + len(texts[last]) <= SHARD_BYTES):
        size += len(texts[last])
        last += 1
    return last
