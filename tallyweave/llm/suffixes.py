"""Removal of repeated substrings by a sorted array of suffixes.

Every byte covered by a ``match``-byte string that also starts earlier is
removed.  Earlier means a smaller document id, or an earlier start in the same
document.  Strings are judged on the input, whole texts, byte by byte.

Not all suffixes are sorted, only those at anchors: the ``gram`` bytes of least
hash in any ``match`` bytes.  Equal strings have equal anchors, so each string is
found through the anchor in it, of which there are some 25 per kilobyte.

1. Documents are packed into compressed blocks, stored once, bucketed by block.
2. Blocks send the hashes of their anchors to learn which recur (once per block,
   however often a block holds them).
3. Suffixes at recurring anchors, with the bytes before them, are range
   partitioned by their leading bytes at sampled splitters; equal contexts of a
   block are sent once, with their first place.
4. Each range sorts its suffixes by multikey quicksort, eight bytes at a time,
   and the contexts before them likewise.  Splitters cut between different
   leading bytes, so suffixes of one anchor never lie in two ranges, and no
   match spans a boundary.  Runs of both orders tell which strings agree.
5. The verdicts go back to the blocks, which cut their texts.
"""

from __future__ import annotations

import io
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tallyweave.llm.common import id_and_text, mix64
from tallyweave.session import shared_dir, shuffle_partitions

MATCH = 100
GRAM = 24
BLOCK_BYTES = 2_000_000
#: Bytes whose anchors are found together.
CHUNK = 1_000_000
#: Leading bytes that splitters compare, and how many are sampled for them.
LEAD = 16
SAMPLE = 40_000
#: Ranges per shuffle partition.
RANGES = 4
#: Place of documents without an id: behind all others.
LAST = np.iinfo(np.int64).max

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Sizes:
    match: int = MATCH
    gram: int = GRAM

    @property
    def before(self) -> int:
        """Bytes before an anchor that a string with it may have."""
        return self.match - self.gram


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data))))


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over ``size`` values from each place on."""
    if len(x) < size:
        return x[:0]
    have, out = 1, x
    while have * 2 <= size:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = size - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on, by doubling."""
    power, part = _BASE, _BYTES[data]
    out, have, skip = None, 0, 0
    size = 1
    while True:
        if gram & size:
            # what is hashed so far comes first
            n = len(data) - have - size + 1
            out = part[: max(n, 0)] if out is None else out[: max(n, 0)] * power + part[have : have + max(n, 0)]
            have += size
        if have == gram:
            return mix64(out)
        n = max(len(part) - size, 0)
        part = part[:n] * power + part[size : size + n]
        power = np.uint64(int(power) ** 2 & int(_NEVER))
        size *= 2


@dataclass
class Block:
    """The texts of a block end to end: bytes, ids, and where each text begins."""

    data: np.ndarray
    ids: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8) \
            if row["sizes"] and sum(row["sizes"]) else np.zeros(0, np.uint8)
        ids = np.array([LAST if i is None else i for i in row["ids"]], np.int64)
        return cls(data, ids, np.r_[0, np.cumsum(row["sizes"], dtype=np.int64)].astype(np.int64))

    def anchors(self, sizes: Sizes, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes): all least grams of the strings that lie within a text."""
        found = [self._anchors(c, min(c + chunk, len(self.data)), sizes) for c in range(0, len(self.data), chunk)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _anchors(self, start: int, end: int, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
        """Anchors from ``start`` to ``end``, by the strings around them."""
        low, high = max(0, start - sizes.before), min(len(self.data), end + sizes.match)
        data, n = self.data[low:high], high - low
        if n < sizes.match:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first, last = np.searchsorted(self.starts, low, "right") - 1, np.searchsorted(self.starts, high, "left")
        edges = np.clip(self.starts[first : last + 1], low, high)
        left = np.repeat(self.starts[first + 1 : last + 1], np.diff(edges)) - np.arange(low, high)
        h = _gram_hashes(data, sizes.gram)
        h = np.where(left[: len(h)] >= sizes.gram, h, _NEVER)
        least = _sliding(h, sizes.before + 1, np.minimum)
        # strings beyond a text's end choose nothing
        least = np.where(left[: len(least)] >= sizes.match, least, np.uint64(0))
        pad = np.zeros(sizes.before, np.uint64)
        most = _sliding(np.r_[pad, least, pad], sizes.before + 1, np.maximum)
        at = np.flatnonzero((most == h) & (h != 0) & (h != _NEVER))
        at = at[(at + low >= start) & (at + low < end)]
        return at + low, h[at]

    def contexts(self, at: np.ndarray, sizes: Sizes):
        """Bytes from each place on and before it (nearest first), with their true lengths."""
        doc = np.searchsorted(self.starts, at, "right") - 1
        after = np.minimum(self.starts[doc + 1] - at, sizes.match).astype(np.int32)
        before = np.minimum(at - self.starts[doc], sizes.before).astype(np.int32)
        padded = np.r_[self.data, np.zeros(sizes.match, np.uint8)]
        right = padded[at[:, None] + np.arange(sizes.match)]
        right[np.arange(sizes.match) >= after[:, None]] = 0
        left = self.data[np.maximum(at[:, None] - 1 - np.arange(sizes.before), 0)]
        left[np.arange(sizes.before) >= before[:, None]] = 0
        return right, left, after, before, self.ids[doc], (at - self.starts[doc]).astype(np.int64)


def _map(df: DataFrame, rows, schema: str) -> DataFrame:
    """``rows`` turns an iterator of row dictionaries into tuples; a few rows at a time."""
    fields = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(fields)

        def each():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield batch.slice(i, 1).to_pylist()[0]

        held, size = [], 0
        for row in rows(each()):
            held.append(row)
            size += sum(len(v) if isinstance(v, bytes) else 16 for v in row)
            if size > 4_000_000 or len(held) > 5000:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)

    return df.mapInArrow(run, fields)


def _store_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents packed into blocks, stored bucketed by block so that later joins need not move them."""
    def pack(rows):
        part, n = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def row():
            data = b"".join(texts)
            step = max(1, len(data) // 64)
            lead = [data[i : i + LEAD] for i in range(step // 2, len(data), step)]
            return ((part << 33) + n, list(ids), list(map(len, texts)),
                    zstandard.ZstdCompressor(level=1).compress(data), lead)

        for r in rows:
            data = r["text"].encode()
            if texts and size + len(data) > block_bytes:
                yield row()
                n += 1
                ids, texts, size = [], [], 0
            ids.append(r["doc_id"])
            texts.append(data)
            size += len(data)
        if texts:
            yield row()

    blocks = _map(id_and_text(docs), pack,
                  "block long, ids array<long>, sizes array<int>, data binary, lead array<binary>")
    spark = docs.sparkSession
    n, name = shuffle_partitions(spark), f"blocks_{uuid.uuid4().hex}"
    (blocks.repartition(n, "block").write.bucketBy(n, "block")
     .option("path", f"{shared_dir(spark)}/tallyweave/{name}").saveAsTable(name))
    return spark.table(name)


def _recurring(blocks: DataFrame, sizes: Sizes) -> DataFrame:
    """``block, hashes``: the anchor hashes of each block that other blocks have too."""
    n = shuffle_partitions(blocks.sparkSession)

    def send(rows):
        for r in rows:
            h = np.unique(Block.of(r).anchors(sizes)[1])
            # anchors have low hashes, so these are scrambled again to deal them out evenly
            to = (mix64(h) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
            h = h[np.argsort(to, kind="stable")]
            cuts = np.searchsorted(np.sort(to), np.arange(n + 1, dtype=np.uint64))
            for to, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    yield to, r["block"], h[a:b].tobytes()

    def compare(rows):
        held = [(r["block"], np.frombuffer(r["hashes"], np.uint64)) for r in rows]
        if not held:
            return
        h = np.concatenate([x for _, x in held])
        of = np.repeat(np.arange(len(held)), [len(x) for _, x in held])
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        again = np.r_[False, h[1:] == h[:-1]]
        again[:-1] |= again[1:]
        h, of = h[again], of[again]
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
        cuts = np.searchsorted(of, np.arange(len(held) + 1))
        for (block, _), a, b in zip(held, cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield block, h[a:b].tobytes()

    sent = _map(blocks.select("block", "ids", "sizes", "data"), send, "to int, block long, hashes binary")
    return (_map(sent.repartition(n, "to"), compare, "block long, hashes binary")
            .groupBy("block").agg(F.collect_list("hashes").alias("hashes")))


def _words(x: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 64-bit words."""
    pad = -x.shape[1] % 8
    return np.ascontiguousarray(np.pad(x, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)


def multikey_order(x: np.ndarray) -> np.ndarray:
    """Order of rows of bytes: eight at a time, refining only what is still tied."""
    words = _words(x)
    order = np.arange(len(x))
    group = np.zeros(len(x), np.int64)
    tied = np.arange(len(x))
    for k in range(words.shape[1]):
        own, of = order[tied], group[tied]
        key = words[own, k]
        by = np.lexsort((key, of))
        order[tied], key = own[by], key[by]
        fresh = np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])][: len(tied)]
        group[tied] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        same = np.zeros(len(x), bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:]
        tied = np.flatnonzero(same)
        if not len(tied):
            break
    return order


def _shared_lengths(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Leading bytes that each row shares with the one before it in the order; -1 first."""
    out = np.full(len(order), -1, np.int64)
    for start in range(1, len(order), 50_000):
        own = order[start : start + 50_000]
        differs = x[own] != x[order[start - 1 : start - 1 + len(own)]]
        out[start : start + len(own)] = np.where(differs.any(axis=1), differs.argmax(axis=1), x.shape[1])
    return out


def judge(right, left, after, before, doc, place, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) bytes before each anchor from which a repeated string starts; none: most < least.

    ``right`` and ``left`` are the bytes from an anchor on and before it.  A
    string with ``a`` bytes before the anchor equals another if the first ``a``
    of the left and ``match - a`` of the right agree.  It is repeated if the
    equal string of least (document, place) is another, earlier one.
    """
    n = len(right)
    least, most = np.full(n, sizes.match, np.int64), np.full(n, -1, np.int64)
    # all strings around an anchor: what a later copy of a whole context gets
    every_least, every_most = sizes.match - after.astype(np.int64), before.astype(np.int64)
    every_least = np.maximum(every_least, 0)
    by_right = multikey_order(right)
    shared = _shared_lengths(right, by_right)
    gram = np.cumsum(shared < sizes.gram)  # suffixes of one anchor
    alone = np.bincount(gram)[gram] == 1
    own = by_right[~alone]
    if not len(own):
        return least, most
    time = np.lexsort((place[own], doc[own]))
    rank = np.empty(len(own), np.int64)
    later = np.r_[False, (doc[own][time][1:] != doc[own][time][:-1]) | (place[own][time][1:] != place[own][time][:-1])]
    rank[time] = np.cumsum(later)
    # copies of whole contexts: all but the first are repeated throughout
    whole = np.concatenate(
        [right[own], left[own], after[own].astype("<u4").view(np.uint8).reshape(-1, 4),
         before[own].astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
    order = multikey_order(whole)
    context = np.empty(len(own), np.int64)
    context[order] = np.cumsum(_shared_lengths(whole, order) < whole.shape[1]) - 1
    first = np.full(context.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, context, rank)
    copy = rank > first[context]
    least[own[copy]], most[own[copy]] = every_least[own[copy]], every_most[own[copy]]
    # one row per context, where an anchor has several
    _, one = np.unique(np.where(copy, -1, context), return_index=True)
    one = one[~copy[one]]
    one.sort()
    g = gram[~alone][one]
    several = np.bincount(g)[g] > 1
    one = one[several]
    if not len(one):
        return least, most
    rows = own[one]  # still in the order of their right sides
    at_right = _shared_lengths(right, rows)
    by_left = multikey_order(left[rows])
    at_left = _shared_lengths(left[rows], by_left)
    rank = rank[one]
    low, high = np.full(len(rows), sizes.match, np.int64), np.full(len(rows), -1, np.int64)
    left_run = np.empty(len(rows), np.int64)
    for a in range(sizes.before + 1):
        valid = np.flatnonzero((before[rows] >= a) & (after[rows] >= sizes.match - a))
        if len(valid) < 2:
            continue
        right_run = np.cumsum(at_right < sizes.match - a)
        left_run[by_left] = np.cumsum(at_left < a)
        both = right_run[valid] * (len(rows) + 1) + left_run[valid]
        order = np.lexsort((rank[valid], both))
        both, r = both[order], rank[valid][order]
        fresh = np.r_[True, both[1:] != both[:-1]]
        head = r[np.maximum.accumulate(np.where(fresh, np.arange(len(r)), 0))]
        hit = valid[order[r > head]]
        low[hit] = np.minimum(low[hit], a)
        high[hit] = a
    # all rows of a context that share its first place get its verdict
    by_context_low = np.full(len(first), sizes.match, np.int64)
    by_context_high = np.full(len(first), -1, np.int64)
    by_context_low[context[one]], by_context_high[context[one]] = low, high
    mine = ~copy
    least[own[mine]], most[own[mine]] = by_context_low[context[mine]], by_context_high[context[mine]]
    return least, most


def _verdicts(blocks: DataFrame, sizes: Sizes) -> DataFrame:
    """``block, spans``: byte ranges of each block to remove, overlapping, in packed lists."""
    spark = blocks.sparkSession
    n = shuffle_partitions(spark)
    sample = (blocks.select(F.explode("lead").alias("lead")).orderBy(F.xxhash64("lead"))
              .limit(SAMPLE).collect())
    leads = np.sort(np.array([bytes(r["lead"]) for r in sample], f"S{LEAD}"))
    # several ranges per partition, so that large and small ones even out
    ranges = RANGES * n
    cuts = np.unique(leads[np.arange(1, ranges) * len(leads) // ranges]) if len(leads) else leads
    splitters = spark.sparkContext.broadcast(cuts)

    def send(rows):
        for r in rows:
            block = Block.of(r)
            at, h = block.anchors(sizes)
            order = np.argsort(h, kind="stable")
            again = np.r_[False, h[order][1:] == h[order][:-1]][: len(h)]
            again[:-1] |= again[1:]
            known = np.frombuffer(b"".join(r["hashes"] or []), np.uint64)
            use = np.isin(h, known)
            use[order[again]] = True
            at, h = at[use], h[use]
            done = []
            to = np.zeros(0, np.int64)
            kept = []
            # contexts that the block holds more than once go out once, with their first place
            key = _context_hashes(block, at, h, sizes)
            doc = np.searchsorted(block.starts, at, "right") - 1
            order = np.lexsort((at - block.starts[doc], block.ids[doc], key))
            for start in range(0, len(order), 40_000):
                own = at[order[start : start + 40_000]]
                right, left, after, before, ids, place = block.contexts(own, sizes)
                new = np.ones(len(own), bool)
                new[1:] = ((right[1:] != right[:-1]).any(axis=1) | (left[1:] != left[:-1]).any(axis=1)
                           | (after[1:] != after[:-1]) | (before[1:] != before[:-1]))
                head = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
                copy = (ids != ids[head]) | (place != place[head])
                done.append(_ranges(own[copy], np.maximum(sizes.match - after[copy], 0), before[copy], sizes))
                width = min(LEAD, sizes.gram)  # suffixes of one anchor have one lead
                lead = np.ascontiguousarray(right[~copy][:, :width]).view(f"S{width}").ravel()
                to = np.searchsorted(splitters.value, lead, "right")
                for k in np.unique(to):
                    m = np.flatnonzero(~copy)[to == k]
                    yield int(k), r["block"], _pack(
                        right=right[m], left=left[m], after=after[m], before=before[m], doc=ids[m],
                        place=place[m], at=own[m])
            spans = np.concatenate(done) if done else np.zeros((0, 2), np.int64)
            if len(spans):
                yield -1 - r["block"] % n, r["block"], _pack(done=spans)

    def compare(rows):
        held: dict[int, list] = {}
        for r in rows:
            if r["to"] < 0:
                yield r["block"], _unpack(r["rows"])["done"].tobytes()
            else:
                held.setdefault(r["to"], []).append((r["block"], r["rows"]))
        for to in list(held):  # unpacked one range at a time
            own = [(block, _unpack(packed)) for block, packed in held.pop(to)]
            column = {k: np.concatenate([g[k] for _, g in own]) for k in own[0][1]}
            of = np.repeat(np.arange(len(own)), [len(g["at"]) for _, g in own])
            least, most = judge(*(column[k] for k in ("right", "left", "after", "before", "doc", "place")), sizes)
            hit = np.flatnonzero(most >= least)
            spans = _ranges(column["at"][hit], least[hit], most[hit], sizes)
            cuts = np.searchsorted(of[hit], np.arange(len(own) + 1))
            for (block, _), a, b in zip(own, cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    yield block, spans[a:b].tobytes()

    known = _recurring(blocks, sizes)
    sent = _map(blocks.select("block", "ids", "sizes", "data").join(known, "block", "left"), send,
                "to int, block long, rows binary")
    return (_map(sent.repartition(n, "to"), compare, "block long, spans binary")
            .groupBy("block").agg(F.collect_list("spans").alias("spans")))


def _context_hashes(block: Block, at: np.ndarray, h: np.ndarray, sizes: Sizes) -> np.ndarray:
    """A hash of each whole context, to bring equal ones together."""
    out = h.copy()
    if not len(at):
        return out
    step = 8
    padded = np.r_[np.zeros(sizes.before + step, np.uint8), block.data, np.zeros(sizes.match + step, np.uint8)]
    flat = np.lib.stride_tricks.sliding_window_view(padded, step)
    for shift in range(-sizes.before, sizes.match, step):
        word = np.ascontiguousarray(flat[at + shift + sizes.before + step]).view("<u8").ravel()
        out = mix64(out * _BASE + word)
    return out


def _ranges(at, least, most, sizes: Sizes) -> np.ndarray:
    """Bytes covered by the strings that start ``least`` to ``most`` before each anchor."""
    some = most >= least
    return np.stack([at[some] - most[some], at[some] - least[some] + sizes.match], axis=1).astype(np.int64)


def repeated_substrings(docs: DataFrame, match: int = MATCH, gram: int = GRAM,
                        block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` per row.

    ``spans`` are the maximal removed runs (from, to) in bytes; ``kept`` is what
    remains, as bytes (a cut may fall within a character).  Null and empty texts
    have nothing to remove.  Rows without an id come after all others.  Rows that
    share an id count as one document: a string at the same place in both is not
    earlier in either, so fully repeated rows get equal results.
    """
    sizes = Sizes(match, gram)
    blocks = _store_blocks(docs, block_bytes)

    def cut(rows):
        for r in rows:
            block = Block.of(r)
            edges = np.zeros(len(block.data) + 1, np.int64)
            spans = np.frombuffer(b"".join(r["spans"] or []), np.int64).reshape(-1, 2)
            np.add.at(edges, spans[:, 0], 1)
            np.add.at(edges, spans[:, 1], -1)
            gone = np.cumsum(edges[:-1]) > 0
            for doc_id, a, b in zip(r["ids"], block.starts[:-1], block.starts[1:], strict=True):
                mask = gone[a:b]
                turn = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
                yield (doc_id, int(b - a), int(mask.sum()),
                       [{"a": int(x), "b": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)],
                       block.data[a:b][~mask].tobytes())

    whole = blocks.select("block", "ids", "sizes", "data").join(_verdicts(blocks, sizes), "block", "left")
    return _map(whole, cut, "doc_id long, n_bytes long, n_removed long, "
                            "spans array<struct<a:int,b:int>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
