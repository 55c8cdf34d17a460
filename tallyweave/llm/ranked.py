"""Ranked lexical search over a length-stratified index.

A document's score for an item depends on its length only through the normaliser ``m``,
a whole number.  So documents of one ``m`` form a stratum, and within it the impact of a
term depends on ``tf`` alone: postings are kept by term and, within a term, by ``tf``,
and an impact is computed once for each of those groups.

Every task of the index turns its documents into the strata of its own segments, so
nothing is shuffled and a frequent length is never gathered.  A search reads the strata
where they lie.  The sum of a stratum's largest impacts bounds what any of its documents
can score; strata are visited by falling bound, and those whose bound is below the k-th
best score found so far in the task are passed over for that item.  Ranks are therefore exact.
"""

from __future__ import annotations

import bisect
import math
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.llm.common import id_and_text
from tallyweave.operators.skew import top_n_per_group
from tallyweave.session import cut_lineage, shared_dir

#: Shares of a document's own length and of the mean in ``m``, times 100.
SLOPE, BASE = 90, 100
#: Characters of the documents of a segment, or one document.
SEGMENT_CHARS = 2_000_000
#: Bytes of a text that are split at a time.
PIECE = 1 << 22
#: Postings and documents that a search holds at a time, or one stratum; cells of its table of impacts.
AT_ONCE, CELLS = 200_000, 500_000
VISIT = 512
#: Bytes of a row group of the index: its rows are long, and readers hold a row group's at once.
ROW_GROUP = 4 << 20
#: Texts that are taken out of a batch at a time.
ROWS = 200
#: Pairs of an item and a term that are searched for in one pass over the index, or one item.
BLOCK_TERMS = 500_000

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of each byte what a term holds in its place; a space ends terms.  Bytes from 128 on are letters beyond ASCII.
_BYTES = bytes(
    b if b >= 128 or chr(b) in _LOWER + "0123456789" else ord(chr(b).lower()) if chr(b) in _UPPER else 32
    for b in range(256))

#: A stratum of a segment: its documents; its terms, parted by spaces; for each term the number
#: of its groups; for each group its tf and size; for each posting its document's place.  Numbers
#: are packed as 32 bits each, which is far less to hand to Python than lists.
_STRATA = ("m long, docs array<long>, terms string, df array<long>, groups binary, tfs binary, "
           "sizes binary, places binary")


def count_terms(text: str) -> Counter:
    """How often each term occurs; long texts are split piece by piece between two terms."""
    data = text.encode().translate(_BYTES)
    found, start = Counter(), 0
    while start < len(data):
        end = data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end
        found.update(data[start:end].split())
        start = end
    return found


def term_array(text: Column) -> Column:
    """The same terms as an array column."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_TERM), F.lit(0))


@dataclass(frozen=True)
class Index:
    """Strata of all documents with a term, the terms of each segment (``terms, df``), and two totals."""

    strata: DataFrame
    segments: DataFrame
    n_docs: int
    n_terms: int

    def lexicon(self) -> DataFrame:
        """``term, df``: how many documents hold each term."""
        return (self.segments.select(F.inline(F.arrays_zip(F.split("terms", " ").alias("term"), "df")))
                .groupBy("term").agg(F.sum("df").alias("df")))


class Segment:
    """Postings of some documents, as numbers, until they become strata."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.norms: list[int] = []
        self.lengths: list[int] = []
        self.vocabulary: dict[bytes, int] = {}
        self.term, self.tf = array("q"), array("q")
        self.chars = 0

    def add(self, doc_id: int | None, counts: Counter, norm: int, chars: int) -> None:
        self.ids.append(doc_id)
        self.norms.append(norm)
        self.lengths.append(len(counts))
        places = self.vocabulary
        self.term.extend([places.setdefault(t, len(places)) for t in counts])
        self.tf.extend(counts.values())
        self.chars += chars

    def strata(self) -> Iterator[pa.RecordBatch]:
        """The strata, and a row (``m`` null) of the documents by term."""
        return _strata_of(self.ids, self.norms, np.array(self.lengths), np.frombuffer(self.term, np.int64),
                          np.frombuffer(self.tf, np.int64), list(self.vocabulary))


def _strata_of(ids: list, norms: list[int], lengths: np.ndarray, term: np.ndarray, tf: np.ndarray,
               vocabulary: list[bytes]) -> Iterator[pa.RecordBatch]:
    total = len(term)
    words = pa.array(vocabulary, pa.binary()).cast(pa.string())

    levels, stratum = np.unique(np.array(norms, np.int64), return_inverse=True)
    by_norm = np.argsort(stratum, kind="stable")
    n_docs = np.bincount(stratum, minlength=len(levels))
    first = np.cumsum(n_docs) - n_docs
    place = np.empty(len(ids), np.int64)
    place[by_norm] = np.arange(len(ids)) - np.repeat(first, n_docs)

    doc = np.repeat(np.arange(len(ids)), lengths)
    order = np.lexsort((place[doc], tf, term, stratum[doc]))
    s, t, f = stratum[doc][order], term[order], tf[order]
    new_term = np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])]
    new_group = new_term | np.r_[True, f[1:] != f[:-1]]
    at_group, at_term = np.flatnonzero(new_group), np.flatnonzero(new_term)
    sizes = np.diff(np.r_[at_group, total])
    groups = np.diff(np.r_[np.searchsorted(at_group, at_term), len(at_group)])

    def ends(owner: np.ndarray) -> np.ndarray:
        """Ends of the strata's parts, and of an empty one behind them."""
        return np.r_[0, np.cumsum(np.bincount(owner, minlength=len(levels))), len(owner)].astype(np.int32)

    def lists(owner: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends(owner)), values)

    def packed(owner: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(levels) + 1, [
            None, pa.py_buffer(ends(owner) * np.int32(4)), pa.py_buffer(values.astype(np.int32))])

    per_term, per_group = s[at_term], s[at_group]
    held = pa.array(np.bincount(term, minlength=len(words)), pa.int64())
    none, all_words = pa.array([None] * len(levels), pa.list_(pa.int64())), pa.array([0, len(words)], pa.int32())
    columns = [
        pa.array([*levels.tolist(), None], pa.int64()),
        lists(stratum[by_norm], pa.array([ids[i] for i in by_norm.tolist()], pa.int64())),
        pa.concat_arrays([pc.binary_join(lists(per_term, words.take(pa.array(t[at_term])))[:-1], " "),
                          pc.binary_join(pa.ListArray.from_arrays(all_words, words), " ")]),
        pa.concat_arrays([none, pa.ListArray.from_arrays(all_words, held)]),
        packed(per_term, groups), packed(per_group, f[at_group]), packed(per_group, sizes),
        packed(s, place[doc][order]),
    ]
    whole = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _STRATA.split(", ")])
    for start in range(0, whole.num_rows, 200):
        yield whole.slice(start, 200)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def build_index(docs: DataFrame, segment_chars: int = SEGMENT_CHARS) -> Index:
    """Index every document, in two passes over the texts; stored in the shared folder.

    The first pass gives the totals on which ``m`` rests.  Null texts and texts without a
    term are in no stratum; rows that share an id or are repeated are documents
    of their own.
    """
    texts = id_and_text(docs)

    def measure(batches):
        for batch in batches:
            n = [count_terms(t).total() for _, t in _rows(batch)]
            yield pa.RecordBatch.from_pydict({"d": [sum(map(bool, n))], "n": [sum(n)]})

    totals = texts.mapInArrow(measure, "d long, n long").agg(F.sum("d"), F.sum("n")).first()
    n_docs, n_terms = (int(x or 0) for x in totals)

    def invert(batches):
        segment = Segment()
        for batch in batches:
            for doc_id, text in _rows(batch):
                counts = count_terms(text)
                if counts:
                    segment.add(doc_id, counts, BASE - SLOPE + SLOPE * counts.total() * n_docs // n_terms, len(text))
                if segment.chars >= segment_chars:
                    yield from segment.strata()
                    segment = Segment()
        if segment.ids:
            yield from segment.strata()

    path = f"{shared_dir(texts.sparkSession)}/tallyweave/index-{uuid.uuid4().hex}"
    texts.mapInArrow(invert, _STRATA).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    stored = texts.sparkSession.read.schema(_STRATA).parquet(path)
    return Index(stored.filter("m IS NOT NULL").drop("df"), stored.filter("m IS NULL").select("terms", "df"),
                 n_docs, n_terms)


@dataclass(frozen=True)
class Items:
    """Items of one pass: their ids as text, the terms of all, and each item's places in those."""

    ids: list
    terms: list[str]
    weights: np.ndarray
    wanted: list[np.ndarray]

    @classmethod
    def of(cls, index: Index, rows: list) -> Items:
        """Items (``item, terms``) with the weights that the index gives their terms."""
        terms = sorted({t for r in rows for t in r["terms"]})
        places = {t: i for i, t in enumerate(terms)}
        df = document_counts(index, terms)
        weights = [math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for n in df.tolist()]
        held = [np.array(sorted(places[t] for t in r["terms"] if df[places[t]]), np.int64) for r in rows]
        return cls([r["item"] for r in rows], terms, np.array(weights, np.int64), held)


def document_counts(index: Index, terms: list[str]) -> np.ndarray:
    """How many documents hold each of the terms; at most a block of terms at a time."""
    spark = index.segments.sparkSession
    shared = spark.sparkContext.broadcast(terms)

    def run(batches):
        counts, asked = np.zeros(len(shared.value), np.int64), pa.array(shared.value, pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                at = pc.index_in(pc.split_pattern(row.column(0), " ").flatten(), value_set=asked)
                known = pc.is_valid(at).to_numpy(zero_copy_only=False)
                counts[pc.drop_null(at).to_numpy()] += row.column(1).flatten().to_numpy()[known]
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"i": held, "n": counts[held]})

    out = np.zeros(len(terms), np.int64)
    for row in index.segments.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[row["i"]] = row["n"]
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    """All packed numbers of a column, one row behind the other."""
    if not len(column):
        return np.zeros(0, np.int32)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.int32) if at[-1] > at[0] else np.zeros(0, np.int32)


def _lengths(column: pa.Array) -> np.ndarray:
    """Values of each row: of a list, or of packed numbers."""
    if pa.types.is_list(column.type):
        return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4


class Search:
    """The best documents of each item among the strata seen so far."""

    def __init__(self, items: Items, k: int):
        self.items, self.k = items, k
        self.terms = pa.array(items.terms, pa.string())
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in items.ids]
        #: Least score that can still enter, by item.
        self.least = np.ones(len(items.ids), np.int64)
        self.visited = self.passed = 0

    def add(self, batch: pa.RecordBatch) -> None:
        """Search a batch of strata, as many at a time as hold ``AT_ONCE`` postings and documents."""
        load = _lengths(batch.column("places")) + _lengths(batch.column("docs"))
        width = max(1, CELLS // max(1, len(self.items.terms)))
        start = 0
        while start < batch.num_rows:
            end = start + 1 + int(np.searchsorted(np.cumsum(load[start + 1 : start + width]), AT_ONCE - load[start], "right"))
            self._strata(batch.slice(start, end - start))
            start = end

    def _strata(self, batch: pa.RecordBatch) -> None:
        m = batch.column("m").to_numpy()
        groups, sizes, places = (_numbers(batch.column(c)) for c in ("groups", "sizes", "places"))
        tfs = _numbers(batch.column("tfs")).astype(np.int64)
        docs = batch.column("docs").flatten()
        asked = pc.index_in(pc.split_pattern(batch.column("terms"), " ").flatten(), value_set=self.terms)
        asked = pc.fill_null(asked, -1).to_numpy().astype(np.int64)
        row_of_term = np.repeat(np.arange(len(m)), _lengths(batch.column("groups")))
        term_of_group = np.repeat(np.arange(len(asked)), groups)
        wanted = asked[term_of_group] >= 0
        # once for each term and tf of a stratum
        tf, owner = tfs[wanted], term_of_group[wanted]
        q, row = asked[owner], row_of_term[owner]
        impact = self.items.weights[q] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        highest = np.zeros((len(m), len(self.items.terms) + 1), np.int64)
        highest[row, q] = impact  # groups of a term ascend by tf, and impacts with them
        bounds = np.stack([highest[:, w].sum(axis=1) for w in self.items.wanted], axis=1)

        order = np.argsort(-bounds.max(axis=1), kind="stable")
        n_docs = _lengths(batch.column("docs"))
        first = np.cumsum(n_docs) - n_docs
        start = np.empty(len(m), np.int64)  # of each stratum among the documents as visited
        start[order] = np.cumsum(n_docs[order]) - n_docs[order]
        visit_row = np.repeat(order, n_docs[order])
        visit_doc = np.arange(len(visit_row)) - np.repeat(start[order], n_docs[order]) + np.repeat(first[order], n_docs[order])
        held = np.repeat(wanted, sizes)
        at = start[np.repeat(row, sizes[wanted])] + places[held]
        by_visit = np.argsort(at, kind="stable")
        at, q, impact = at[by_visit], np.repeat(q, sizes[wanted])[by_visit], np.repeat(impact, sizes[wanted])[by_visit]

        step = min(VISIT, max(1, CELLS // len(self.items.terms)))
        for a in range(0, len(visit_row), step):
            b = min(a + step, len(visit_row))
            open_items = np.flatnonzero(bounds[np.unique(visit_row[a:b])].max(axis=0) >= self.least)
            self.passed += len(self.items.ids) - len(open_items)
            self.visited += len(open_items)
            if len(open_items):
                lo, hi = np.searchsorted(at, (a, b))
                self._score(open_items, q[lo:hi], at[lo:hi] - a, impact[lo:hi], docs.take(pa.array(visit_doc[a:b])))

    def _score(self, open_items, q, at, impact, docs: pa.Array) -> None:
        present, local = np.unique(q, return_inverse=True)
        table = np.zeros((len(present) + 1, len(docs)), np.int64)
        table[local, at] = impact
        line = np.full(len(self.items.terms), len(present), np.int64)  # the last line is empty
        line[present] = np.arange(len(present))
        nameless = pc.is_null(docs).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(docs, 0).to_numpy()
        for i in open_items.tolist():
            lines = line[self.items.wanted[i]]
            score = table[lines[lines < len(present)]].sum(axis=0)
            hits = np.flatnonzero(score >= self.least[i])
            if len(hits):
                hits = hits[np.lexsort((ids[hits], nameless[hits], -score[hits]))[: self.k]]
                best = self.best[i]
                for d in hits.tolist():
                    bisect.insort(best, (-int(score[d]), bool(nameless[d]), int(ids[d])))
                del best[self.k :]
                if len(best) == self.k:
                    self.least[i] = max(1, -best[-1][0])

    def found(self) -> Iterator[tuple]:
        for i, best in zip(self.items.ids, self.best, strict=True):
            for score, nameless, doc in best:
                yield i, None if nameless else doc, -score


def item_terms(items: DataFrame) -> DataFrame:
    """``item, terms``: each item's id as text and its distinct terms.

    Rows that share an id, or have none, are one item.
    """
    own = term_array(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return items.select(F.col("item_id").cast("string").alias("item"), own.alias("t")).groupBy("item").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("t")))).alias("terms")).filter(F.size("terms") > 0)


def _blocks(rows: Iterator, block_terms: int) -> Iterator[list]:
    block, size = [], 0
    for row in rows:
        if block and size + len(row["terms"]) > block_terms:
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row["terms"])
    if block:
        yield block


def search(index: Index, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item.

    Only scores above 0 count; equal ones are ranked by ascending id, rows without an id last.
    Null and empty items find nothing.  Items are searched for in passes of
    ``block_terms`` terms each, which is what a task gets to hold of them.
    """
    spark, kind = items.sparkSession, items.schema["item_id"].dataType
    asked = cut_lineage(item_terms(items))
    shape = "item string, doc_id long, score long"
    out = spark.createDataFrame([], shape)
    for block in _blocks(asked.toLocalIterator(), block_terms):
        shared = spark.sparkContext.broadcast(Items.of(index, block))

        def run(batches, shared=shared):
            seen = Search(shared.value, k)
            for batch in batches:
                seen.add(batch)
            rows = list(seen.found())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                names=["item", "doc_id", "score"])

        out = out.unionByName(index.strata.mapInArrow(run, shape))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = top_n_per_group(out.withColumn("part", F.spark_partition_id()), ["item"], order, k, ["part"])
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return ranked.select(F.col("item").cast(kind).alias("item_id"), rank.alias("rank"), "doc_id", "score")
