"""Phrase collocations by top-order marginalisation.

Every word starts one window: itself and the words that lead it on in its piece, as
columns, padded with ``''`` behind the piece's end.  Only these longest windows are
counted, first in the task that reads the text, then where all windows of one leading
pair meet.  A shorter phrase is a prefix of the windows that start where it does, so its
count is a sum over them, and no phrase of another length is ever made from the text.
Prefixes down to pairs are summed where the windows are; a ROLLUP over the pairs sums
single words and all words of a language.  Padding keeps the sums whole: a phrase at the
end of a piece is the prefix of a padded window.

What occurs often enough is stored; all that follows joins within that.  A phrase that
occurs so often has parts that do, hence no count is missing there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.operators.skew import top_n_per_group
from tallyweave.session import cut_lineage

#: Most words of a phrase, least occurrences, phrases reported for each language, and the
#: share (in percent) of a phrase's occurrences within one longer phrase that makes it a part of that.
ORDER, LEAST, TOP, INSIDE = 3, 10, 2000, 50
#: Characters that a task counts windows of at a time; longer texts are cut between words.
AT_ONCE = 8_000_000

#: Of each byte what stands in its place: A-Z in lower case, a space for a gap, 255 (in no UTF-8 text) where a piece ends.
_END = 255
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b in b" \t" else _END if b in b".,;:!?\x0a\x0b\x0c\x0d" else b for b in range(256))


def _portions(data: bytes, order: int, size: int) -> Iterator[tuple[bytes, int]]:
    """Cuts of about ``size`` bytes, and how many words start windows in each; the rest only leads on."""
    start = 0
    while start < len(data):
        end = data.find(b" ", start + size)
        end = stop = len(data) if end < 0 else end
        for _ in range(order - 1):
            while stop < len(data) and data[stop] == 32:
                stop += 1
            stop = data.find(b" ", stop)
            stop = len(data) if stop < 0 else stop
        yield data[start:stop], len(data[start:end].split())
        start = end


def _windows(data: bytes, owned: int, order: int) -> tuple[list[pa.Array], np.ndarray]:
    """The distinct windows that the first ``owned`` words start, sorted, and how often each occurs."""
    # the end of a piece is a word of its own until windows are cut there
    coded = pa.array(data.split(), pa.binary()).dictionary_encode()
    by_bytes = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(by_bytes), np.uint64)
    rank[by_bytes] = np.arange(1, len(by_bytes) + 1, dtype=np.uint64)
    ids = rank[coded.indices.to_numpy()]
    found = coded.dictionary.index(pa.scalar(bytes([_END]), pa.binary())).as_py()
    end = rank[found] if found >= 0 else np.uint64(0)
    starts = np.flatnonzero(ids[:owned] != end)
    columns, led = [ids[starts]], np.ones(len(starts), bool)
    ids = np.concatenate([ids, np.full(order, end)])
    for i in range(1, order):
        word = ids[starts + i]
        led = led & (word != end)
        columns.append(np.where(led, word, 0))
    # as many columns as fit are compared as one number
    bits, keys, room = len(by_bytes).bit_length(), [], 0
    for c in columns:
        if keys and room >= bits:
            keys[-1], room = (keys[-1] << np.uint64(bits)) | c, room - bits
        else:
            keys, room = [*keys, c.copy()], 64 - bits
    order_ = np.lexsort(keys[::-1])
    new = np.zeros(len(starts), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order_][1:] != k[order_][:-1]
    at = np.flatnonzero(new)
    words = pa.concat_arrays([pa.array([b""], pa.binary()), coded.dictionary.take(pa.array(by_bytes))])
    # the end marker is no text, and no window holds it
    text = pc.if_else(pc.equal(words, pa.scalar(bytes([_END]), pa.binary())), b"", words).cast(pa.string())
    return [text.take(pa.array(c[order_][at])) for c in columns], np.diff(np.r_[at, len(starts)])


def _joined(columns: list[pa.Array]) -> pa.Array:
    """Words up to the padding, joined by a space."""
    out = columns[0]
    for c in columns[1:]:
        out = pc.if_else(pc.equal(c, ""), out, pc.binary_join_element_wise(out, c, " "))
    return out


def packed_windows(docs: DataFrame, order: int = ORDER, at_once: int = AT_ONCE) -> DataFrame:
    """``window``: longest windows, counted by task, as text (see :func:`unpacked`).

    One text a row is less to shuffle than its columns, and windows come sorted from
    each portion of the documents, for the same reason.
    """
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))

    def portions(texts: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in texts.items():
            for data, owned in _portions(b" \xff ".join(parts), order, at_once):
                columns, counts = _windows(data, owned, order)
                whole = pa.RecordBatch.from_arrays([pc.binary_join_element_wise(
                    _joined(columns[:2]), _joined(columns[2:]) if order > 2 else "",
                    pa.array(counts, pa.int64()).cast(pa.string()), lang, "\n")], names=["window"])
                for start in range(0, len(counts), 50_000):
                    yield whole.slice(start, 50_000)

    def run(batches):
        texts, size = defaultdict(list), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = text.encode().translate(_BYTES).replace(b"\xff", b" \xff ")
                    texts[lang].append(data)
                    size += len(data)
                    if size >= at_once:
                        yield from portions(texts)
                        texts, size = defaultdict(list), 0
        yield from portions(texts)

    return rows.mapInArrow(run, "window string")


def unpacked(windows: DataFrame) -> DataFrame:
    """``lang, lead, tail, c`` of packed windows.

    ``lead`` holds the first two columns and ``tail`` the others, without the padding.
    A line feed, which no word holds, parts them.
    """
    parts = windows.select(_lead().alias("lead"), F.split("window", "\n", 4).alias("p"))
    return parts.select(F.get("p", F.lit(3)).alias("lang"), "lead", F.get("p", F.lit(1)).alias("tail"),
                        F.get("p", F.lit(2)).cast("long").alias("c"))


def _lead() -> Column:
    return F.substring_index("window", "\n", 1)


def _n_words(phrase: Column) -> Column:
    return F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ")))


def _long_counts(docs: DataFrame, order: int, least: int) -> DataFrame:
    """``lang, lead, tail, f``: every pair (no ``tail``), and longer phrases found ``least`` times.

    All windows of a leading pair meet in one task, so they are counted and
    their prefixes summed there, without a further shuffle.
    """
    met = unpacked(packed_windows(docs, order).repartition(_lead()))
    whole = met.groupBy("lang", "lead", "tail").agg(F.sum("c").alias("c"))
    # a window counts for its own length if that may suffice, and for each prefix of it
    levels = [F.lit("")] + [F.when(
        (_n_words(F.col("tail")) >= n) & ((F.col("c") >= least) | F.lit(n < order - 2)), _words(F.col("tail"), 0, n))
        for n in range(1, order - 1)]
    each = whole.select("lang", "lead", "c", F.explode(F.array_compact(F.array(*levels))).alias("tail"))
    return (each.groupBy("lang", "lead", "tail").agg(F.sum("c").alias("f"))
            .filter((F.col("tail") == "") | (F.col("f") >= least)))


def phrase_counts(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """``lang, size, phrase, f`` of every phrase of up to ``order`` words found ``least`` times.

    Size 0 (``phrase`` empty) is the number of words of a language, however few.  Words are
    joined by a space, which no word holds.
    """
    long = cut_lineage(_long_counts(docs, order, least))
    # a lead of one word is one at a piece's end
    pairs = long.filter("tail = ''").select("lang", F.substring_index("lead", " ", 1).alias("w1"), "f")
    short = pairs.rollup("lang", "w1").agg(F.sum("f").alias("f"), F.grouping_id().alias("g"))
    words = short.filter((F.col("g") == 1) | ((F.col("g") == 0) & (F.col("f") >= least))).select(
        "lang", (1 - F.col("g")).cast("int").alias("size"), F.coalesce("w1", F.lit("")).alias("phrase"), "f")
    phrase = F.when(F.col("tail") == "", F.col("lead")).otherwise(F.concat_ws(" ", "lead", "tail"))
    return long.filter(F.contains("lead", F.lit(" ")) & (F.col("f") >= least)).select(
        "lang", _n_words(phrase).cast("int").alias("size"), phrase.alias("phrase"), "f").unionByName(words)


def _words(phrase: Column, first: int, count: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first + 1, count), " ")


def _exact_score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 * a * a / (left * right))`` in whole numbers of 38 digits."""
    a, left, right = (c.cast("decimal(19,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right)


def scored(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, phrase, size, a, l, r, score`` of every phrase of two words or more, by its weakest cut."""
    found = counts.filter("size >= 2")
    # every part on either side of a cut, looked up in one join
    parts = F.flatten(F.array(*(
        F.when(F.lit(k) < F.col("size"), F.array(
            F.struct(F.lit(k).alias("k"), F.lit(True).alias("left"), _words(F.col("phrase"), 0, k).alias("part")),
            F.struct(F.lit(k).alias("k"), F.lit(False).alias("left"), _words(F.col("phrase"), k, order).alias("part")),
        )).otherwise(F.array().cast("array<struct<k:int,left:boolean,part:string>>")) for k in range(1, order))))
    asked = found.select("lang", "phrase", "size", F.col("f").alias("a"), F.inline(parts))
    held = counts.filter("size >= 1").select("lang", F.col("phrase").alias("part"), "f")
    side = {(k, s): F.max(F.when((F.col("k") == k) & (F.col("left") == s), F.col("f")))
            for k in range(1, order) for s in (True, False)}
    cuts = asked.join(held, ["lang", "part"]).groupBy("lang", "phrase", "size", "a").agg(
        *(v.alias(f"{'l' if s else 'r'}{k}") for (k, s), v in side.items()))
    best = F.array_min(F.filter(F.array(*(
        F.when(F.col(f"l{k}").isNotNull(), F.struct(
            _exact_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
            F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, order))), lambda c: c.isNotNull()))
    return cuts.select("lang", "phrase", "size", "a", best.alias("cut")).select(
        "lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def _longest_holder(counts: DataFrame, order: int) -> DataFrame:
    """``lang, phrase, held``: most occurrences of a longer phrase that holds the phrase."""
    inner = F.flatten(F.array(F.array().cast("array<string>"), *(
        F.when((F.lit(n + start) <= F.col("size")) & (F.lit(n) < F.col("size")),
               F.array(_words(F.col("phrase"), start, n))).otherwise(F.array().cast("array<string>"))
        for n in range(2, order) for start in range(order - n + 1))))
    return (counts.filter("size >= 3").select("lang", "f", F.explode(F.array_distinct(inner)).alias("phrase"))
            .groupBy("lang", "phrase").agg(F.max("f").alias("held")))


def collocations(docs: DataFrame, order: int = ORDER, least: int = LEAST, top: int = TOP,
                 inside: int = INSIDE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    Only A-Z is lower-cased.  Texts without a word, null ones included, give
    nothing; a null language is ``und``; repeated rows count as often as they occur.  Rank is
    by score, then occurrences, then the phrase's bytes.
    """
    if order < 2:
        raise ValueError("a phrase has two words at least")
    counts = cut_lineage(phrase_counts(docs, order, least))
    holders = _longest_holder(counts, order)
    alone = (scored(counts, order).join(holders, ["lang", "phrase"], "left")
             .filter(F.col("held").isNull() | (100 * F.col("held") < inside * F.col("a"))))
    ranking = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = top_n_per_group(alone, ["lang"], ranking, top, ["phrase"])
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    # at most ``top`` rows a language are left
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*ranking)).cast("long")).join(
        totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
