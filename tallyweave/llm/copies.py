"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of bytes ``b0 .. bn`` is ``b0 * B**n + .. + bn`` modulo ``2**61 - 1``,
for two bases ``B``; with the length it is the key of a text.  The fingerprint of a
whole follows from those of its chunks: each is shifted by ``B`` to the power of the
bytes behind it, and the shifted ones are added.  So the chunks of a long document are
dealt out, hashed where they land and added up, whatever their order; a text of one
chunk is hashed where it lies.

Equal fingerprints are not taken for equal texts.  Texts whose fingerprint occurs again
are compared chunk by chunk: equal chunks of one place collapse in the task that reads
them, so a group of copies sends each chunk once a task, and a second chunk at the same
place shows a collision.  Texts of a collided fingerprint are told apart by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.llm.common import fresh_name, map_rows
from tallyweave.session import cut_lineage

MODULUS = 2**61 - 1
#: Two bases from a rule, equal in every process.
BASES = tuple(int.from_bytes(hashlib.sha256(b"base %d" % i).digest()[:8], "big") % MODULUS for i in range(2))
#: Bytes of a chunk; sums of a chunk's products stay below 64 bits up to 2**24 bytes.
CHUNK = 1 << 16
#: Bits of the filter that picks the texts to compare, as a broadcast table of 64 bits a row.
FILTER_BITS = 1 << 22

KEY = ["n_bytes", "f0", "f1"]


@lru_cache(maxsize=8)
def _powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Low 31 and high 30 bits of ``base`` to the powers ``count - 1 .. 0``."""
    out, power = np.empty(count, np.uint64), 1
    for i in range(count - 1, -1, -1):
        out[i] = power
        power = power * base % MODULUS
    return out & np.uint64(2**31 - 1), out >> np.uint64(31)


def chunk_fingerprint(data: bytes | memoryview, bases: Sequence[int] = BASES, chunk: int = CHUNK) -> list[int]:
    """Fingerprint of at most ``chunk`` bytes by each base."""
    values = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = []
    for base in bases:
        low, high = (p[chunk - len(values):] for p in _powers(base, chunk))
        out.append((int(values @ low) + (int(values @ high) << 31)) % MODULUS)
    return out


def shifted(value: int, behind: int, base: int) -> int:
    """The share of a chunk in a text that goes on for ``behind`` bytes."""
    return value * pow(base, behind, MODULUS) % MODULUS


def fingerprint(data: bytes, bases: Sequence[int] = BASES, chunk: int = CHUNK) -> list[int]:
    """Fingerprint of a text of any length, composed of those of its chunks."""
    total, view = [0] * len(bases), memoryview(data)
    for start in range(0, len(data), chunk):
        part = view[start : start + chunk]
        behind = len(data) - start - len(part)
        for i, (value, base) in enumerate(zip(chunk_fingerprint(part, bases, chunk), bases, strict=True)):
            total[i] = (total[i] + shifted(value, behind, base)) % MODULUS
    return total


def _texts(docs: DataFrame, normalize: Callable[[Column], Column] | None) -> DataFrame:
    """``doc_id, text, n_bytes, mark, text_sha256``; ``mark`` depends on the text alone."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), (normalize(text) if normalize else text).alias("text"),
    ).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"),
             F.xxhash64("text").alias("mark"), F.sha2("text", 256).alias("text_sha256"))


def fingerprints(texts: DataFrame, bases: Sequence[int] = BASES, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, mark, text_sha256, n_bytes, f0, f1`` of each row of :func:`_texts`."""
    def whole(parts):
        for part in parts:
            found = [chunk_fingerprint(t.encode(), bases, chunk) for t in part["text"]]
            yield [part["doc_id"], part["mark"], part["text_sha256"], part["n_bytes"], *map(list, zip(*found, strict=True))]

    def dealt(parts):
        for part in parts:
            found = [[shifted(v, b, base) for v, base in zip(chunk_fingerprint(c, bases, chunk), bases, strict=True)]
                     for c, b in zip(part["piece"], part["behind"], strict=True)]
            yield [*(part[c] for c in ("row", "doc_id", "mark", "text_sha256", "n_bytes")),
                   *map(list, zip(*found, strict=True))]

    shape = "doc_id long, mark long, text_sha256 string, n_bytes long, f0 long, f1 long"
    short = map_rows(texts.filter(F.col("n_bytes") <= chunk), whole, shape)
    # the row number only holds the chunks of a row together; it is read behind one shuffle
    pieces = (
        texts.filter(F.col("n_bytes") > chunk)
        .select("*", F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("bytes"))
        .select("row", "doc_id", "mark", "text_sha256", "n_bytes", "bytes",
                F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(chunk).cast("long"))).alias("at"))
        .select("row", "doc_id", "mark", "text_sha256", "n_bytes",
                F.substring("bytes", (F.col("at") + 1).cast("int"), F.lit(chunk)).alias("piece"),
                F.greatest(F.col("n_bytes") - F.col("at") - chunk, F.lit(0)).alias("behind"))
        .repartition("row", "behind")
    )
    def added(c: str) -> Column:
        return (F.sum(F.col(c).cast("decimal(19,0)")) % F.lit(MODULUS).cast("decimal(19,0)")).cast("long").alias(c)

    long = (map_rows(pieces, dealt, "row long, " + shape, at_once=64)
            .groupBy("row", "doc_id", "mark", "text_sha256", "n_bytes").agg(added("f0"), added("f1")).drop("row"))
    return short.unionByName(long)


def _recurring_texts(texts: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """The texts whose mark is among ``marks``, and a few others.

    The marks become a table of ``bits`` bits, whatever their number, which is all
    that is broadcast: 2**22 bits are 65,536 rows at most.  The more marks, the more other
    texts pass, which costs time and changes no result.
    """
    def word(mark: Column) -> Column:
        return F.pmod(mark, F.lit(bits // 64))

    def bit(mark: Column) -> Column:
        return F.shiftrightunsigned(mark, 40).bitwiseAND(F.lit(63)).cast("int")

    words = marks.groupBy(word(F.col("mark")).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("mark")))).alias("set"))
    return (texts.join(F.broadcast(words), word(F.col("mark")) == F.col("word"))
            .filter(F.call_function("shiftrightunsigned", F.col("set"), bit(F.col("mark"))).bitwiseAND(F.lit(1).cast("long")) == 1)
            .drop("word", "set"))


def _with_key(texts: DataFrame, bases: Sequence[int], chunk: int, pieces: bool) -> DataFrame:
    """The fingerprint key beside each text, or beside each chunk of it and its place."""
    def run(parts):
        for part in parts:
            for i, text in enumerate(part["text"]):
                data = text.encode()
                f0, f1 = fingerprint(data, bases, chunk)
                if pieces:
                    cut = [data[a : a + chunk] for a in range(0, len(data), chunk)]
                    n = len(cut)
                    yield [[len(data)] * n, [f0] * n, [f1] * n, list(range(n)), cut]
                else:
                    yield [[part["doc_id"][i]], [part["text_sha256"][i]], [len(data)], [f0], [f1], [text]]

    shape = "n_bytes long, f0 long, f1 long, "
    shape = shape + "at long, piece binary" if pieces else "doc_id long, text_sha256 string, " + shape + "text string"
    return map_rows(texts, run, shape, at_once=64)


def collided(texts: DataFrame, rows: DataFrame, bases: Sequence[int] = BASES, chunk: int = CHUNK,
             bits: int = FILTER_BITS) -> DataFrame:
    """The keys that belong to several texts, stored; normally none.

    Texts of one key are equally long and so have their chunks at the same places.
    """
    several = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("mark").alias("low"), F.max("mark").alias("high")).filter("n > 1")
    # every row of a key with two marks differs already; with one mark that mark stands for all
    marks = several.filter("low = high").select(F.col("low").alias("mark"))
    chunks = _with_key(_recurring_texts(texts, marks, bits), bases, chunk, pieces=True)
    differ = (chunks.select(*KEY, "at", "piece").distinct()
              .groupBy(*KEY, "at").agg(F.count("*").alias("n")).filter("n > 1").select(*KEY))
    return cut_lineage(differ.union(several.filter("low < high").select(*KEY)).distinct())


def exact_copies(docs: DataFrame, normalize: Callable[[Column], Column] | None = None,
                 bases: Sequence[int] = BASES, chunk: int = CHUNK, bits: int = FILTER_BITS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_bytes, f0, f1, variant`` per row.

    Texts are equal when their bytes are, after ``normalize`` if given.  Of equal texts
    the row of the largest id stays: ``keep_id``.  A null text is empty, and empty texts are
    equal; rows without an id are counted, and stay only where no row of the group has an
    id (``keep_id`` is null then).  Rows that share text and id are one document:
    all of them stay or go.  ``variant`` tells texts of one fingerprint apart, 0 for the first.
    """
    texts = _texts(docs, normalize)
    rows = cut_lineage(fingerprints(texts, bases, chunk))
    clashes = collided(texts, rows, bases, chunk, bits)
    marked = rows.drop("mark").withColumn("variant", F.lit(0))
    if not clashes.isEmpty():
        # which texts share a fingerprint is known from the stored rows; their bytes decide
        marks = rows.join(clashes, KEY, "left_semi").select("mark")
        odd = cut_lineage(_with_key(_recurring_texts(texts, marks, bits), bases, chunk, pieces=False)
                          .join(clashes, KEY, "left_semi"))
        # as many rows in a window as texts share one fingerprint
        number = (odd.select(*KEY, "text").distinct()
                  .withColumn("variant", F.row_number().over(Window.partitionBy(*KEY).orderBy("text")) - 1))
        apart = odd.join(number, [*KEY, "text"]).drop("text")
        marked = marked.join(clashes, KEY, "left_anti").unionByName(apart)
    key = [*KEY, "variant"]
    groups = cut_lineage(marked.groupBy(*key).agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).filter("n > 1"))
    # a key that many rows share is split by the adaptive join: either side comes straight from its shuffle
    return marked.join(groups, key, "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("top"))).alias("kept"),
        "text_sha256", *KEY, "variant")


def deduplicate(docs: DataFrame, normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """The documents, all columns, that :func:`exact_copies` keeps."""
    left = exact_copies(docs, normalize).filter(~F.col("kept")).select("doc_id", "text_sha256").distinct()
    id_name, sha_name = fresh_name(docs, "copy_id"), fresh_name(docs, "copy_sha")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.withColumns({id_name: docs["doc_id"].cast("long"),
                              sha_name: F.sha2(normalize(text) if normalize else text, 256)})
    return keyed.join(left, keyed[id_name].eqNullSafe(left["doc_id"]) & (keyed[sha_name] == left["text_sha256"]),
                      "left_anti").drop(id_name, sha_name)
