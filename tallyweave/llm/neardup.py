"""Near-duplicates by b-bit MinHash.

Texts with one set of shingles form a class that its smallest id represents.
Each class has a signature of minima; runs of minima (bands) give candidate
pairs, the low bits of all minima (b-bit signature) estimate the similarity of a
pair, corrected for chance agreement, and drop hopeless ones by bit counts.
What is left is confirmed on the full shingle sets of both texts.

A band bucket is resolved by stars, never by all its pairs: its smallest members
are compared with the others, confirmed links are contracted to components, and
members that the next stars would compare within one component are skipped.  The
number of star centres grows fourfold each round until every bucket is decided,
so each pair of a bucket is compared, known to be in one component, or ruled out:
shingles that no other candidate has bound every intersection from above.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.llm.common import fresh_name, id_and_text, lowered_words, map_rows, mix64, shingle_hashes
from tallyweave.session import cut_lineage

SHINGLE = 5
THRESHOLD = 80
#: Minima per band; chance that a pair at the threshold shares no band.
BAND_ROWS = 4
MISSED = 1e-7
#: Low bits kept of each minimum; standard errors that an estimate may fall short: at both
#: thresholds, 80 and 85, the exact binomial tail beyond them is under ``MISSED``.
BITS = 2
MARGIN = 6.2

_STEP = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: int, rows: int = BAND_ROWS, missed: float = MISSED) -> int:
    """Bands needed so that similar pairs share one, all but a share ``missed``."""
    return math.ceil(math.log(missed) / math.log(1 - (threshold / 100) ** rows))


def minima(h: np.ndarray, n: int, at_once: int = 512) -> np.ndarray:
    """Least value of each of ``n`` independent hash functions over a set of 64-bit hashes.

    Every turn scrambles the whole hash anew; its halves are two functions.
    """
    seeds = mix64(np.arange(1, n // 2 + n % 2 + 1, dtype=np.uint64) * _STEP)[:, None]
    out = np.full((2, len(seeds)), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(h), at_once):
        values = mix64(h[start : start + at_once] ^ seeds)
        for least, half in zip(out, (values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)), strict=True):
            np.minimum(least, half.min(axis=1), out=least)
    return out.reshape(-1)[:n]


def signatures(docs: DataFrame, bands: int, shingle: int = SHINGLE) -> DataFrame:
    """Per row: size and fingerprint (two longs) of the shingle set, bands, and low bits.

    ``bits`` holds, for each low bit, the bits of all minima packed into longs.
    """
    n = bands * BAND_ROWS
    words = -(-n // 64)

    def run(parts):
        number = np.arange(bands, dtype=np.uint64)
        for part in parts:
            size, first, second, keys, bits = [], [], [], [], []
            for text in part["text"]:
                h = shingle_hashes(lowered_words(text), shingle)
                size.append(len(h))
                first.append(int(mix64(h).sum().astype(np.int64)))
                second.append(int(np.bitwise_xor.reduce(mix64(h + np.uint64(77))).astype(np.int64)) if len(h) else 0)
                least = minima(h, n)
                key = number
                for column in least.reshape(bands, BAND_ROWS).T.astype(np.uint64):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column)
                keys.append(key.astype(np.int64) if len(h) else [])
                planes = np.zeros((BITS, words * 64), np.uint8)
                planes[:, :n] = (least >> np.arange(BITS, dtype=np.uint32)[:, None]) & 1
                bits.append(np.packbits(planes, axis=1, bitorder="little").reshape(-1).view(np.int64))
            yield [part["doc_id"], size, first, second, keys, bits]

    return map_rows(id_and_text(docs), run,
                    "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, bits array<long>", 500)


def estimate(a: Column, b: Column, n: int) -> Column:
    """Similarity from two packed b-bit signatures, corrected for chance agreement.

    Minima that differ agree in their low bits once in ``2 ** BITS``.
    """
    words = -(-n // 64)
    differ = [
        F.bit_count(_any_bit([F.get(a, F.lit(p * words + w)).bitwiseXOR(F.get(b, F.lit(p * words + w)))
                              for p in range(BITS)]))
        for w in range(words)
    ]
    agree = F.lit(1.0) - sum(differ[1:], differ[0]) / n
    chance = 2.0 ** -BITS
    return (agree - chance) / (1 - chance)


def _any_bit(values: list[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out.bitwiseOR(v)
    return out


def least_estimate(threshold: int, n: int) -> float:
    """The estimate below which a pair at the threshold practically never falls."""
    chance = 2.0 ** -BITS
    agree = chance + (1 - chance) * threshold / 100
    return threshold / 100 - MARGIN * math.sqrt(agree * (1 - agree) / n) / (1 - chance)


def _confirmed(pairs: DataFrame, texts: DataFrame, threshold: int, shingle: int) -> DataFrame:
    """The pairs (a, b) whose texts' full shingle sets are similar enough."""
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))

    def run(parts):
        for part in parts:
            a, b = [], []
            seen: dict[str, np.ndarray] = {}  # texts of this part only
            for x, y, s, t in zip(part["a"], part["b"], part["text_a"], part["text_b"], strict=True):
                u, v = (seen[k] if k in seen else seen.setdefault(k, shingle_hashes(lowered_words(k), shingle))
                        for k in (s, t))
                common = len(np.intersect1d(u, v, assume_unique=True))
                if 100 * common >= threshold * (len(u) + len(v) - common):
                    a.append(x)
                    b.append(y)
            yield [a, b]

    return map_rows(both.select("a", "b", "text_a", "text_b"), run, "a long, b long", 200)


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for the nodes of the edges (a, b): the smallest node reachable.

    Every node hooks to its least neighbour, paths are halved twice, and edges
    are drawn anew between what the nodes hooked to, until none are left.
    """
    labels = None
    edges = cut_lineage(edges.filter("a <> b").distinct())
    while labels is None or not edges.isEmpty():
        ends = edges.union(edges.select("b", "a"))
        parent = ends.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
        parent = cut_lineage(_renamed(cut_lineage(_renamed(cut_lineage(parent), "label")), "label"))
        labels = parent if labels is None else cut_lineage(merge_labels(labels, parent))
        edges = cut_lineage(_renamed(_renamed(edges, "a", parent), "b", parent).filter("a <> b").distinct())
    return labels


def merge_labels(labels: DataFrame, further: DataFrame) -> DataFrame:
    """Labels whose own nodes may have got further ones; nodes new to the labels are added."""
    fresh = further.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return _renamed(labels, "label", further).select("node", "label").union(fresh)


def _renamed(df: DataFrame, column: str, labels: DataFrame | None = None) -> DataFrame:
    """The column's nodes replaced by their labels, where they have one (by default, those of ``df``)."""
    to = (df if labels is None else labels).select(F.col("node").alias("_from"), F.col("label").alias("_to"))
    return df.join(to, F.col(column) == F.col("_from"), "left").withColumn(
        column, F.coalesce("_to", column)).drop("_from", "_to")


def _lonely_shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """``node, lonely``: how many of a node's shingles no other node has."""
    def run(parts):
        for part in parts:
            sets = [shingle_hashes(lowered_words(t), shingle) for t in part["text"]]
            yield [np.repeat(np.array(part["node"], np.int64), list(map(len, sets))),
                   np.concatenate(sets).astype(np.int64) if sets else []]

    held = map_rows(texts, run, "node long, h long", 100)
    alone = held.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("most")).filter("node = most")
    return alone.groupBy("node").agg(F.count("*").alias("lonely"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row.

    Documents are linked when 100 * intersection >= threshold * union of their
    shingle sets; ``component_id`` is the smallest id reachable.  Texts without
    words are linked with nothing.  Rows that share an id are one document with
    several texts.  A row without an id has no component and is kept.
    """
    bands = bands_for(threshold)
    signed = cut_lineage(signatures(docs, bands, shingle))
    named = signed.filter("doc_id is not null and n_shingles > 0")
    classes = cut_lineage(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("node")))
    labels = _link(docs, named, classes, bands, threshold, shingle)
    if labels is not None:
        classes = _renamed(classes, "node", labels)
    found = (signed.select("doc_id", "n_shingles", "k1", "k2")
             .join(classes, ["k1", "k2"], "left")
             .withColumn("component_id", F.when(
                 F.col("doc_id").isNotNull(),
                 F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id")))))
    return found.select("doc_id", "n_shingles", "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _candidates(docs: DataFrame, named: DataFrame, classes: DataFrame, threshold: int, shingle: int):
    """Members of shared buckets (bucket, node, n, core, keys, bits), and the nodes' texts.

    ``keys`` are a node's buckets by band, ``bits`` the low bits of its minima.

    ``core`` counts the shingles that some other candidate has too, an upper
    bound of every intersection.
    """
    own = named.join(classes.withColumnRenamed("node", "doc_id"), ["k1", "k2", "doc_id"], "left_semi")
    rows = own.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("node")).distinct()
    shared = (rows.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"))
              .filter("least < most").select("bucket"))
    members = cut_lineage(rows.join(shared, "bucket", "left_semi"))
    nodes = members.select("node").distinct()
    texts = cut_lineage(id_and_text(docs).withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi"))
    # a node with several texts is bounded by the least and the largest, and not estimated
    several = F.col("one") != F.col("other")
    sizes = (own.withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi").groupBy("node")
             .agg(F.max("n_shingles").alias("most"), F.min("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("keys"),
                  F.min("k1").alias("one"), F.max("k1").alias("other")))
    sized = cut_lineage(
        sizes.join(_lonely_shingles(texts, shingle), "node", "left")
        .select("node", "n", *(F.when(~several, F.col(c)).alias(c) for c in ("bits", "keys")),
                F.when(several, F.col("most")).otherwise(F.col("n") - F.coalesce("lonely", F.lit(0))).alias("core"))
        .filter(100 * F.col("core") >= threshold * F.col("n")))
    return members.join(sized, "node"), texts


def _link(docs, named, classes, bands: int, threshold: int, shingle: int) -> DataFrame | None:
    """Labels of the linked classes; None if no two are linked."""
    n = bands * BAND_ROWS
    bound = least_estimate(threshold, n)
    live, texts = _candidates(docs, named, classes, threshold, shingle)
    labels, round_ = None, 0
    while True:
        live = _open(live, labels, threshold)
        if live.isEmpty():
            return labels
        # stars: the members with most in common with others are the centres
        by_core = Window.partitionBy("bucket").orderBy(F.col("n") - F.col("core"), "node")
        centres = cut_lineage(
            live.withColumn("_n", F.row_number().over(by_core)).filter(F.col("_n") <= 4 ** round_)
            .select("bucket", F.col("node").alias("a"), F.col("label").alias("label_a"),
                    F.col("n").alias("n_a"), F.col("core").alias("core_a"), F.col("keys").alias("keys_a"), F.col("bits").alias("bits_a")))
        common = F.least("core", "core_a")
        # centres come first in their order, so a pair of them is made once; a pair that
        # shares an earlier band is made (or ruled out) in that bucket
        ahead = F.struct(F.col("n_a") - F.col("core_a"), "a") < F.struct(F.col("n") - F.col("core"), "node")
        earlier = F.array_position("keys", F.col("bucket")).cast("int") - 1
        elsewhere = F.arrays_overlap(*(F.slice(c, F.lit(1), earlier) for c in ("keys", "keys_a")))
        hopeful = F.coalesce(estimate(F.col("bits"), F.col("bits_a"), n) >= bound, F.lit(True))
        pairs = (live.join(centres, "bucket")
                 .filter((F.col("label") != F.col("label_a"))
                         & (100 * common >= threshold * (F.col("n") + F.col("n_a") - common))
                         & ahead & hopeful & ~F.coalesce(elsewhere, F.lit(False)))
                 .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")))
        pairs = cut_lineage(pairs)
        if not pairs.isEmpty():
            links = _confirmed(pairs, texts, threshold, shingle)
            if labels is not None:  # only what joins different components is new
                links = _renamed(_renamed(links, "a", labels), "b", labels)
            further = components(links)
            labels = further if labels is None else cut_lineage(merge_labels(labels, further))
        # every pair with a centre is decided now
        live = live.drop("label").join(
            centres.select("bucket", F.col("a").alias("node")), ["bucket", "node"], "left_anti")
        round_ += 1


def _open(live: DataFrame, labels: DataFrame | None, threshold: int) -> DataFrame:
    """The members that may still find a partner in their bucket, with their labels.

    A bucket within one component is decided.  A member's best partner has the
    bucket's least size or just the member's core; if even that falls short of
    the threshold, the member leaves.
    """
    live = live.withColumn("label", F.col("node"))
    if labels is not None:
        live = _renamed(live, "label", labels)
    stats = live.groupBy("bucket").agg(
        F.min("label").alias("_x"), F.max("label").alias("_y"), F.min("n").alias("_n")).filter("_x < _y")
    best = F.greatest("_n", "core")
    return cut_lineage(
        live.join(stats, "bucket")
        .filter(100 * F.col("core") >= threshold * (F.col("n") + best - F.col("core")))
        .drop("_x", "_y", "_n"))


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents, all columns, with one of each group; repeated rows leave one."""
    key, place = fresh_name(docs, "near_key"), fresh_name(docs, "near_place")
    kept = near_duplicates(docs, threshold).filter("kept").select(F.col("doc_id").alias(key)).distinct()
    keyed = docs.withColumn(key, docs["doc_id"].cast("long"))
    # the join has brought the rows of an id together and in order
    one = Window.partitionBy(key).orderBy(key, "text")
    first = (keyed.join(kept, key, "left_semi").withColumn(place, F.row_number().over(one))
             .filter(F.col(place) == 1).drop(place))
    return first.unionByName(keyed.filter(F.col(key).isNull())).drop(key)
