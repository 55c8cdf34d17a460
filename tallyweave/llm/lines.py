"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A run of lines is removed where it repeats an earlier one: the same lines in an
earlier document (by id) or further up in the same one.  Lines are compared
without white space at their ends.  Lines without a word are passed over when
runs are compared, and go if they lie within a removed run.

Runs count from ``RUN`` lines, or from ``WORDS`` words in fewer lines.  Of the
two-line grams of any ``RUN`` successive lines the one of least hash is selected
(a shorter run is its own gram), so equal runs share a selected fingerprint at
the same place.  Fingerprints found at one position only end
here.  The others are extended both ways to the runs that selected them, each
of which is compared with the first position it is found at.  What repeats is
merged to maximal runs, which reach both ways as far as the lines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import SPACE, bound, fresh_name, id_and_text
from tallyweave.session import cut_lineage

#: Lines of a run that is removed however short they are; it holds ``RUN - 1`` grams.
RUN = 3
#: Words from which fewer lines are a run as well.
WORDS = 50


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, f"^[{SPACE}]+|[{SPACE}]+$", "")


def _line_hashes(text: Column) -> Column:
    """Place, two 64-bit hashes and number of words of every line with a word."""
    lines = F.transform(F.split(text, "\n"), lambda s, i: F.struct(i.alias("at"), _bare(s).alias("s")))
    return F.transform(
        F.filter(lines, lambda x: x["s"] != ""),
        lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["s"]).alias("h"),
                           F.xxhash64(F.lit(1), x["s"]).alias("g"),
                           F.size(F.split(x["s"], f"[{SPACE}]+")).alias("n")),
    )


def _runs(lines: Column, run: int, words: int) -> Column:
    """Every run of lines: its first and last line, its 128-bit hash, and its fingerprint.

    The fingerprint is the gram of least hash, the first of equal ones.  Runs of
    up to ``run`` lines suffice: longer ones are made of them.
    """
    grams = F.transform(
        F.sequence(F.lit(0), F.size(lines) - 2),
        lambda i: F.xxhash64(F.get(lines, i)["h"], F.get(lines, i + 1)["h"]))

    def mark(gram: Column, i: Column) -> Column:
        # least of (hash, place)
        return F.array_min(F.array(*(
            F.struct(F.get(gram, i + k).alias("h"), (i + k).alias("at")) for k in range(run - 1))))

    def whole(i: Column, n: int, fingerprint: Column) -> Column:
        return F.struct(
            F.get(lines, i)["at"].alias("first"), F.get(lines, i + n - 1)["at"].alias("last"),
            F.xxhash64(F.lit(n), *(F.get(lines, i + k)["h"] for k in range(n))).alias("a"),
            F.xxhash64(F.lit(n), *(F.get(lines, i + k)["g"] for k in range(n))).alias("b"),
            fingerprint.alias("mark"),
        )

    def each(gram: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(lines) - run), lambda i: whole(i, run, mark(gram, i)))

    def short(n: int) -> Column:
        """Runs of fewer lines that have enough words; each is its own gram."""
        def enough(i: Column) -> Column:
            return sum((F.get(lines, i + k)["n"] for k in range(1, n)), F.get(lines, i)["n"]) >= words

        places = F.filter(F.sequence(F.lit(0), F.size(lines) - n), enough)
        return F.when(F.size(lines) >= n, F.transform(places, lambda i: whole(i, n, F.struct(
            F.xxhash64(*(F.get(lines, i + k)["h"] for k in range(n))).alias("h"), i.alias("at")))))

    kinds = [F.when(F.size(lines) >= run, bound(grams, each)), *map(short, range(1, run))]
    return F.flatten(F.filter(F.array(*kinds), lambda k: k.isNotNull()))


def repeated_runs(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """``doc_id, row, spans``: per text the lines (first, last) of its later repeated runs.

    ``row`` hashes the text, so rows that share an id keep their own results.
    """
    runs = id_and_text(docs).select(
        "doc_id", F.xxhash64("text").alias("row"),
        F.explode(bound(bound(F.col("text"), _line_hashes), lambda x: _runs(x, run, words))).alias("r"),
    ).select("doc_id", "row", "r.first", "r.last", "r.a", "r.b", F.col("r.mark.h").alias("mark"),
             F.col("r.mark.at").alias("at"))
    # fingerprints found at more than one position
    place = F.xxhash64("doc_id", "row", "at")
    marks = (runs.groupBy("mark").agg(F.min(place).alias("x"), F.max(place).alias("y"))
             .filter("x < y").select("mark"))
    # positions that share a fingerprint, and the first one of each run: least id, then
    # least line; the tasks combine both aggregates before the shuffle
    key = ["mark", "a", "b"]
    placed = cut_lineage(runs.drop("at").join(marks, "mark", "left_semi"))
    first = (placed.groupBy(*key, "doc_id").agg(F.min("first").alias("line"), F.count("*").alias("n"))
             .groupBy(*key).agg(F.min("doc_id").alias("least"), F.sum("n").alias("n"),
                                F.min(F.when(F.col("doc_id").isNull(), F.col("line"))).alias("nameless"))
             .filter("n > 1").drop("n"))
    several = placed.join(first, key)
    top = (several.filter(F.col("doc_id") == F.col("least")).groupBy(*key)
           .agg(F.min("first").alias("line")))
    later = several.join(top, key, "left").filter(
        F.when(F.col("least").isNull(), F.col("first") > F.col("nameless"))
        .when(F.col("doc_id") == F.col("least"), F.col("first") > F.col("line"))
        .otherwise(True))
    return later.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def marked_lines(docs: DataFrame, run: int = RUN, words: int = WORDS) -> tuple[DataFrame, str]:
    """The documents with an array column of the lines to remove (null: none), and its name."""
    id_name, row_name, gone = (fresh_name(docs, n) for n in ("line_id", "line_row", "line_gone"))
    keyed = docs.withColumns({
        id_name: docs["doc_id"].cast("long"),
        row_name: F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))})
    found = repeated_runs(docs, run, words).select(
        F.col("doc_id").alias(id_name), F.col("row").alias(row_name),
        F.array_distinct(F.flatten(F.transform(
            "spans", lambda s: F.sequence(s["first"], s["last"])))).alias(gone))
    joined = keyed.alias("k").join(found.alias("f"), (
        F.col(f"k.{id_name}").eqNullSafe(F.col(f"f.{id_name}"))
        & (F.col(f"k.{row_name}") == F.col(f"f.{row_name}"))), "left")
    return joined.select("k.*", f"f.{gone}").drop(id_name, row_name), gone


def _left(text: Column, gone: Column) -> Column:
    """The text without the lines ``gone``."""
    return bound(F.split(text, "\n"), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone),
        lambda i: F.get(lines, i)), "\n"))


def deduplicate_lines(docs: DataFrame, run: int = RUN, words: int = WORDS,
                      drop_emptied: bool = False) -> DataFrame:
    """The documents, all columns, with later repeated runs of lines cut from their texts.

    Null texts stay null, texts without a repeated run stay as they are.  A text
    of which every line goes is empty; its row stays unless ``drop_emptied``.
    Rows that share an id are one document: a run at the same line in both is not
    earlier in either, so rows repeated in full get equal results.  Rows without
    an id come after all others.
    """
    joined, gone = marked_lines(docs, run, words)
    left = F.when(F.col(gone).isNull(), F.col("text")).otherwise(_left(F.col("text"), F.col(gone)))
    out = joined.withColumn("text", left)
    if drop_emptied:
        out = out.filter(F.col(gone).isNull() | F.col("text").rlike(f"[^{SPACE}]"))
    return out.drop(gone)


def line_report(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` per row; a null text has no lines."""
    joined, gone = marked_lines(docs, run, words)
    text = F.coalesce(F.col("text"), F.lit(""))
    return joined.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.when(F.col(gone).isNull(), text).otherwise(_left(text, F.col(gone))), 256).alias("kept_sha256"))
