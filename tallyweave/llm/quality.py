"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one failure bit per rule; policies are versioned sets of bits that are
applied to the ledger without looking at the text again, and ablations (what a
policy would keep without one of its rules) are bitwise aggregates of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import SPACE, bound, id_and_text

#: Rules in bit order: name and the condition under which a document fails.
#: Ratios are compared in whole numbers.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    ("shouting", "100 * n_upper > 40 * word_chars"),
    ("exclamation", "100 * n_exclaim > 25 * n_words"),
    ("bars", "100 * n_bars > 15 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "n_lines", "n_upper", "n_exclaim", "n_bars")


@dataclass(frozen=True)
class Policy:
    """A named version: the rules a document must not fail."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
DEFAULT = Policy("default", 1, tuple(BIT))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Windows are sorted with their places, so equal ones become neighbours; the
    places of repeated windows are then walked in order, each adding the words
    it covers beyond the place before it.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(
            F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"),
            i.alias("at"),
        ),
    )
    repeated = bound(F.sort_array(windows), lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, i: F.get(s, i - 1)["w"].eqNullSafe(x["w"]) | F.get(s, i + 1)["w"].eqNullSafe(x["w"])),
        lambda x: x["at"],
    )))
    covered = bound(repeated, lambda p: F.aggregate(
        F.transform(p, lambda at, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - at), F.lit(3))),
        F.lit(0), lambda total, n: total + n,
    ))
    return F.when(F.size(words) >= 3, covered).otherwise(0)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with every figure that the rules use.

    Null and empty texts measure 0 throughout.  A line counts as repeated when
    it holds a word and equals an earlier line of the same text.
    """
    text = F.col("text")
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(f"[^{SPACE}]"))
    both = id_and_text(docs, id_col, text_col).select(
        "doc_id", "text", words.alias("words"), lines.alias("lines"))
    return both.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        bound(F.col("words"), _repeat_words).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        _count(text, "!").cast("long").alias("n_exclaim"),
        _count(text, "|").cast("long").alias("n_bars"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements plus ``failed``, the bits of the rules a document fails."""
    bits = F.lit(0).cast("long")
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(0))
    return measure(docs, id_col, text_col).withColumn("failed", bits)


def passes(policy: Policy) -> Column:
    """Whether a ledger row fails none of the policy's rules."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: documents failing it, failing nothing else, and kept without it.

    One pass groups the ledger by the policy's bits; the rest works on those
    groups, of which there are at most two to the number of rules.
    """
    groups = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("failed")).agg(
        F.count("*").alias("n"))
    rules = F.explode(F.array(*(
        F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules)))
    held = groups.withColumn("r", rules).select("failed", "n", "r.rule", "r.bit")
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    return held.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("failed").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n"))
              .otherwise(0)).alias("n_kept_without"),
    ).withColumns({"policy": F.lit(policy.name), "version": F.lit(policy.version)})


def quality_rules(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with the verdicts ``base_failed`` and ``kept``, a row for each row.

    Repeated rows get equal verdicts; null and empty texts have no words and fail.
    """
    book = ledger(docs)
    return book.withColumns({
        "base_failed": ~passes(BASE),
        "kept": passes(BASE) & passes(policy),
    })
