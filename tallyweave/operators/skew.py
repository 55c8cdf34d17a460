"""Joins and top-n that stay even when one key holds a large share of the rows.

A frequent key is one that holds more rows than an average shuffle partition.
Such keys are found with an aggregate over the bare key column.  Their rows are
spread over all shuffle partitions by a hash of their identity, and the few
lookup rows they need are repeated once per partition.  Rows with a null key
match nothing, so they are spread without repeating anything.  All of it is
exact: which keys are treated as frequent only decides where rows are placed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyweave.session import shuffle_partitions

#: Counters of a column per shuffle partition, and at most: few unlike keys share a counter.
COUNTERS_PER_CELL = 16
MOST_COUNTERS = 1 << 18


@dataclass(frozen=True)
class KeyProfile:
    """Frequent values of a key column: at most one per shuffle partition, often none."""

    hot: tuple[str, ...] = ()
    hot_null: bool = False

    def is_hot(self, key: Column) -> Column:
        test = F.coalesce(key.isin(*self.hot), F.lit(False)) if self.hot else F.lit(False)
        return test


def profile_key(df: DataFrame, key: str) -> KeyProfile:
    """Find the frequent values of one text column."""
    return profile_keys(df, {"key": F.col(key)})["key"]


def profile_keys(df: DataFrame, keys: Mapping[str, Column]) -> dict[str, KeyProfile]:
    """Find the frequent values of several text columns in one pass over them."""
    def entries(names: Sequence[str]) -> DataFrame:
        pairs = [(F.lit(n).alias("name"), keys[n].cast("string").alias("k")) for n in names]
        if len(pairs) == 1:
            return df.select(*pairs[0])
        return df.select(F.inline(F.array(*(F.struct(*p) for p in pairs))))

    return _profile(entries, list(keys), df.sparkSession)


def profile_frames(frames: Mapping[str, tuple[DataFrame, str]]) -> dict[str, KeyProfile]:
    """Find the frequent values of one text column of several frames, in one job."""
    def entries(names: Sequence[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, (
            frames[n][0].select(F.lit(n).alias("name"), F.col(frames[n][1]).cast("string").alias("k")) for n in names))

    return _profile(entries, list(frames), next(iter(frames.values()))[0].sparkSession)


def _profile(entries: Callable[[Sequence[str]], DataFrame], names: Sequence[str],
             spark: SparkSession) -> dict[str, KeyProfile]:
    """Frequent values ``k`` by ``name``, exactly.

    Keys are counted by a hash into a fixed number of counters, which needs neither the
    keys nor a state that grows with them.  A counter at or below an average shuffle
    partition holds no frequent key; where one is above, the keys that share it are
    counted by themselves, in a second pass over the columns concerned.  What reaches
    the driver is a row per full counter, of which there are fewer than shuffle
    partitions, and one per frequent key.
    """
    cells = shuffle_partitions(spark)
    counter = F.pmod(F.xxhash64("k"), F.lit(min(MOST_COUNTERS, COUNTERS_PER_CELL * cells)))
    counted = entries(names).groupBy("name", F.when(F.col("k").isNotNull(), counter).alias("counter")).agg(F.count("*").alias("n"))
    whole = counted.withColumn("total", F.sum("n").over(Window.partitionBy("name")))
    full = whole.where(F.col("n") * cells > F.col("total")).collect()
    shared = {n: [r["counter"] for r in full if r["name"] == n and r["counter"] is not None] for n in names}
    frequent = []
    if any(shared.values()):
        asked = [n for n in names if shared[n]]
        total = {r["name"]: r["total"] for r in full}
        in_full = reduce(lambda a, b: a | b, ((F.col("name") == n) & counter.isin(*shared[n]) for n in asked))
        least = reduce(lambda c, n: c.when(F.col("name") == n, total[n]), asked, F)
        frequent = (
            entries(asked).where(F.col("k").isNotNull() & in_full)
            .groupBy("name", "k").agg(F.count("*").alias("n")).where(F.col("n") * cells > least).collect()
        )
    return {
        name: KeyProfile(
            tuple(sorted(r["k"] for r in frequent if r["name"] == name)),
            any(r["name"] == name and r["counter"] is None for r in full),
        )
        for name in names
    }


def _cell(row_id: Sequence[str], cells: int) -> Column:
    return F.pmod(F.xxhash64(*row_id), F.lit(cells)).cast("int")


def _repeat(test: Column, cells: int) -> Column:
    """One row per cell where ``test`` holds, else a single row in cell 0."""
    every = F.sequence(F.lit(0), F.lit(cells - 1))
    return F.explode(F.when(test, every).otherwise(F.array(F.lit(0))))


def lookup_join(
    left: DataFrame,
    key: str,
    lookups: Sequence[tuple[DataFrame, str] | tuple[DataFrame, str, Column]],
    row_id: Sequence[str],
    profile: KeyProfile | None = None,
    match_nulls: bool = False,
) -> DataFrame:
    """Left-join lookups that hold at most one row per key; keeps the row count.

    ``row_id`` names columns that tell left rows apart.  A lookup is a frame and
    its key column, with a further join condition if need be.  All lookups share
    one key, so the left side is shuffled once however many there are.  Without
    frequent keys these are plain joins, which reuse the partitioning that
    deduplication left on the lookup side.
    """
    profile = profile_key(left, key) if profile is None else profile
    cells = shuffle_partitions(left.sparkSession)
    value = F.col(key)
    spread_nulls = profile.hot_null and not match_nulls
    out, placed = left, value
    if spread_nulls:
        # a made-up key per row instead of null; the join condition keeps it from matching
        apart = F.concat(F.lit("null "), F.xxhash64(*row_id).cast("string"))
        out = left.withColumns({"_key": F.coalesce(value, apart), "_keyed": value.isNotNull()})
        placed = F.col("_key")

    def needs_spread(k: Column) -> Column:
        test = profile.is_hot(k)
        return test | k.isNull() if match_nulls and profile.hot_null else test

    spread = bool(profile.hot) or (match_nulls and profile.hot_null)
    if spread:
        cell = F.when(needs_spread(placed), _cell(row_id, cells)).otherwise(F.lit(0))
        out = out.withColumn("_cell", cell)
    for i, (lookup, lookup_key, *further) in enumerate(lookups):
        k, c = f"_key{i}", f"_cell{i}"
        side = lookup.withColumn(k, F.col(lookup_key))
        same = placed.eqNullSafe(F.col(k)) if match_nulls else placed == F.col(k)
        if spread:
            side = side.withColumn(c, _repeat(needs_spread(F.col(k)), cells))
            same = same & (F.col("_cell") == F.col(c))
        if spread_nulls:
            same = same & F.col("_keyed")
        for condition in further:
            same = same & condition
        out = out.join(side, same, "left").drop(k, c)
    return out.drop("_key", "_keyed", "_cell")


def fanout_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_id: Sequence[str],
    right_id: Sequence[str],
    how: str = "left",
) -> DataFrame:
    """Left or full join that keeps every match, where either side may have frequent keys.

    Left rows of a frequent left key are split over ``a`` cells and right rows
    of a frequent right key over ``b`` cells; each side is repeated along the
    other side's cells, so every pair meets in exactly one (a, b) cell.  Both
    keys are profiled in one job; without frequent ones this is a plain join.
    """
    if how not in ("left", "full"):
        raise ValueError(f"no {how} join here")
    found = profile_frames({"left": (left, left_key), "right": (right, right_key)})
    on_left, on_right = found["left"], found["right"]
    lk, rk = F.col(left_key), F.col(right_key)
    if how == "left":
        right = right.where(rk.isNotNull())
    if not (on_left.hot or on_left.hot_null or on_right.hot or (on_right.hot_null and how == "full")):
        return left.join(right, lk == rk, how)
    cells = shuffle_partitions(left.sparkSession)

    def spread(key: Column, profile: KeyProfile, row_id: Sequence[str]) -> Column:
        return F.when(key.isNull(), F.hash(*row_id)).when(profile.is_hot(key), _cell(row_id, cells)).otherwise(F.lit(0))

    split_left = left.withColumns({"_a": spread(lk, on_left, left_id)}).withColumn("_b", _repeat(on_right.is_hot(lk), cells))
    split_right = right.withColumns({"_rb": spread(rk, on_right, right_id)}).withColumn("_ra", _repeat(on_left.is_hot(rk), cells))
    joined = split_left.join(
        split_right,
        (lk == rk) & (F.col("_a") == F.col("_ra")) & (F.col("_b") == F.col("_rb")),
        how,
    )
    # A frequent key is known to exist on its side, so a copy of the other
    # side's row that met an empty cell is not an unmatched row.
    spurious = (F.col("_ra").isNull() & on_right.is_hot(lk)) | (F.col("_a").isNull() & on_left.is_hot(rk))
    return joined.where(~spurious).drop("_a", "_b", "_ra", "_rb")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key (null is a key too).

    Spark applies the ``row_number() = 1`` filter before the shuffle as well,
    so a frequent key sends one row per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    row_id: Sequence[str],
) -> DataFrame:
    """The first ``n`` rows of each group; large groups are cut down in parts first."""
    cells = shuffle_partitions(df.sparkSession)
    parts = Window.partitionBy(*keys, "_cell").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_cell", _cell(row_id, cells))
        .withColumn("_rn", F.row_number().over(parts))
        .where(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(whole))
        .where(F.col("_rn") <= n)
        .drop("_rn", "_cell")
    )
