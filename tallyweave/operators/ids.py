"""Consecutive surrogate ids without a single-partition sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tallyweave.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def dense_ids(df: DataFrame, order_cols: Sequence[str], name: str) -> DataFrame:
    """Number the rows 1..n in the given order, which must be a total order.

    Rows are range-partitioned and sorted, then stored once with the number of
    their partition and their place in it, so the partition counts and the
    numbering agree even after an executor is lost.  The offsets table has one
    row per partition, which is what bounds its window and its broadcast.
    """
    ordered = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    stored = cut_lineage(
        ordered.withColumn("_part", F.shiftright("_mid", _ROW_BITS)).withColumn(
            "_pos", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        )
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_mid", "_start")
    )
