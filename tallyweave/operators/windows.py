"""Time windows of the order extraction, as data operators.

Windows are half-open: an instant belongs to exactly one of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyweave import constants as C
from tallyweave.operators.skew import top_n_per_group


def window_plan(bounds: DataFrame, hours: int = C.WINDOW_HOURS) -> DataFrame:
    """Windows covering whole days from ``first_day`` to ``last_day`` inclusive."""
    step = F.expr(f"INTERVAL {int(hours)} HOURS")
    end = F.col("last_day").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    start = F.col("first_day").cast("timestamp_ntz")
    starts = F.sequence(start, end - F.expr("INTERVAL 1 SECOND"), step)
    return bounds.select(F.explode(starts).alias("window_start"), end.alias("_end")).select(
        "window_start", F.least(F.col("window_start") + step, F.col("_end")).alias("window_end")
    )


def _tumbling(column: str, hours: int):
    return F.window(F.col(column), f"{int(hours)} hours")


def window_volume(
    df: DataFrame, column: str, hours: int = C.WINDOW_HOURS, cap: int = C.WINDOW_CAP
) -> DataFrame:
    """Rows per window and whether the extraction cap is exceeded."""
    return (
        df.groupBy(_tumbling(column, hours).alias("w"))
        .agg(F.count("*").alias("n_rows"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "n_rows", (F.col("n_rows") > cap).alias("over_cap"),
        )
    )


def capped_extract(
    df: DataFrame,
    column: str,
    row_id: Sequence[str],
    hours: int = C.WINDOW_HOURS,
    cap: int = C.WINDOW_CAP,
) -> DataFrame:
    """The earliest ``cap`` rows of each window, by creation time."""
    placed = df.withColumn("window_start", _tumbling(column, hours)["start"])
    order = [F.asc(column), *[F.asc(c) for c in row_id]]
    return top_n_per_group(placed, ["window_start"], order, cap, row_id)
