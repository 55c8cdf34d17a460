"""The consolidated frame stored by month, which reports are served from.

Joining the feeds costs far more than any report, and a report is asked for again with
every change of its period.  So the frame is written once, a folder per month, with the
column statistics of its Parquet files; a period reads the folders of its months and the
columns of its report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from tallyweave.functions import dates
from tallyweave.operators.feeds import STORED_MONTH


def write_store(rows: DataFrame, path: str, date: str = "record_date", gather: bool = False) -> StructType:
    """Write the rows by month of ``date``; returns the schema to open the store with.

    Every task writes the months of its own rows, so the frame is not shuffled again for
    it; a month gets a file per task.  With ``gather`` the rows of a month are brought
    together first, which costs a shuffle of the whole frame and is for small ones, whose
    tasks would write files of a few rows.  Rows without a date have a folder of their own,
    which no period reads.
    """
    placed = rows.withColumn(STORED_MONTH, dates.month_key(date))
    out = placed.hint("rebalance", STORED_MONTH) if gather else placed
    out.write.option("compression", "zstd").partitionBy(STORED_MONTH).parquet(path)
    kept = [f for f in placed.schema.fields if f.name != STORED_MONTH]
    return StructType(kept).add(STORED_MONTH, StringType())


def open_store(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored frame; :func:`month_range_filter` prunes it to the folders of a period."""
    return spark.read.schema(schema).parquet(path)
