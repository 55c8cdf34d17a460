"""Order lists, order exports and the enrichment cache."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave import constants as C, schemas
from tallyweave.functions import nested
from tallyweave.operators import enrich, feeds
from tallyweave.sources.delimited import scan_delimited

# Timestamp columns of listed and exported orders
ORDER_TIMES = (
    "creation_date", "last_change", "authorized_date", "payment_approved_date",
    "ready_for_handling_date", "shipping_estimated_date", "shipping_estimated_date_min",
    "shipping_estimated_date_max",
)
EXPORT_TIMES = ("creation_date", "last_change", "shipping_estimated_date")


def scan_orders_json(spark: SparkSession, path: str) -> DataFrame:
    """Listed orders from JSON lines, typed."""
    docs = spark.read.schema(schemas.ORDER_SUMMARY).json(path)
    flat = docs.select(F.struct("*").alias("doc")).select(*nested.summary(F.col("doc")))
    return enrich.normalize_order_types(feeds.parse_utc(flat, ORDER_TIMES))


def scan_order_export(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Order export under canonical names; several rows per order.

    ``position`` keeps the load order for :func:`enrich.collapse_orders`.
    """
    raw = scan_delimited(spark, folder, pattern, position="position")
    named = raw.withColumnsRenamed({k: v for k, v in C.ORDER_EXPORT_HEADERS.items() if k in raw.columns})
    return enrich.normalize_order_types(feeds.parse_utc(named, EXPORT_TIMES))


def scan_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored enrichment; an absent cache is an empty one."""
    try:
        return spark.read.schema(schemas.CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.CACHE)
