"""The order cache as a table of buckets, of which an update rewrites the touched ones."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from tallyweave.functions.text import base_order_id
from tallyweave.operators.enrich import upsert_cache
from tallyweave.session import cut_lineage

BUCKET = "cache_bucket"
#: Successive order numbers that share a bucket, and buckets of ids that are no numbers.
SPAN, OTHERS = 100_000, 64


def bucket_of(order_id: Column, span: int = SPAN) -> Column:
    """Order numbers by range, so that answers to recent orders touch few buckets; other ids by hash."""
    number = base_order_id(order_id).try_cast("bigint")
    other = F.pmod(F.xxhash64(order_id), F.lit(OTHERS))
    return F.when(number.isNotNull(), F.concat(F.lit("n"), F.floor(number / span).cast("string"))).otherwise(
        F.concat(F.lit("h"), other.cast("string")))


def read_cache(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All answers, with their bucket; an absent cache is an empty one."""
    whole = StructType([f for f in schema.fields if f.name != BUCKET]).add(BUCKET, StringType())
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def update_cache(path: str, fresh: DataFrame, span: int = SPAN) -> list[str]:
    """Merge fresh answers into the cache at ``path``; returns the buckets rewritten.

    Only buckets with a fresh answer are read and written.  Their new files are
    written beside the old ones and take their place when all are there; a run that
    failed is repeated as a whole, since merging twice gives the same rows.  The
    names of the touched buckets are known to the driver, a bucket being ``span`` orders.
    """
    spark = fresh.sparkSession
    keyed = cut_lineage(fresh.withColumn(BUCKET, bucket_of(F.col("order_id"), span)))
    touched = sorted(r[0] for r in keyed.select(BUCKET).distinct().collect())
    old = read_cache(spark, path, fresh.schema).where(F.col(BUCKET).isin(touched))
    # answers of one order share its bucket
    merged = cut_lineage(upsert_cache(old, keyed))
    (merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BUCKET).parquet(path))
    return touched
