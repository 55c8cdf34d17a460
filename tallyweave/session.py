"""Session helpers: settings the jobs rely on, and the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the plans rely on.  Partition counts are left to the cluster; AQE
#: coalesces small shuffle partitions and converts small sides to broadcasts
#: after measuring them.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # row_number() <= n filters are also applied before the shuffle up to this n
    "spark.sql.optimizer.windowGroupLimitThreshold": "3000",
}


def build_session(
    app_name: str = "tallyweave",
    master: str | None = None,
    **conf: str,
) -> SparkSession:
    """A session with :data:`RECOMMENDED` settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors must share.

    Without the setting, that of ``SparkContext.setCheckpointDir``, as local tests use it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return named.rstrip("/")


def has_shared_dir(spark: SparkSession) -> bool:
    return bool(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Store the rows once as a table in the shared folder and go on from there.

    Later steps read only the columns they need, and a lost executor costs a
    re-read instead of a recomputation.  Folders are left for the operator of
    the cluster to expire, like checkpoints.  ``compression`` is that of the session by default.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyweave/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings for one step, ``__`` standing for dots; what was set before comes back."""
    names = {key.replace("__", "."): value for key, value in conf.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
